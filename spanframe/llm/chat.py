"""Chat formatting by schema fingerprints.

Records come in many layouts. The fingerprint of a record is a hash of its nested field paths; it selects a declarative
mapping, a description of where turns, roles and texts are, and the record is converted to canonical turns and written in
a template that marks turns. Control strings inside texts are escaped reversibly, and the loss mask covers the texts of
the assistant's turns, so that turns and masked texts can be read back from the output.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.llm.common import bound_batches, fresh_name

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


@dataclass(frozen=True)
class Mapping:
    """Either a list of turns with a role and a text field, or single fields that are turns of set roles, in order."""

    turns: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, str], ...] = ()
    #: Names of roles in this layout -> canonical ones; others stay as they are.
    roles: tuple[tuple[str, str], ...] = ()


def paths(value: object) -> set[str]:
    """The nested field paths of a JSON value; the elements of an array share the path ``[]``."""
    found, left = set(), [(value, "")]
    while left:
        value, at = left.pop()
        if isinstance(value, dict):
            parts = [(v, f"{at}.{k}") for k, v in value.items()]
        elif isinstance(value, list):
            parts = [(v, f"{at}[]") for v in value]
        else:
            continue
        found.update(p for _, p in parts)
        left += parts
    return found


def fingerprint(value: object) -> int:
    return xxhash.xxh64_intdigest("\n".join(sorted(paths(value))).encode("utf-8", "surrogatepass"))


def path_hash(*names: str) -> int:
    """The fingerprint of a record that has these field paths."""
    return xxhash.xxh64_intdigest("\n".join(sorted(names)))


SHARED = (("human", "user"), ("gpt", "assistant"))
#: The known layouts, by the fingerprint of their paths.
MAPPINGS: dict[int, Mapping] = {
    path_hash(".messages", ".messages[]", ".messages[].role", ".messages[].content"): Mapping("messages"),
    path_hash(".messages"): Mapping("messages"),
    path_hash(".conversations", ".conversations[]", ".conversations[].from", ".conversations[].value"): Mapping("conversations", "from", "value", roles=SHARED),
    path_hash(".prompt", ".completion"): Mapping(fields=(("prompt", "user"), ("completion", "assistant"))),
    path_hash(".instruction", ".output"): Mapping(fields=(("instruction", "user"), ("output", "assistant"))),
    path_hash(".instruction", ".input", ".output"): Mapping(fields=(("instruction", "system"), ("input", "user"), ("output", "assistant"))),
    path_hash(".system", ".prompt", ".response"): Mapping(fields=(("system", "system"), ("prompt", "user"), ("response", "assistant"))),
}


def parsed_record(record: str | None) -> object:
    """The value of a JSON text; None for null, for what isn't JSON, and for what is nested too deep to be read."""
    try:
        return json.loads(record) if record is not None else None
    except (ValueError, RecursionError):
        return None


def canonical(value: object, mappings: dict[int, Mapping] = MAPPINGS) -> list[tuple[str, str]] | None:
    """The turns (role, text) of a parsed record; None for an unknown layout.

    Records with the same paths may still differ in what stands there: where turns aren't a list (null counts as an empty
    one) of objects that all have the mapped fields, the layout is unknown as well.
    """
    found = mappings.get(fingerprint(value)) if isinstance(value, dict) else None
    if found is None:
        return None
    text = lambda x: x if isinstance(x, str) else "" if x is None else json.dumps(x, ensure_ascii=False)
    if found.fields:
        return [(role, text(value[name])) for name, role in found.fields]
    turns, roles = value[found.turns] if value[found.turns] is not None else [], dict(found.roles)
    if not isinstance(turns, list) or not all(isinstance(t, dict) and found.role in t and found.text in t for t in turns):
        return None
    return [(roles.get(text(t[found.role]), text(t[found.role])), text(t[found.text])) for t in turns]


def escaped(text: str) -> str:
    """``text`` with a backslash more in each ``<|``, ``<\\|`` and so on, so that it holds no control string."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _role(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _plain_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[int]]:
    """The text of the turns in the template, and its loss mask: start and end of each assistant text, in code points."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{_role(role)}\n", escaped(text)
        if role == "assistant":
            mask += [at + len(head), at + len(head) + len(body)]
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), mask


def parsed(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns = []
    for part in text.split(CLOSE)[:-1]:
        role, _, body = part.removeprefix(OPEN).partition("\n")
        turns.append((_plain_role(role), unescaped(body)))
    return turns


def encodable(turns: list[tuple[str, str]]) -> bool:
    """Whether the turns can be told in UTF-8: a JSON text may name half of a surrogate pair, which no text can hold."""
    try:
        return all(part.encode() is not None for turn in turns for part in turn)
    except UnicodeEncodeError:
        return False


def format_records(records: DataFrame, json_col: str = "record", mappings: dict[int, Mapping] = MAPPINGS) -> DataFrame:
    """``records`` with layout (the fingerprint, 16 hex digits), formatted and loss_mask.

    Records of unknown layout, null ones, what isn't JSON and what names half a surrogate pair in a role or text get nulls
    in formatted and loss_mask; nothing is dropped. A record that can't be read has no layout.
    Columns of ``records`` with these names give way to the operator's.
    """
    bound_batches(records.sparkSession)

    @F.pandas_udf("layout string, formatted string, loss_mask array<int>")
    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for record in batch:
                value = parsed_record(record)
                turns = canonical(value, mappings)
                layout = f"{fingerprint(value):016x}" if value is not None else None
                rows.append((layout, *(formatted(turns) if turns is not None and encodable(turns) else (None, None))))
            yield pd.DataFrame(rows, columns=["layout", "formatted", "loss_mask"])

    plain = [F.col(c) for c in records.columns if c.lower() not in ("layout", "formatted", "loss_mask")]
    held = fresh_name(records, "_chat")
    return records.withColumn(held, convert(F.col(json_col))).select(*plain, f"{held}.*")


def packed(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): each conversation as one JSON record. Layouts differ from conversation to conversation.

    Turns are ordered by turn, then role and text where turns repeat. A null text or role is an empty one.
    """
    clean = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = F.array_sort(F.collect_list(F.struct("turn", clean("role").alias("role"), clean("text").alias("text"))))
    rows = conversations.groupBy("conv_id").agg(turns.alias("turns"))
    role = lambda i: F.get("turns", F.lit(i))["role"]
    text = lambda i: F.get("turns", F.lit(i))["text"]
    known = F.forall("turns", lambda t: t["role"].isin("system", "user", "assistant"))
    kind = F.pmod(F.coalesce(F.col("conv_id"), F.lit(0)), F.lit(4))
    pair = (F.size("turns") == 2) & (role(0) == "user") & (role(1) == "assistant")
    triple = (F.size("turns") == 3) & (role(0) == "system") & (role(1) == "user") & (role(2) == "assistant")
    shared = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    record = (
        F.when(pair & (kind == 1), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("completion"))))
        .when(pair & (kind == 2), F.to_json(F.struct(text(0).alias("instruction"), text(1).alias("output"))))
        .when(triple & (kind == 1), F.to_json(F.struct(text(0).alias("system"), text(1).alias("prompt"), text(2).alias("response"))))
        .when(known & (kind == 3), F.to_json(F.struct(F.transform("turns", lambda t: F.struct(shared(t["role"]).alias("from"), t["text"].alias("value"))).alias("conversations"))))
        .otherwise(F.to_json(F.struct(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages"))))
    )
    return rows.select("conv_id", record.alias("record"))


def digest(formatted_records: DataFrame) -> DataFrame:
    """What the output says: turns and masked texts are read back from formatted and loss_mask."""

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
        for texts, masks in batches:
            rows = []
            for text, mask in zip(texts, masks):
                turns = parsed(text)
                loss = "".join(unescaped(text[a:b]) for a, b in zip(mask[::2], mask[1::2]))
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            yield pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    back: Column = read("formatted", "loss_mask")
    held = fresh_name(formatted_records, "_read")
    return formatted_records.where("formatted IS NOT NULL").withColumn(held, back).select("conv_id", f"{held}.*", "layout")
