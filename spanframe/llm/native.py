"""Spans of regular expressions in texts, with DataFrame functions only.

A span is struct<start, end, value, before, after>: code points, end exclusive, and what stands before it since the span
before (24 code points at most) and behind it (2 at most). Patterns are Java's, and must not match the empty string.

Arrays are folded in blocks, since a fold that appends copies all that it has so far at each step: a text with very many
spans takes time in proportion to their number, near enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.llm.common import fresh_name

SPAN = "struct<start:int,end:int,value:string,before:string,after:string>"
#: Elements of an array that are folded, or compared with each other, at a time; code points of a text's piece.
BLOCK, PIECE = 256, 4096


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _prefixes(values: Column, combine) -> Column:
    """For each place what ``combine`` makes of 0 and the values before it, by one fold."""
    begin = F.struct(F.lit(0).alias("now"), F.array().cast("array<int>").alias("out"))
    step = lambda done, v: F.struct(combine(done["now"], v).alias("now"), F.concat(done["out"], F.array(done["now"])).alias("out"))
    return F.aggregate(values, begin, step, lambda done: done["out"])


def blocks(values: Column) -> Column:
    """The array cut into arrays of BLOCK elements."""
    count = F.ceil(F.size(values) / BLOCK).cast("int")
    return F.when(count < 2, F.array(values)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))


def running(values: Column, combine) -> Column:
    """_prefixes over blocks: ``combine`` must be associative, with 0 as its neutral element."""

    def told(cut: Column) -> Column:
        whole = F.transform(cut, lambda b: F.aggregate(b, F.lit(0), combine))
        return let(_prefixes(whole, combine), lambda starts: F.flatten(F.transform(cut, lambda b, i: F.transform(_prefixes(b, combine), lambda v: combine(F.get(starts, i), v)))))

    return let(blocks(values), told)


def matches(text: Column, pattern: str, only_if: Column | None = None) -> Column:
    """The leftmost non-overlapping matches of ``pattern``, in order, as an array of spans.

    The pieces between matches, as split() gives them, tell where the matches are. only_if: a cheap condition on the text
    that holds wherever the pattern matches.
    """
    none = F.array().cast(f"array<{SPAN}>")

    def placed(found: Column) -> Column:
        gaps, values = found["gaps"], found["values"]
        lengths = F.transform(values, lambda v, i: F.length(F.get(gaps, i)) + F.length(v))

        def span(at: Column):
            def one(v: Column, i: Column) -> Column:
                start = F.get(at, i) + F.length(F.get(gaps, i))
                return F.struct(start.alias("start"), (start + F.length(v)).alias("end"), v.alias("value"), F.right(F.get(gaps, i), F.lit(24)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(2)).alias("after"))

            return F.transform(values, one)

        return F.when(F.size(values) == 0, none).otherwise(let(running(lengths, lambda a, b: a + b), span))

    pieces = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"))
    found = let(pieces, placed)
    return found if only_if is None else F.when(only_if, found).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(number, n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, digit * 2 - F.when(digit > 4, 9).otherwise(0)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def marked(spans: Column, others: Column, result) -> Column:
    """``result(span, meets)`` of each of ``spans``, which stand in order of start; meets: it overlaps one of ``others``.

    Each block of spans first takes the others that overlap it as a whole, so a span isn't held against all.
    """

    def near(block: Column) -> Column:
        whole = F.struct(F.get(block, 0)["start"].alias("start"), F.array_max(F.transform(block, lambda s: s["end"])).alias("end"))
        some = let(whole, lambda w: F.filter(others, lambda o: (o["start"] < w["end"]) & (w["start"] < o["end"])))
        return let(some, lambda o: F.transform(block, lambda s: result(s, overlaps(s, o))))

    return F.when(F.size(others) == 0, F.transform(spans, lambda s: result(s, F.lit(False)))).otherwise(F.flatten(F.transform(blocks(spans), near)))


def replaced(df: DataFrame, text_col: str, spans_col: str, labels: Column) -> DataFrame:
    """``df`` with each of ``spans_col`` (start, end, kind, in order of start) replaced by its kind's label in ``text_col``.

    Spans that overlap are replaced together by the label of the first. The text is cut into pieces, each of which looks
    only at its own spans. In steps of a column each, as the analyser can't take so many functions within each other.
    """
    reach, firsts, whole = (fresh_name(df, n) for n in ("_reach", "_firsts", "_whole"))
    text, spans = F.col(text_col), F.col(spans_col)
    out = df.withColumn(reach, running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b)))
    out = out.withColumn(firsts, F.filter(F.transform(spans, lambda s, i: F.when(s["start"] >= F.get(F.col(reach), i), i)), lambda i: i.isNotNull()))
    until = lambda k: F.coalesce(F.get(F.col(reach), F.get(F.col(firsts), k + 1)), F.array_max(F.transform(spans, lambda s: s["end"])))
    out = out.withColumn(whole, F.transform(firsts, lambda i, k: F.struct(F.get(spans, i)["start"].alias("start"), until(k).alias("end"), F.get(labels, F.get(spans, i)["kind"]).alias("label"))))

    def piece(part: Column, k: Column) -> Column:
        low = k * PIECE
        high = low + F.length(part)

        def told(own: Column) -> Column:
            def one(s: Column, i: Column) -> Column:
                at = F.when(i == 0, 0).otherwise(F.get(own, i - 1)["end"] - low)
                return F.concat(F.substring(part, at + 1, F.greatest(s["start"] - low - at, F.lit(0))), F.when(s["start"] >= low, s["label"]).otherwise(""))

            rest = F.substring(part, F.element_at(own, -1)["end"] - low + 1, F.lit(PIECE))
            return F.when(F.size(own) == 0, part).otherwise(F.concat(F.array_join(F.transform(own, one), ""), rest))

        return let(F.filter(F.col(whole), lambda s: (s["start"] < high) & (low < s["end"])), told)

    new = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)), piece), "")
    return out.withColumn(text_col, F.when(F.size(spans) == 0, text).otherwise(new)).drop(reach, firsts, whole)


def joined(spans: Column, names: list[str]) -> Column:
    """``kind:start:end`` of spans whose kind is a number of ``names``, joined by commas in the array's order."""
    kinds = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
