"""Column functions: times as text, source locations, paths, args."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The args that name a source file and a line, in order of precedence.
FILE_KEYS = ["file", "src_file", "fileName", "source_file", "src", "filename"]
LINE_KEYS = ["line", "src_line", "lineNumber", "source_line", "lineno", "line_number"]


def format_time(us: Column) -> Column:
    """Microseconds as text with the unit that suits their size."""
    size = F.abs(us)
    return (
        F.when(size < 1, F.format_string("%.1f ns", us * 1000)).when(size < 1000, F.format_string("%.3f us", us))
        .when(size < 1_000_000, F.format_string("%.3f ms", us / 1000)).otherwise(F.format_string("%.3f s", us / 1_000_000))
    )


def source_file(args: Column) -> Column:
    """The first non-empty text among the file keys; null for none."""
    kinds = F.from_json(args, "map<string,variant>")
    text = lambda k: F.when(F.schema_of_variant(F.element_at(kinds, k)) == "STRING", F.get_json_object(args, f"$.{k}"))
    first = F.coalesce(*[text(k) for k in FILE_KEYS])
    return F.when(first != "", first)


def source_line(args: Column) -> Column:
    """The value of the first line key that is there, be it null, if it is a number or the text of one."""
    value, there = F.lit(None).cast("string"), F.json_object_keys(args)
    for key in reversed(LINE_KEYS):
        value = F.when(F.array_contains(there, key), F.get_json_object(args, f"$.{key}")).otherwise(value)
    return value.try_cast("double").cast("int")


def remap_source_path(path: Column, strip: str = "", base: str = "") -> Column:
    """The path with slashes, rid of a leading ``strip`` whatever its case, and with ``base`` before it."""
    strip, base = strip.replace("\\", "/").rstrip("/"), base.replace("\\", "/").rstrip("/")
    out = F.translate(path, "\\", "/")
    if strip:
        out = F.when(F.lower(F.left(out, F.lit(len(strip)))) == strip.lower(), F.substr(out, F.lit(len(strip) + 1))).otherwise(out)
    return F.concat(F.lit(base + "/"), F.ltrim(out, F.lit("/"))) if base else out


def with_source(spans: DataFrame, strip: str = "", base: str = "") -> DataFrame:
    return spans.withColumn("source_file", remap_source_path(source_file(F.col("args")), strip, base)).withColumn("source_line", source_line(F.col("args")))


def nesting(text: Column) -> Column:
    """How deep the objects and arrays of a JSON text are nested; 0 for a scalar and for null."""
    brackets = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\\\]|\\\\.)*+"', ""), r"[^\[\]{}]", "")
    step = lambda s, c: F.struct((s["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(s["most"], s["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("most"))
    each = F.filter(F.split(brackets, ""), lambda c: c != "")
    return F.coalesce(F.aggregate(each, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda s: s["most"]), F.lit(0))


def explode_args(spans: DataFrame) -> DataFrame:
    """(event_id, key, value): a row for each scalar in an event's args, however nested; key: its path, as ``a.b[0].c``.

    Values are texts; a null has a null value, and an empty object or array a row of its own, {} or []. Args that aren't a
    JSON object have no rows. A job finds the greatest depth; then one scan opens as many levels at once.
    """
    levels = spans.select(nesting(F.col("args")).alias("n")).agg(F.max("n")).first()[0] or 0
    empty = lambda v: F.to_json(v).isin("{}", "[]")

    def opened(p: Column) -> Column:
        kind = F.schema_of_variant(p["value"])
        items = F.transform(F.try_variant_get(p["value"], "$", "array<variant>"), lambda v, i: F.struct(F.concat(p["key"], F.lit("["), i.cast("string"), F.lit("]")).alias("key"), v.alias("value")))
        pairs = F.transform(F.map_entries(F.try_variant_get(p["value"], "$", "map<string,variant>")), lambda q: F.struct(F.concat_ws(".", p["key"], q["key"]).alias("key"), q["value"].alias("value")))
        return F.when(kind.startswith("ARRAY") & ~empty(p["value"]), items).when(kind.startswith("OBJECT") & ~empty(p["value"]), pairs).otherwise(F.array(p))

    parts = F.transform(F.map_entries(F.from_json("args", "map<string,variant>")), lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value")))
    rows = spans.select("event_id", parts.alias("parts"))
    for _ in range(levels - 1):
        rows = rows.select("event_id", F.flatten(F.transform("parts", opened)).alias("parts"))
    rows = rows.select("event_id", F.inline("parts"))
    return rows.select("event_id", "key", F.when(empty(F.col("value")), F.to_json("value")).otherwise(F.try_variant_get("value", "$", "string")).alias("value"))
