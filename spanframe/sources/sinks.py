"""Writing results as CSV or TSV with their header, and events as trace files.

A folder's files, read one after the other in order of their names, are one text: the header or the envelope is a part of
it. As one file it is written by one task, in the same order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(df: DataFrame, c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("NULL"))


def _quoted(x: Column) -> Column:
    return F.when(x.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def csv_lines(df: DataFrame) -> DataFrame:
    """Rows as CSV text; a field is quoted if it holds a comma, a quote or a newline, with quotes doubled."""
    return df.select(F.concat_ws(",", *[_quoted(_text(df, c)) for c in df.columns]).alias("value"))


def tsv_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws("\t", *[_text(df, c) for c in df.columns]).alias("value"))


def _written(rows: DataFrame, head: Column, tail: Column | None, path: str, one_file: bool) -> None:
    """rows (at, value) in order of ``at``, after the head and before the tail; one sort, in one task for one file."""
    edge = lambda k, text: rows.sparkSession.range(1).select(F.lit(k).alias("part"), F.lit(0).cast("long").alias("at"), text.alias("value"))
    whole = edge(0, head).unionByName(rows.select(F.lit(1).alias("part"), "at", "value"))
    whole = whole.unionByName(edge(2, tail)) if tail is not None else whole
    laid = whole.coalesce(1) if one_file else whole.repartitionByRange("part", "at")
    laid.sortWithinPartitions("part", "at").select("value").write.text(path)


def export(df: DataFrame, path: str, separator: str = ",", one_file: bool = False) -> None:
    """Column names and rows as lines, CSV where the separator is a comma, else fields as they are; ``df``'s order holds."""
    names = [F.lit(c) for c in df.columns]
    header = F.concat_ws(separator, *[_quoted(n) if separator == "," else n for n in names])
    lines = csv_lines(df) if separator == "," else tsv_lines(df)
    _written(lines.select(F.monotonically_increasing_id().alias("at"), "value"), header, None, path, one_file)


def _number(x: Column) -> Column:
    """A number as C's %.6g tells it, null for what isn't finite; one whose shortest decimal lies half way is rounded away from zero."""
    e = F.regexp_extract(F.format_string("%.5e", x), r"e([+-]\d+)$", 1).try_cast("int")
    bare = lambda s: F.when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)
    fixed = F.call_function("format_string", F.concat(F.lit("%."), F.greatest(F.lit(5) - e, F.lit(0)).cast("string"), F.lit("f")), x)
    short = F.concat(bare(F.regexp_extract(F.format_string("%.5e", x), r"^([^e]*)", 1)), F.regexp_extract(F.format_string("%.5e", x), r"(e.*)$", 1))
    told = F.when((e < -4) | (e >= 6), short).otherwise(bare(fixed))
    return F.when(x == 0, "0").when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "null").otherwise(told)


def args_json(df: DataFrame, *columns: str) -> Column:
    """An args object of typed columns: texts escaped, integers and booleans as they are, other numbers with six digits; null is null."""
    kinds, parts = dict(df.dtypes), []
    for c in columns:
        kind, x = kinds[c], F.col(c)
        if kind in ("float", "double") or kind.startswith("decimal"):
            told = _number(x.cast("double"))
        elif kind in ("tinyint", "smallint", "int", "bigint", "boolean"):
            told = x.cast("string")
        else:
            told = F.expr("substr(j, 6, length(j) - 6)".replace("j", f"to_json(struct(`{c}` AS v))"))
        parts.append(F.concat(F.regexp_replace(F.to_json(F.array(F.lit(c))), r"^\[|\]$", ""), F.lit(":"), F.coalesce(told, F.lit("null"))))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def trace_lines(events: DataFrame) -> DataFrame:
    """Complete and counter events as JSON lines; not-a-number and infinite values are null."""
    return _lines(events).select("value")


def _lines(events: DataFrame) -> DataFrame:
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    args = F.coalesce(F.col("args"), F.lit("{}"))
    head = F.to_json(F.struct("name", F.col("category").alias("cat"), F.col("phase").alias("ph"), finite("ts").alias("ts"), finite("dur").alias("dur"), "pid", "tid"))
    line = F.concat(F.expr("substr(h, 1, length(h) - 1)"), F.lit(',"args":'), F.col("a"), F.lit("}"))
    return events.where("phase IN ('X', 'C')").select("event_id", head.alias("h"), args.alias("a")).select("event_id", line.alias("value"))


def write_trace(events: DataFrame, path: str, envelope: bool = True, one_file: bool = False) -> None:
    """Complete and counter events in order of event_id, which must be unique; with the envelope, a JSON object with traceEvents.

    Without the envelope each line is an event, and the files are several. The first event is the one without a comma
    before it; one job finds it.
    """
    lines = _lines(events)
    if not envelope:
        return lines.repartitionByRange("event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    first = lines.agg(F.min("event_id")).first()[0]
    comma = F.when(F.col("event_id") == first, F.col("value")).otherwise(F.concat(F.lit(","), "value"))
    _written(lines.select(F.col("event_id").alias("at"), comma.alias("value")), F.lit('{"traceEvents":['), F.lit('],"displayTimeUnit":"us"}'), path, one_file)
