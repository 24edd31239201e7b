"""Reading trace files: JSON objects with traceEvents, arrays, or lines of events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanframe.schema import RAW
from spanframe.sources import structure

PHASES = list("BEXiCbnestfPNODMR")


@dataclass
class Trace:
    events: DataFrame
    processes: DataFrame
    threads: DataFrame
    counters: DataFrame
    metadata: DataFrame | None = None


def phase(ph: Column) -> Column:
    """The first letter; I is i; what isn't a phase is ``?``."""
    first = F.substring(F.coalesce(ph, F.lit("")), 1, 1)
    first = F.when(first == "I", "i").otherwise(first)
    return F.when(first.isin(*PHASES), first).otherwise("?")


def flow_id(text: Column) -> Column:
    """A number, a hexadecimal number after 0x, or 0 for what is neither."""
    hexa = F.conv(F.substring(text, 3, 16), 16, 10)
    number = F.when(text.rlike("^0[xX][0-9a-fA-F]{1,16}$"), hexa).when(text.rlike("^[0-9]{1,20}$"), text)
    return F.coalesce(number.try_cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))


ELEMENTS = "array<string>"


def _told(text: Column) -> Column:
    """Whether a text is one JSON value."""
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1, F.lit(False))


def _is_event(text: Column) -> Column:
    """Whether the text of an object has a field of an event."""
    return F.coalesce(F.arrays_overlap(F.json_object_keys(text), F.array(*[F.lit(f.name) for f in RAW.fields])), F.lit(False))


def events_of_line(line: Column) -> Column:
    """The texts of the events of one line of a trace; null where the line is no part of one that can be told alone.

    An object that has traceEvents holds events, whatever stands before that key; one without any field of an event is none.
    Between the brackets a line holds whole events; the first may also open the brackets and the last close them, with
    other keys of the object before or after. Each such line becomes whole by the brackets that it lacks. Elements that
    aren't objects are no events.
    """
    bare = F.regexp_replace(line, r"^[\s,]+|[\s,]+$", "")
    objects = lambda x: F.filter(F.coalesce(F.from_json(x, ELEMENTS), F.array().cast(ELEMENTS)), lambda e: e.startswith("{"))
    inner = lambda x: objects(F.get_json_object(x, "$.traceEvents"))
    wraps = lambda x: F.coalesce(F.array_contains(F.json_object_keys(x), "traceEvents"), F.lit(False))
    one = F.when(wraps(bare), inner(bare)).when(_is_event(bare), F.array(bare)).otherwise(F.array().cast(ELEMENTS))
    listed = lambda x: F.filter(objects(x), _is_event)
    bracketed = lambda before, after: F.concat(F.lit(before), bare, F.lit(after))
    ways = [  # condition on the line, the text made whole, the events in it
        (bare.startswith("{"), bare, lambda _: one), (bare.startswith("{"), bracketed("[", "]"), listed), (bare.startswith("["), bare, objects),
        (bare.startswith("{"), bracketed("", "]}"), inner), (bare.startswith("["), bracketed("", "]"), objects),
        (bare.rlike(r"^[{\]]") & bare.endswith("}"), bracketed('{"traceEvents":[', ""), inner), (bare.rlike(r"^[{\]]") & bare.endswith("]"), bracketed("[", ""), objects),
    ]
    out = F.when(bare == "", F.array().cast(ELEMENTS))
    for k, (fits, whole, events) in enumerate(ways):
        alone = ~F.coalesce(F.array_contains(F.transform(F.from_json(whole, ELEMENTS), wraps), True), F.lit(False)) if k == 1 else F.lit(True)
        out = out.when(fits & _told(whole) & alone, events(whole))
    return out


def read_raw(spark: SparkSession, path: str, mode: str = "auto") -> DataFrame:
    """(RAW columns, file order as file, block, line_no, sub). mode: auto or lines.

    auto takes files of any layout and splits them all, however their lines are broken (structure.cut_events). lines: every
    line that isn't blank must hold whole events, several or one, and may open or close the brackets around all of them; such
    files are read in one pass, without Python. No event is passed over: what can't be read is an error.
    """
    fault = lambda what: F.raise_error(F.concat(F.lit(what), F.col("file")))
    if mode == "lines":
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"))
        known = F.coalesce(events_of_line(F.col("value")), fault("a line isn't whole events in ").cast(ELEMENTS))
        cut = lines.select("file", "block", "line_no", F.posexplode(known).alias("sub", "text"))
    elif mode == "auto":
        found = structure.cut_events(spark, path).withColumn("text", F.when(_told(F.col("text")), F.col("text")).otherwise(fault("not a trace: an event is no JSON in ")))
        cut = found.where(~F.col("alone") | _is_event(F.col("text"))).select("file", "block", "line_no", F.lit(0).alias("sub"), "text")
    else:
        raise ValueError(f"no such mode: {mode}")
    return cut.select(F.from_json("text", RAW).alias("e"), "file", "block", "line_no", "sub").select("e.*", "file", "block", "line_no", "sub")


def normalise(raw: DataFrame, time_unit: str = "us") -> DataFrame:
    """EVENT columns. Numbers that are missing are 0, texts are empty; with ns, ts and dur are divided by 1000."""
    unit = 1000.0 if time_unit == "ns" else 1.0
    number = lambda c: F.coalesce(F.col(c).try_cast("double").cast("long"), F.lit(0).cast("long"))
    return raw.select(
        "event_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("cat", F.lit("")).alias("category"), phase(F.col("ph")).alias("phase"),
        (F.coalesce("ts", F.lit(0.0)) / unit).alias("ts"), (F.coalesce("dur", F.lit(0.0)) / unit).alias("dur"),
        number("pid").alias("pid"), number("tid").alias("tid"), flow_id(F.col("id")).alias("id"), F.col("args"),
    )


def numbered(raw: DataFrame) -> DataFrame:
    """``raw`` with event_id, the place in file order among events that aren't metadata; metadata get places below zero.

    Two passes: rows are counted by block, and places start from the blocks before; no row order is made on one task.
    """
    part = raw.withColumn("meta", phase(F.col("ph")) == "M").withColumn("chunk", F.shiftright("line_no", 33))
    keys = ["meta", "file", "block", "chunk"]
    sizes = part.groupBy(*keys).count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("meta").orderBy(*keys[1:]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*keys, before.alias("start"))  # a row for each block of a file
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy("line_no", "sub"))
    place = F.col("start") + F.col("inside") - 1 - F.when(F.col("meta"), F.lit(1 << 62)).otherwise(0)
    return part.withColumn("inside", inside).join(starts, keys).withColumn("event_id", place.cast("long")).drop("meta", "inside", "start", "chunk")


def counters_of(events: DataFrame) -> DataFrame:
    """(pid, name, ts, value): a point for each numeric top-level arg of a counter event; several make name.key series."""
    pairs = F.map_entries(F.from_json("args", "map<string,string>"))
    numbers = F.filter(F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), p["value"].try_cast("double").alias("value"))), lambda p: p["value"].isNotNull())
    points = events.where("phase = 'C'").select("pid", "name", "ts", numbers.alias("n"))
    points = points.select("pid", "name", "ts", (F.size("n") > 1).alias("many"), F.explode("n").alias("p"))
    return points.select("pid", F.when(F.col("many"), F.concat_ws(".", "name", "p.key")).otherwise(F.col("name")).alias("name"), "ts", F.col("p.value").alias("value"))


def dimensions(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """processes (pid, name, sort_index) and threads (pid, tid, name, sort_index); the last metadata in file order holds."""
    meta = events.where("phase = 'M'").withColumn("given", F.get_json_object("args", "$.name")).withColumn("index", F.get_json_object("args", "$.sort_index").try_cast("int"))
    last = lambda kind, value: F.max_by(F.when(F.col("name") == kind, F.col(value)), F.when((F.col("name") == kind) & F.col(value).isNotNull(), F.col("event_id")))
    named = meta.groupBy("pid").agg(last("process_name", "given").alias("name"), last("process_sort_index", "index").alias("sort_index"))
    processes = events.select("pid").distinct().join(named, "pid", "left").select(
        "pid", F.coalesce("name", F.concat(F.lit("Process "), F.col("pid").cast("string"))).alias("name"), F.coalesce("sort_index", F.lit(0)).alias("sort_index")
    )
    thread_meta = meta.where("name IN ('thread_name', 'thread_sort_index')")
    named = thread_meta.groupBy("pid", "tid").agg(last("thread_name", "given").alias("name"), last("thread_sort_index", "index").alias("sort_index"))
    seen = events.where("phase NOT IN ('M', 'C')").select("pid", "tid").union(thread_meta.select("pid", "tid")).distinct()
    threads = seen.join(named, ["pid", "tid"], "left").select(
        "pid", "tid", F.coalesce("name", F.concat(F.lit("Thread "), F.col("tid").cast("string"))).alias("name"), F.coalesce("sort_index", F.lit(0)).alias("sort_index")
    )
    return processes, threads


def read_trace(spark: SparkSession, path: str, time_unit: str = "us", mode: str = "auto") -> Trace:
    everything = normalise(numbered(read_raw(spark, path, mode)), time_unit)
    processes, threads = dimensions(everything)
    events = everything.where("phase <> 'M'")
    return Trace(events, processes, threads, counters_of(events), everything.where("phase = 'M'"))
