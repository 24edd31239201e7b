"""Columns of the engine's tables."""

from pyspark.sql import types as T

#: A raw event as the JSON text has it; ids stay text so that 64 bits keep their digits, args stay raw JSON.
RAW = T.StructType([T.StructField(n, t) for n, t in (
    ("name", T.StringType()), ("cat", T.StringType()), ("ph", T.StringType()), ("ts", T.DoubleType()), ("dur", T.DoubleType()),
    ("pid", T.StringType()), ("tid", T.StringType()), ("id", T.StringType()), ("args", T.StringType()),
)])

EVENT_COLUMNS = ["event_id", "name", "category", "phase", "ts", "dur", "pid", "tid", "id", "args"]
SPAN_COLUMNS = [*EVENT_COLUMNS, "end_ts", "is_end", "in_thread", "seq", "depth", "parent_id", "last_seq", "path_id", "above_id", "self_time", "child_time", "self_pct"]
