"""Keys with very many rows cut into pieces of time, so that windows and groups stay bounded however long a series is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.plans.scratch import saved, unsaved

#: The column that tells a long key's pieces apart, in order of time; UNCUT for the rows of other keys. It is there only if some key is cut.
PIECE, UNCUT = "_piece", -1
#: Rows of a piece, about: keys with more are cut.
PIECE_ROWS = 1_000_000
#: Slots of time that are counted for each piece.
SLOTS = 64
#: Long keys are sent to all executors up to so many, and slots up to SLOTS times as many; beyond, they are joined by a shuffle.
FEW_KEYS = 100_000


def cut(df: DataFrame, keys: list[str], time: str = "ts", rows: int | None = None) -> DataFrame:
    """``df``, with PIECE if a key has more than ``rows`` rows.

    Runs a job that counts the keys' rows. A long key's time is cut into slots, which are counted; consecutive slots make
    pieces of about ``rows`` rows. Rows of one time are never cut apart. Times must not be null.
    """
    rows = rows or PIECE_ROWS
    long = saved(df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(time).alias("_low"), F.max(time).alias("_high")).where(F.col("_n") > rows), "long-keys")
    count = long.count()
    if not count:
        unsaved(long)
        return df
    few = F.broadcast if count <= FEW_KEYS else lambda d: d
    slots = F.ceil(F.col("_n") / rows) * SLOTS
    slot = F.least(F.floor(F.coalesce(F.try_divide(F.col(time) - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0)) * slots), slots - 1)
    placed = df.join(few(long), keys, "left").withColumn("_slot", slot.cast("long")).drop("_n", "_low", "_high")
    before = F.sum("count").over(Window.partitionBy(*keys).orderBy("_slot")) - F.col("count")
    pieces = saved(placed.where("_slot IS NOT NULL").groupBy(*keys, "_slot").count().select(*keys, "_slot", F.floor(before / rows).cast("long").alias(PIECE)), "pieces")
    return placed.join(few(pieces), [*keys, "_slot"], "left").withColumn(PIECE, F.coalesce(PIECE, F.lit(UNCUT).cast("long"))).drop("_slot")


def by_piece(df: DataFrame, keys: list[str]) -> list[str]:
    return [*keys, PIECE] if PIECE in df.columns else list(keys)


def counted_on(df: DataFrame, keys: list[str], place: str) -> DataFrame:
    """``df`` with ``place``, which counts a piece's rows, made to count on from one piece to the next."""
    if PIECE not in df.columns:
        return df
    sizes = df.groupBy(*keys, PIECE).agg(F.count("*").alias("_size"))
    starts = F.sum("_size").over(Window.partitionBy(*keys).orderBy(PIECE)) - F.col("_size")  # a row for each piece
    return df.join(sizes.select(*keys, PIECE, starts.alias("_start")), [*keys, PIECE]).withColumn(place, F.col(place) + F.col("_start")).drop("_start")


def beside(df: DataFrame, keys: list[str], order: list, **asked: tuple[str, str]) -> DataFrame:
    """``df`` with columns that tell of the rows before or after a row of its key in ``order``, whether the key is cut or not.

    asked: name -> (what, column). what: lag or lead, the column beside (never null in rows, so null means there is no row);
    last, the last value before or at the row that isn't null; max or sum, of the rows before. A piece is told what stands
    in the others by a table of a row for each piece.
    """
    within = Window.partitionBy(*by_piece(df, keys)).orderBy(*order)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    here, of_piece, across, both = {}, {}, {}, {}
    pieces = Window.partitionBy(*keys).orderBy(PIECE)
    ahead = pieces.rowsBetween(Window.unboundedPreceding, -1)
    for name, (what, column) in asked.items():
        c, part = F.col(column), F.col(f"_of_{name}")
        here[name] = {"lag": lambda c=c: F.lag(c).over(within), "lead": lambda c=c: F.lead(c).over(within), "last": lambda c=c: F.last(c, ignorenulls=True).over(within), "max": lambda c=c: F.max(c).over(before), "sum": lambda c=c: F.coalesce(F.sum(c).over(before), F.lit(0))}[what]()
        of_piece[name] = {"lag": F.max_by(c, rank), "lead": F.min_by(c, rank), "last": F.max_by(c, F.when(c.isNotNull(), rank)), "max": F.max(c), "sum": F.sum(c)}[what]
        across[name] = {"lag": lambda p=part: F.lag(p).over(pieces), "lead": lambda p=part: F.lead(p).over(pieces), "last": lambda p=part: F.last(p, ignorenulls=True).over(ahead), "max": lambda p=part: F.max(p).over(ahead), "sum": lambda p=part: F.sum(p).over(ahead)}[what]()
        own, other = F.col(name), F.col(f"_to_{name}")
        both[name] = {"max": F.greatest(own, other), "sum": own + F.coalesce(other, F.lit(0))}.get(what, F.coalesce(own, other))
    out = df.withColumns(here)
    if PIECE not in df.columns:
        return out
    parts = df.groupBy(*keys, PIECE).agg(*[c.alias(f"_of_{n}") for n, c in of_piece.items()])
    told = parts.select(*keys, PIECE, *[c.alias(f"_to_{n}") for n, c in across.items()])
    same = [F.col(f"df.{k}").eqNullSafe(F.col(f"told.{k}")) for k in [*keys, PIECE]]
    met: Column = same[0]
    for s in same[1:]:
        met = met & s
    return out.alias("df").join(told.alias("told"), met, "left").select("df.*", *[f"_to_{n}" for n in asked]).withColumns(both).drop(*[f"_to_{n}" for n in asked])
