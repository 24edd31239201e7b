"""Flame graphs: call paths of names and categories with their times, for each thread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.operators.filters import visible
from spanframe.plans.nesting import ROOT
from spanframe.plans.scratch import saved, unsaved

#: Between a name and its category, and between the steps of a path, in path, which is for reading; keys tells paths apart.
OF, STEP = "|", " > "


def _next(last: DataFrame, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the place of the one that it was made from."""
    out = saved(df, name)
    unsaved(last)
    return out


def _keys(rows: DataFrame, hide_categories=()) -> DataFrame:
    """(path_id, keys, vid, up): a path's visible steps, their hash, and the hash of those above its last; a row for each path.

    A path knows the one above it; each round joins a path to where the round before has led, so steps double. ``depth``
    tells how many rounds that takes.
    """
    steps = F.array(F.struct("name", "category"))
    shown = F.when(F.col("category").isin(*hide_categories), F.slice(steps, 1, 0)).otherwise(steps) if hide_categories else steps
    above = lambda c: F.when(F.col(c) != ROOT, F.col(c))
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    known = rows.groupBy("path_id").agg(F.first("above_id").alias("above_id"), F.first("name").alias("name"), F.first("category").alias("category")).select("path_id", above("above_id").alias("to"), shown.alias("keys"))
    known = saved(known, "flame-paths")
    for _ in range(deepest.bit_length()):
        ahead = known.select(F.col("path_id").alias("to"), F.col("to").alias("further"), F.col("keys").alias("before"))
        longer = known.join(ahead, "to", "left").select("path_id", F.col("further").alias("to"), F.concat(F.coalesce("before", F.slice("keys", 1, 0)), "keys").alias("keys"))
        known = _next(known, longer, "flame-paths")
    return known.select("path_id", "keys", F.xxhash64("keys").alias("vid"), F.when(F.size("keys") > 1, F.xxhash64(F.slice("keys", F.lit(1), F.size("keys") - 1))).alias("up"))


def _uncalled(nodes: DataFrame) -> DataFrame:
    """(pid, tid, vid, below): of the nodes without calls, the time of the called ones below with none called between.

    Only called nodes right under one without calls have any to tell: each names the paths above it, by their hashes, up to
    the nearest called one.
    """
    bare = nodes.where("calls = 0").select("pid", "tid", F.col("vid").alias("up"))
    under = nodes.where("calls > 0").select("pid", "tid", F.col("vid").alias("of"), "up", "keys", "own").join(bare, ["pid", "tid", "up"], "left_semi")
    prefixes = F.transform(F.sequence(F.lit(1), F.size("keys") - 1), lambda k: F.xxhash64(F.slice("keys", F.lit(1), k)))
    above = under.select("pid", "tid", "of", "own", F.posexplode(prefixes).alias("level", "vid")).join(nodes.select("pid", "tid", "vid", "calls"), ["pid", "tid", "vid"])
    chain = above.groupBy("pid", "tid", "of").agg(F.first("own").alias("own"), F.collect_list(F.struct("level", "vid")).alias("all"), F.coalesce(F.max(F.when(F.col("calls") > 0, F.col("level"))), F.lit(-1)).alias("called"))
    told = chain.select("pid", "tid", "own", F.explode(F.filter("all", lambda a: a["level"] > F.col("called"))).alias("a"))
    return told.groupBy("pid", "tid", F.col("a.vid").alias("vid")).agg(F.sum("own").alias("below"))


def flame(spans: DataFrame, start: float, end: float, hide_pids=(), hide_tids=(), hide_categories=()) -> DataFrame:
    """(pid, tid, keys, path, level, calls, total, self_total) of the paths in [start, end].

    keys: the path's steps as structs of name and category; path: the same as text, which may be alike for several keys.

    Ancestors of hidden categories are skipped, not cut. A path without calls of its own has the sum of its children as
    total. Paths under a root whose total isn't positive are left out. One shuffle counts the spans by thread and path
    number; all else is work on paths, each of which is there once, and joins are by numbers.
    """
    rows = visible(spans, hide_pids, hide_tids).where("in_thread")
    part = F.least("end_ts", F.lit(end)) - F.greatest("ts", F.lit(start))
    counts = F.col("phase").isin("X", "B") & (F.col("dur") > 0) & (F.col("ts") <= end) & (F.col("end_ts") >= start) & (part > 0)
    firsts = [F.first(c).alias(c) for c in ("above_id", "name", "category", "depth")]
    found = saved(rows.groupBy("pid", "tid", "path_id").agg(*firsts, F.count(F.when(counts & _shown(hide_categories), 1)).alias("calls"), F.sum(F.when(counts & _shown(hide_categories), part)).alias("own")), "flame-found")
    keys = _keys(found, hide_categories)
    met = found.where(_shown(hide_categories)).join(keys, "path_id")
    nodes = met.groupBy("pid", "tid", "vid").agg(F.first("up").alias("up"), F.first("keys").alias("keys"), F.sum("calls").alias("calls"), F.coalesce(F.sum("own"), F.lit(0.0)).alias("own"))
    nodes = saved(nodes, "flame-nodes")
    if nodes.where("calls = 0").take(1):
        nodes = nodes.join(_uncalled(nodes), ["pid", "tid", "vid"], "left").withColumn("total", F.when(F.col("calls") > 0, F.col("own")).otherwise(F.col("below")))
    else:
        nodes = nodes.withColumn("total", F.col("own"))
    kids = nodes.where("up IS NOT NULL").groupBy("pid", "tid", F.col("up").alias("vid")).agg(F.sum("total").alias("kids"))
    out = nodes.where("total > 0").join(kids, ["pid", "tid", "vid"], "left")
    told = F.array_join(F.transform("keys", lambda p: F.concat(p["name"], F.lit(OF), p["category"])), STEP)
    return out.select("pid", "tid", "keys", told.alias("path"), F.size("keys").alias("level"), "calls", "total", F.greatest(F.lit(0.0), F.col("total") - F.coalesce("kids", F.lit(0.0))).alias("self_total"))


def _shown(hide_categories) -> Column:
    return ~F.col("category").isin(*hide_categories) if hide_categories else F.lit(True)


def flame_zoom(nodes: DataFrame, pid: int, tid: int, path: str | list[tuple[str, str]]) -> DataFrame:
    """The nodes at and under a path, with their share of its total and their average.

    path: (name, category) of each step; or the path's text, which takes all keys of that text together.
    """
    thread = nodes.where((F.col("pid") == pid) & (F.col("tid") == tid))
    if isinstance(path, str):
        at, under = F.col("path") == path, (F.col("path") == path) | F.col("path").startswith(path + STEP)
    else:
        keys = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).alias("category")) for n, c in path])
        at, under = F.col("keys") == keys, F.slice("keys", 1, len(path)) == keys
    root = thread.where(at).agg(F.sum("total").alias("_root"))  # one row
    return thread.where(under).join(F.broadcast(root)).withColumn("share", F.try_divide("total", "_root")).withColumn("avg", F.try_divide("total", "calls")).drop("_root")
