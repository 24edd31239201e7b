"""SQL over a trace: views, a console call with a row cap, and a query builder."""

from __future__ import annotations

from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.sources.trace_json import Trace

VIEWS = ["events", "processes", "threads", "counters"]


def register(trace: Trace, spans: DataFrame | None = None) -> None:
    """Temp views of the four tables; with ``spans``, events has depth, parent and self time and lacks matched ends."""
    events = trace.events.withColumn("end_ts", F.col("ts") + F.col("dur")) if spans is None else spans.where("NOT is_end")
    for name, df in zip(VIEWS, (events, trace.processes, trace.threads, trace.counters)):
        df.createOrReplaceTempView(name)


@dataclass
class Answer:
    rows: DataFrame | None = None
    error: str = ""
    truncated: bool = False


def run_sql(spark: SparkSession, text: str, cap: int | None = 10_000) -> Answer:
    """The query's rows, at most ``cap`` of them and whether there are more; or what is wrong with it.

    Without a cap nothing runs here, so only what can be told before running is told as an error.
    """
    try:
        rows = spark.sql(text)
        if cap is None:
            return Answer(rows)
        found = rows.limit(cap + 1).toArrow()  # runs once; all columns are worked out, so errors show here
        return Answer(spark.createDataFrame(found.slice(0, cap), rows.schema), truncated=found.num_rows > cap)
    except (PySparkException, Py4JJavaError) as e:  # what can't be parsed or resolved, and what fails as it runs
        return Answer(error=str(e))


#: The columns that tell a view's rows apart.
KEYS = {"events": ["event_id"], "processes": ["pid"], "threads": ["tid", "pid"], "counters": []}


def describe_views(spark: SparkSession) -> DataFrame:
    """(view, column, type, is_key, rows) of the registered views; rows: how many the view has."""
    there = [v for v in VIEWS if spark.catalog.tableExists(v)]
    columns = [(v, c.name, c.dataType, c.name in KEYS[v]) for v in there for c in spark.catalog.listColumns(v)]
    out = spark.createDataFrame(columns, "view string, column string, type string, is_key boolean")
    counts = None
    for v in there:
        one = spark.table(v).agg(F.count("*").alias("rows")).select(F.lit(v).alias("view"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    return out.join(F.broadcast(counts), "view") if counts is not None else out.withColumn("rows", F.lit(0).cast("long"))  # four rows at most


def row_counts(trace: Trace) -> DataFrame:
    out = None
    for name, df in zip(VIEWS, (trace.events, trace.processes, trace.threads, trace.counters)):
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("view"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@dataclass
class QuerySpec:
    """select: columns, or (function, column, alias); where: (column, operator, value, "AND" or "OR" before it)."""

    source: str
    select: list = field(default_factory=list)
    where: list[tuple] = field(default_factory=list)
    group_by: list[str] = field(default_factory=list)
    having: list[tuple] = field(default_factory=list)
    order_by: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = 50

    def to_df(self, views: dict[str, DataFrame]) -> DataFrame:
        df = views[self.source]
        if (condition := self._conditions(self.where)) is not None:
            df = df.where(condition)
        plain = [s for s in self.select if isinstance(s, str)]
        aggregates = [getattr(F, f.lower())(c).alias(a) for f, c, a in (s for s in self.select if not isinstance(s, str))]
        if self.group_by or aggregates:
            df = df.groupBy(*self.group_by).agg(*aggregates)
            if self.group_by and (condition := self._conditions(self.having)) is not None:
                df = df.where(condition)
            df = df.select(*[s if isinstance(s, str) else s[2] for s in self.select])
        elif plain:
            df = df.select(*plain)
        if self.order_by:
            df = df.orderBy(*[F.asc(c) if up else F.desc(c) for c, up in self.order_by])
        return df.limit(self.limit) if self.limit is not None else df

    @staticmethod
    def _conditions(terms: list[tuple]) -> Column | None:
        """AND binds before OR, as in SQL."""
        groups: list[Column] = []
        for term in terms:
            column, op, value, *word = term
            one = _compare(F.col(column), op.upper(), value)
            if groups and (not word or word[0].upper() == "AND"):
                groups[-1] = groups[-1] & one
            else:
                groups.append(one)
        out = None
        for g in groups:
            out = g if out is None else out | g
        return out

    def to_sql(self) -> str:
        items = [s if isinstance(s, str) else f"{s[0].upper()}({s[1]}) AS {s[2]}" for s in self.select] or ["*"]
        term = lambda t: f"{t[0]} {t[1]}" + ("" if t[1].upper().startswith("IS ") else " " + _literal(t[2]))
        chain = lambda ts: "".join((f" {(t[3] if len(t) > 3 else 'AND').upper()} " if i else "") + term(t) for i, t in enumerate(ts))
        out = f"SELECT {', '.join(items)} FROM {self.source}"
        if self.where:
            out += f" WHERE {chain(self.where)}"
        if self.group_by:
            out += f" GROUP BY {', '.join(self.group_by)}"
            if self.having:
                out += f" HAVING {chain(self.having)}"
        if self.order_by:
            out += " ORDER BY " + ", ".join(f"{c} {'ASC' if up else 'DESC'}" for c, up in self.order_by)
        return out + (f" LIMIT {self.limit}" if self.limit is not None else "")


def _literal(value: object) -> str:
    if isinstance(value, (list, tuple)):
        return "(" + ", ".join(map(_literal, value)) + ")"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def _compare(c: Column, op: str, value: object) -> Column:
    match op:
        case "=":
            return c == value
        case "!=":
            return c != value
        case "<":
            return c < value
        case ">":
            return c > value
        case "<=":
            return c <= value
        case ">=":
            return c >= value
        case "LIKE":
            return c.ilike(value)
        case "NOT LIKE":
            return ~c.ilike(value)
        case "IN":
            return c.isin(*value)
        case "IS NULL":
            return c.isNull()
        case "IS NOT NULL":
            return c.isNotNull()
    raise ValueError(f"no such operator: {op}")
