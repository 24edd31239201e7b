"""Places of rows within a key in order of time, without a window over all of a long key's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanframe.plans.pieces import PIECE, beside, by_piece, counted_on, cut


def placed(df: DataFrame, key: str, time: str = "ts", row: str = "event_id", piece_rows: int | None = None) -> DataFrame:
    """``df`` with n, the place of each row within ``key`` by time and then ``row``, and prev and next, the rows beside it.

    Keys of very many rows are cut into pieces of time (pieces.cut). Times and ``row`` must not be null.
    """
    rows = cut(df, [key], time, piece_rows)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*by_piece(rows, [key])).orderBy(time, row)).cast("long"))
    rows = beside(counted_on(rows, [key], "n"), [key], [time, row], prev=("lag", row), next=("lead", row))
    return rows.drop(PIECE)
