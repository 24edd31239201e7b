"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    """The application's folder below spark.checkpoint.dir; in local mode, where it is unset, below a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        app = spark.sparkContext.applicationId
        if app not in _own:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            _own[app] = tempfile.mkdtemp(prefix="spanframe-")
        root = _own[app]
    return f"{root.rstrip('/')}/spanframe/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below spark.checkpoint.dir and read it back, which cuts lineage and outlives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def unsaved(*tables: DataFrame) -> None:
    """Remove tables that saved() wrote, once nothing that may still run reads them."""
    for df in tables:
        _delete(df.sparkSession, df._saved_at)


def clear(spark: SparkSession) -> None:
    """Remove all that this application has left below spark.checkpoint.dir, once no result that reads it is needed any more."""
    _delete(spark, _folder(spark))
