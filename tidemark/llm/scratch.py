"""Tables that cut lineage: Parquet folders below ``spark.checkpoint.dir``."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_own: list[str] = []
#: Tables written in the stage that is under way, if one is.
_stage: ContextVar[list[DataFrame] | None] = ContextVar("stage", default=None)


def base(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; where none is set a temporary one, but only on a local master (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: a folder that all executors share is needed")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="tidemark-"))
        path = _own[0]
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new shared table and read it back, so that no later job recomputes it."""
    spark = df.sparkSession
    path = f"{base(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._scratch_path = path
    if (tables := _stage.get()) is not None:
        tables.append(out)
    return out


def alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that ``make`` gives, written; whatever else it has written on the way is removed."""
    out, tables = None, []
    token = _stage.set(tables)
    try:
        out = written(make(), name)
    finally:
        _stage.reset(token)
        for t in tables:
            if t is not out:
                remove(t)
    return out


def remove(table: DataFrame) -> None:
    """Delete a table of ``written`` that no plan reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of jobs whose plans are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
