"""Tables that cut lineage: Parquet folders under the session's checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``.

    Where no folder is set a temporary one serves, but only on a local master (tests): executors elsewhere would not share it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: a folder that all executors share is needed")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="tidemark-"))
        base = _own[0]
    return f"{base.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new table under ``spark.checkpoint.dir`` and read back."""
    path, schema = folder(df.sparkSession, name), df.schema
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._kept_path = path
    return out


def drop(table: DataFrame) -> None:
    """Delete a table of ``kept`` that no plan reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._kept_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
