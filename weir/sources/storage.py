"""The shared folder for checkpoints and staging, and writes that are published in one step."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; set only where there is none, as in tests."""
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
        spark.sparkContext.setCheckpointDir(named or "/tmp/checkpoints")
    return jsc.getCheckpointDir().get()


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write rows to the shared folder and read them back: lineage is cut, lost executors cost nothing before it, and
    what is not deterministic (sampled ranges, partition numbers) is settled."""
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def connected(spark: SparkSession, url: str, options: Mapping[str, str] | None = None) -> Iterator[object]:
    """The driver's own connection to a database, with the user, password and other properties that Spark's writer gets."""
    properties = spark._jvm.java.util.Properties()
    for k, v in (options or {}).items():
        properties.setProperty(k, str(v))
    if driver := (options or {}).get("driver"):
        spark._jvm.java.lang.Class.forName(driver, True, spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())
    connection = spark._jvm.java.sql.DriverManager.getConnection(url, properties)
    try:
        yield connection
    finally:
        connection.close()


def quoted(spark: SparkSession, url: str, name: str) -> str:
    """A column name as Spark's writer quotes it for this database."""
    return spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(name)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move a directory inside a file system; one step on HDFS and local disks."""
    a, fs = _path(spark, source)
    b, _ = _path(spark, target)
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"cannot rename {source} to {target}")
