"""Sources: text lines, rows in memory, tables, JDBC, JSON lines, and several sources in a row."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.functions.values import json_fields
from weir.operators.fan import union
from weir.operators.recorder import Recorder
from weir.plans.monitor import Monitor
from weir.sources.storage import connected


def lines(spark: SparkSession, paths: str | Iterable[str], name: str = "line") -> DataFrame:
    """Text lines of one or more files."""
    return spark.read.text(paths if isinstance(paths, str) else list(paths)).select(F.col("value").alias(name))


def rows(spark: SparkSession, items: Iterable, schema: str | T.StructType) -> DataFrame:
    """Rows in memory. A single post is a list of one."""
    return spark.createDataFrame(list(items), schema)


def post(spark: SparkSession, item: tuple, schema: str | T.StructType) -> DataFrame:
    return rows(spark, [item], schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jdbc(spark: SparkSession, url: str, table: str, *, partition: tuple[str, int, int, int] | None = None, options: Mapping[str, str] | None = None) -> DataFrame:
    """A table over JDBC. partition: (column, lower, upper, parts) for a parallel read."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**(options or {}))
    if partition:
        column, low, high, parts = partition
        r = r.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return r.load()


def identity_column(spark: SparkSession, url: str, table: str, options: Mapping[str, str] | None = None) -> str | None:
    """The column of a database table that the database numbers itself, or None."""
    with connected(spark, url, options) as connection:
        found = connection.getMetaData().getColumns(None, None, table, None)
        while found.next():
            if found.getString("IS_AUTOINCREMENT") == "YES":
                return found.getString("COLUMN_NAME")
    return None


def json_lines(df: DataFrame, schema: str, column: str = "line") -> DataFrame:
    """Lines of lenient JSON as columns; a malformed line fails the flow, a missing field is null."""
    return df.select(json_fields(column, schema).alias("__j")).select("__j.*")


def each(*dfs: DataFrame) -> DataFrame:
    """Several sources one after the other; the order of rows is not kept."""
    return union(*dfs)


def tagged(**dfs: DataFrame) -> DataFrame:
    """Several sources as (src, *) with the name of each; columns that a source lacks are null."""
    out = None
    for name, df in dfs.items():
        df = df.withColumn("src", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source")
    return out


class LogReader:
    """Lines of text logs, parsed by one stage and counted by a recorder that must be given."""

    def __init__(self, parse: Callable[[DataFrame], DataFrame], recorder: Recorder, level1: str = "level1", level2: str | None = None, entity: str = "line"):
        self.parse, self.recorder, self.level1, self.level2, self.entity = parse, recorder, level1, level2, entity

    def process(self, df: DataFrame) -> int:
        """Parse and count all lines in one scan; gives the number of lines read. A line that cannot be parsed fails it."""
        seen = Monitor(self.entity)
        self.recorder.record_events(self.parse(seen.watch(df, "lines")), self.level1, self.level2)
        n = seen.counted("lines")
        n = df.count() if n is None else n
        self.recorder.record_entity(self.entity, n)
        return n

    def process_files(self, spark: SparkSession, paths: Iterable[str]) -> int:
        return self.process(lines(spark, paths))
