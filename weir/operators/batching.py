"""Batches of a fixed number of rows, the last one partial, without pulling all rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weir.sources.storage import stored

BATCH = 8192


def numbered(df: DataFrame, order: str, name: str = "n") -> DataFrame:
    """Rows with their place (0, 1, ...) in the order of a column.

    The rows are range-partitioned and stored, numbered inside each partition, and shifted by the sizes of the
    partitions before; only those sizes (one for each partition) meet in one task. They are stored since the ranges come
    from a sample, which a second run of the plan may draw anew. Of equal values the order is any; they are dealt by
    where they come from, so a value that most rows have fills more than one task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64(F.monotonically_increasing_id())
    dealt = stored(df.repartitionByRange(parts, F.col(order).asc_nulls_first(), tie).withColumn("__part", F.spark_partition_id()))
    local = dealt.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(F.col(order).asc_nulls_first())) - 1)
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))
    return local.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__at") + F.col("__before")).drop("__part", "__at", "__before")


def batched(df: DataFrame, order: str, size: int = BATCH, name: str = "batch_id") -> DataFrame:
    """Rows with the number of their batch of `size` rows in the order of a column."""
    if size < 1:
        raise ValueError("a batch has at least one row")
    return numbered(df, order, "__n").withColumn(name, F.floor(F.col("__n") / size).cast("bigint")).drop("__n")
