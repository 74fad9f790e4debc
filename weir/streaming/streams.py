"""The same stages on streams: bulk sinks by micro-batch, lookup with inserts, keyed sums, stopping when idle."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weir.operators.lookup import Lookup
from weir.operators.stage import Transform
from weir.sources.sinks import FLUSH_SECONDS
from weir.sources.storage import delete, exists, rename, staging_path


def read(spark: SparkSession, path: str, schema: str, format: str = "parquet", max_files: int | None = None) -> DataFrame:
    """A stream of the files of a directory. max_files bounds a micro-batch: the stream's back-pressure."""
    r = spark.readStream.format(format).schema(schema)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).load(path)


def drain(df: DataFrame, consume: Callable[[DataFrame, int], None], checkpoint: str, name: str | None = None, mode: str = "append") -> None:
    """Feed all there is now to a consumer in micro-batches, then stop. A restart goes on where it ended."""
    w = df.writeStream.foreachBatch(consume).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    (w.queryName(name) if name else w).start().awaitTermination()


def follow(df: DataFrame, consume: Callable[[DataFrame, int], None], checkpoint: str, seconds: float = FLUSH_SECONDS, mode: str = "append") -> StreamingQuery:
    """Feed a consumer every so many seconds with what has come, be it little: the flush interval of a bulk sink."""
    return df.writeStream.foreachBatch(consume).option("checkpointLocation", checkpoint).outputMode(mode).trigger(processingTime=f"{seconds} seconds").start()


def flush(query: StreamingQuery) -> None:
    """Wait until what has come so far is written, at the stream's own intervals."""
    query.processAllAvailable()


class Follower:
    """A followed stream that can be flushed between its intervals: a partial batch is written at once."""

    def __init__(self, df: DataFrame, consume: Callable[[DataFrame, int], None], checkpoint: str, seconds: float = FLUSH_SECONDS, mode: str = "append"):
        self._args = (df, consume, checkpoint)
        self.seconds, self.mode = seconds, mode
        self.query = follow(*self._args, seconds, mode)

    def flush(self) -> None:
        """Write what has come so far, now: the stream is drained from where it is, and followed again."""
        self.stop()
        drain(*self._args, mode=self.mode)
        self.query = follow(*self._args, self.seconds, self.mode)

    def stop(self) -> None:
        """Stop after the micro-batch that is running, if one is."""
        while self.query.isActive and self.query.status["isTriggerActive"]:
            time.sleep(0.05)
        self.query.stop()


def stop_when_idle(query: StreamingQuery, timeout: float, poll: float = 0.2) -> bool:
    """Stop a stream that no row has reached for `timeout` seconds. True if it was stopped, False if it had ended."""
    last, since = None, time.monotonic()
    while query.isActive:
        p = query.lastProgress
        seen = (p["batchId"], p["numInputRows"]) if p else None
        busy = query.status["isTriggerActive"] and query.status["isDataAvailable"]
        if busy or (p and p["numInputRows"] and seen != last):
            since = time.monotonic()
        last = seen
        if time.monotonic() - since >= timeout:
            query.stop()
            return True
        time.sleep(poll)
    if query.exception():
        raise query.exception()
    return False


def auto_complete(spark: SparkSession, seed: DataFrame, step: Transform, folder: str, timeout: float, schema: str) -> DataFrame:
    """A loop through a directory: rows that the step gives are fed back, until none has come for `timeout` seconds.

    Returns all rows that went round. Every micro-batch writes its files under its own number, so a replay after a
    failure repeats none.
    """
    seed.write.mode("overwrite").parquet(f"{folder}/ring/batch=-1")

    def turn(batch: DataFrame, number: int) -> None:
        out = step(batch)
        if not out.isEmpty():
            path = f"{folder}/ring/batch={number}"
            staged = f"{folder}/staged-{number}"
            out.write.mode("overwrite").parquet(staged)
            if exists(spark, path):
                delete(spark, path)
            rename(spark, staged, path)

    stream = spark.readStream.schema(schema).parquet(f"{folder}/ring/batch=*")
    query = stream.writeStream.foreachBatch(turn).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime="100 milliseconds").start()
    stop_when_idle(query, timeout)
    return spark.read.schema(schema).parquet(f"{folder}/ring/batch=*")


def keyed_sum(df: DataFrame, key: str, value: Column, checkpoint: str, name: str = "total") -> DataFrame:
    """(key, n, name) of a whole stream, kept in the state store and written out in full at the end of each batch."""
    spark, out = df.sparkSession, staging_path(df.sparkSession, "keyed-sum")
    total = df.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias(name))
    drain(total, lambda batch, _: batch.write.mode("overwrite").parquet(out), checkpoint, mode="complete")
    return spark.read.parquet(out) if exists(spark, out) else spark.createDataFrame([], total.schema)


class LookupStream:
    """Lookup-or-insert on a stream. The dimension is a directory with a subdirectory for each micro-batch's new rows.

    Micro-batches of one query never overlap; two queries must not share a dimension. Since a batch may be replayed, its
    subdirectory is replaced as a whole, and left out when the batch looks keys up again. Columns of the dimension that
    a new row has no attribute for are null in it.
    """

    def __init__(self, lookup: Lookup, dimension_path: str, sink: Callable[[DataFrame, int], None]):
        self.lookup, self.path, self.sink = lookup, dimension_path, sink

    def dimension(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        df = spark.read.option("basePath", self.path).parquet(self.path)
        return (df if before is None else df.filter(F.col("batch") < before)).drop("batch")

    def create(self, dim: DataFrame) -> None:
        dim.write.mode("overwrite").parquet(f"{self.path}/batch=-1")

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        try:
            dim = self.dimension(spark, number)
            new = self.lookup.new_rows(rows, dim)
            staged = staging_path(spark, "dimension")
            new.write.parquet(staged)
            added = spark.read.schema(new.schema).parquet(staged)
            if not added.isEmpty():
                path = f"{self.path}/batch={number}"
                if exists(spark, path):
                    delete(spark, path)
                dim.limit(0).unionByName(added, allowMissingColumns=True).select(*dim.columns).write.parquet(path)
            full = dim.unionByName(added, allowMissingColumns=True)
            self.sink(self.lookup._join(rows, full, None), number)
        finally:
            rows.unpersist()
