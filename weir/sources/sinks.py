"""Sinks: eager and whole-flow bulk writes, a sink for each key, hooks, null and error targets, text files by key."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.errors import MappingError
from weir.operators.batching import BATCH
from weir.operators.fan import Dispatcher
from weir.operators.mapping import Accessor, TargetTable
from weir.operators.recorder import Recorder
from weir.operators.router import fail_on_rows
from weir.sources.storage import connected, delete, exists, quoted, rename, staging_path, stored

PostWrite = Callable[[TargetTable, DataFrame], None]
#: Batches of an eager sink that one job writes.
WAVE = 64
_BATCH = "__batch"
#: Seconds after which a streaming bulk sink writes a partial batch.
FLUSH_SECONDS = 10


@dataclass
class BulkSink:
    """Writes a DataFrame, mapped to the target's columns, and then calls the hook.

    eager: the rows go in batches of `batch` rows, cut inside the partitions that they come in, and each is a transaction
    of its own: earlier batches stay when a later one fails, be it in the mapping, the write or the hook, and the hook
    gets each batch once it is committed. Batches are written in waves of WAVE, each wave a job; a wave that fails is
    done again batch by batch, up to the one that fails.
    Otherwise one transaction holds the whole flow: rows are staged first and published in one step once all of them
    and the hook have succeeded; after a failure none is seen.
    """

    target: TargetTable
    accessor: Accessor | None = None
    eager: bool = False
    batch: int = BATCH
    format: str = "parquet"
    post_write: PostWrite | None = None
    options: Mapping[str, str] = field(default_factory=dict)
    _committed: bool = field(default=False, init=False, repr=False)

    def __call__(self, df: DataFrame) -> None:
        self.write(df)

    def rows(self, df: DataFrame) -> DataFrame:
        return self.accessor.apply(df) if self.accessor else df

    def write(self, df: DataFrame) -> None:
        jdbc = self.target.url.startswith("jdbc:")
        if self.eager:
            self._eager(df, self._jdbc_wave if jdbc else self._path_wave)
        else:
            (self._jdbc_whole if jdbc else self._path_whole)(self.rows(df))

    def _eager(self, df: DataFrame, wave: Callable[[DataFrame, list[int]], None]) -> None:
        """Rows are stored with their batch first, so that a batch is the same rows each time it is read."""
        at = F.monotonically_increasing_id()  # partition << 33 | place in it
        part, place = F.shiftright(at, 33), at.bitwiseAND(F.lit((1 << 33) - 1))
        rows = stored(df.withColumn(_BATCH, part * F.lit(1 << 24) + F.floor(place / self.batch)), "batches")
        try:
            numbers = sorted(r[0] for r in rows.select(_BATCH).distinct().collect())
            if not numbers and wave == self._path_wave:  # so that the target can be read
                self.rows(df.limit(0)).write.mode("append").options(**self.options).format(self.format).save(self.path)
            for k in range(0, len(numbers), WAVE):
                some = numbers[k : k + WAVE]
                try:
                    wave(rows, some)
                except Exception:
                    if len(some) == 1 or self._committed:
                        raise
                    for one in some:
                        wave(rows, [one])
                self._committed = False
        finally:
            self._committed = False

    def _of(self, rows: DataFrame, numbers: list[int]) -> DataFrame:
        return rows.filter(F.col(_BATCH).isin(numbers))

    # ---- files

    @property
    def path(self) -> str:
        return f"{self.target.url.rstrip('/')}/{self.target.name}" if self.target.name else self.target.url

    def _path_wave(self, rows: DataFrame, numbers: list[int]) -> None:
        """One job stages the batches side by side; each is published by a rename of its own, in order."""
        spark = rows.sparkSession
        staged = f"{self.path}/_staging-{staging_path(spark, 'x').rsplit('-', 1)[1]}"
        try:
            some = self._of(rows, numbers)
            mapped = self.accessor.apply(some, keep=(_BATCH,)) if self.accessor else some
            mapped.write.options(**self.options).partitionBy(_BATCH).format(self.format).save(staged)
            schema = mapped.drop(_BATCH).schema
            for n in numbers:
                self._publish(spark, f"{staged}/{_BATCH}={n}", schema)
        finally:
            if exists(spark, staged):
                delete(spark, staged)

    def _publish(self, spark: SparkSession, folder: str, schema) -> None:
        path = f"{self.path}/batch-{staging_path(spark, 'x').rsplit('-', 1)[1]}"
        rename(spark, folder, path)
        self._committed = True
        if self.post_write:
            self.post_write(self.target, spark.read.format(self.format).schema(schema).load(path))

    def _path_whole(self, rows: DataFrame) -> None:
        """Stage beside the target, so that publishing is a rename of one directory inside one file system."""
        spark = rows.sparkSession
        part = f"flow-{staging_path(spark, 'x').rsplit('-', 1)[1]}"
        staged = f"{self.path}/_staging-{part}"
        try:
            rows.write.options(**self.options).format(self.format).save(staged)
            if self.post_write:
                self.post_write(self.target, spark.read.format(self.format).schema(rows.schema).load(staged))
            rename(spark, staged, f"{self.path}/{part}")
        except BaseException:
            if exists(spark, staged):
                delete(spark, staged)
            raise

    def read(self, spark: SparkSession) -> DataFrame:
        """All published rows of the target."""
        return spark.read.format(self.format).option("recursiveFileLookup", "true").load(self.path)

    # ---- databases

    def _writer(self, rows: DataFrame, table: str):
        return rows.write.format("jdbc").option("url", self.target.url).option("dbtable", table).option("batchsize", self.batch).options(**self.options)

    def _jdbc_wave(self, rows: DataFrame, numbers: list[int]) -> None:
        """Each batch is one partition, which Spark's writer commits by itself. With a hook, a job for each batch."""
        if self.post_write:
            for n in numbers:
                one = self.rows(self._of(rows, [n]).drop(_BATCH))
                self._writer(one.coalesce(1), self.target.name).mode("append").save()
                self._committed = True
                self.post_write(self.target, one)
            return
        place = F.array_position(F.array(*map(F.lit, numbers)), F.col(_BATCH)).cast("int") - 1
        some = self._of(rows, numbers).repartitionById(len(numbers), place) if len(numbers) > 1 else self._of(rows, numbers).coalesce(1)
        self._committed = True  # some partitions may be in when another fails, so the wave can't be done again
        self._writer(self.rows(some.drop(_BATCH)), self.target.name).mode("append").save()

    def _jdbc_whole(self, rows: DataFrame) -> None:
        """Tasks fill a staging table; one INSERT ... SELECT in one transaction publishes it.

        The driver connects with the same user, password and properties as the tasks. Columns of the target are found
        without regard to case, and named in the database's own quotes.
        """
        spark, url = rows.sparkSession, self.target.url
        staged = f"STAGE_{staging_path(spark, 'x').rsplit('-', 1)[1][:16].upper()}"
        there = {f.name.lower(): f.name for f in spark.read.format("jdbc").option("url", url).option("dbtable", self.target.name).options(**self.options).load().schema.fields}
        if unknown := [c for c in rows.columns if c.lower() not in there]:
            raise MappingError(f"the target has no column {unknown[0]!r}")
        into, names = (", ".join(quoted(spark, url, c) for c in cols) for cols in ([there[c.lower()] for c in rows.columns], rows.columns))
        try:
            self._writer(rows, staged).mode("errorifexists").save()
            with connected(spark, url, self.options) as connection:
                try:
                    connection.setAutoCommit(False)
                    connection.createStatement().executeUpdate(f"INSERT INTO {self.target.name} ({into}) SELECT {names} FROM {staged}")
                    if self.post_write:
                        self.post_write(self.target, rows)
                    connection.commit()
                except BaseException:
                    connection.rollback()
                    raise
        finally:
            self._drop(spark, staged)

    def _drop(self, spark: SparkSession, table: str) -> None:
        with connected(spark, self.target.url, self.options) as connection:
            if connection.getMetaData().getTables(None, None, table, None).next():
                connection.createStatement().executeUpdate(f"DROP TABLE {table}")


@dataclass
class MultiSink:
    """Rows to a sink of their own for each key; `sink_of` gives a key's sink and is called once for each.

    Where all sinks are files of one format, without a mapping or a hook, the rows of all keys are written in one pass
    into a directory for each key, and each is then moved to its sink. Otherwise each sink has a job of its own.
    """

    key: Column | str
    sink_of: Callable[[object], BulkSink]

    def __call__(self, df: DataFrame) -> None:
        spark = df.sparkSession
        rows = stored(Dispatcher(df, self.key).keyed(_BATCH), "multi")
        each = Dispatcher(rows, _BATCH)
        sinks = {k: self.sink_of(k) for k in each.keys()}
        plain = [s for s in sinks.values() if isinstance(s, BulkSink) and not s.target.url.startswith("jdbc:") and not s.accessor and not s.post_write]
        if len(plain) < len(sinks) or len({(s.format, tuple(sorted(s.options.items()))) for s in plain}) > 1:
            for k, sink in sinks.items():
                sink(each.child(k).drop(_BATCH))
            return
        if not sinks:
            return
        numbers, staged = list(sinks), staging_path(spark, "multi-out")
        place = F.coalesce(*(F.when(F.col(_BATCH).eqNullSafe(F.lit(k)), F.lit(n)) for n, k in enumerate(numbers)))
        s = plain[0]
        rows.withColumn(_BATCH, place).write.options(**s.options).partitionBy(_BATCH).format(s.format).save(staged)
        for n, k in enumerate(numbers):
            rename(spark, f"{staged}/{_BATCH}={n}", f"{sinks[k].path}/flow-{staging_path(spark, 'x').rsplit('-', 1)[1]}")
        delete(spark, staged)


def retrying(sink: Callable[[DataFrame], object], times: int = 3, seconds: float = 0.2) -> Callable[[DataFrame], object]:
    """A sink that is tried again after a failure, each time after a longer wait; the last failure is raised.

    Spark tries each task again by itself. This is for what runs on the driver, such as a connection that is refused.
    """

    def run(df: DataFrame) -> object:
        for k in range(times + 1):
            try:
                return sink(df)
            except Exception:
                if k == times:
                    raise
                time.sleep(seconds * (k + 1))

    return run


def cursor(df: DataFrame, accessor: Accessor | None = None) -> Iterator[tuple]:
    """The rows, mapped, one after the other on the driver: a partition at a time is held there."""
    return map(tuple, (accessor.apply(df) if accessor else df).toLocalIterator(prefetchPartitions=False))


@dataclass
class NullSink:
    """Drops all rows, counting them by entity."""

    recorder: Recorder
    entity: Column | str = "garbage"

    def __call__(self, df: DataFrame) -> None:
        self.recorder.record(df, self.entity if isinstance(self.entity, Column) or self.entity in df.columns else F.lit(self.entity))


class ErrorSink:
    """Fails on any row."""

    def __call__(self, df: DataFrame) -> None:
        fail_on_rows(df, F.lit(True)).write.format("noop").mode("overwrite").save()


@dataclass
class RowSink:
    """Calls a function on each partition's rows, on the executors."""

    fn: Callable

    def __call__(self, df: DataFrame) -> None:
        df.foreachPartition(self.fn)


@dataclass
class KeyedTextSink:
    """Text lines, appended to a directory for each key in one pass."""

    path: str
    key: str
    line: Column | str

    def __call__(self, df: DataFrame) -> None:
        line = F.expr(self.line) if isinstance(self.line, str) else self.line
        df.select(F.col(self.key), line.alias("value")).write.partitionBy(self.key).mode("append").text(self.path)
