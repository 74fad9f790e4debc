"""Row counters of stages, taken while the rows flow, and progress of streams."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger("weir.monitor")


class Monitor:
    """Counts rows at watched places. A count is there once an action over the place has ended; it costs no job.

    `loop` reports at intervals while jobs run: places that have been counted since, and the tasks of running stages.
    """

    def __init__(self, name: str = "monitor", verbose: bool = False, on_report: Callable[[dict[str, int]], None] | None = None):
        self.name, self.verbose, self.on_report = name, verbose, on_report
        self._seen: dict[str, Observation] = {}

    def watch(self, df: DataFrame, place: str) -> DataFrame:
        self._seen[place] = Observation(f"{self.name}:{place}:{len(self._seen)}")
        return df.observe(self._seen[place], F.count(F.lit(1)).alias("rows"))

    def rows(self, place: str) -> int:
        """The count of a place. Waits for an action over it."""
        return self._seen[place].get["rows"]

    def counted(self, place: str) -> int | None:
        """The count of a place, or None while no action over it has ended."""
        jo = self._seen[place]._jo
        return self.rows(place) if jo is not None and jo.getRowOrEmpty().isDefined() else None

    def report(self, *places: str) -> dict[str, int]:
        """Counts by place, logged; places without rows only if verbose. All must have been run."""
        return self._tell({p: self.rows(p) for p in (places or self._seen)})

    def _tell(self, counts: dict[str, int]) -> dict[str, int]:
        for p, n in counts.items():
            if n or self.verbose:
                log.info("%s %s: %d rows", self.name, p, n)
        if self.on_report:
            self.on_report(counts)
        return counts

    @contextmanager
    def loop(self, seconds: float, spark: SparkSession | None = None) -> Iterator[None]:
        """Report every so many seconds, and once at the end, what has been counted since the last report."""
        done, told = threading.Event(), set()

        def new() -> None:
            found = {p: n for p in list(self._seen) if p not in told and (n := self.counted(p)) is not None}
            told.update(found)
            if found:
                self._tell(found)

        def go() -> None:
            while not done.wait(seconds):
                new()
                if spark is not None and (self.verbose or log.isEnabledFor(logging.DEBUG)):
                    for k, tasks, ended in running(spark):
                        log.info("%s stage %d: %d of %d tasks", self.name, k, ended, tasks)

        thread = threading.Thread(target=go, name=f"{self.name}-monitor", daemon=True)
        thread.start()
        try:
            yield
        finally:
            done.set()
            thread.join()
            new()


def running(spark: SparkSession) -> list[tuple[int, int, int]]:
    """(stage, tasks, tasks that have ended) of each running stage."""
    status = spark.sparkContext.statusTracker()
    infos = [status.getStageInfo(k) for k in status.getActiveStageIds()]
    return [(x.stageId, x.numTasks, x.numCompletedTasks) for x in infos if x is not None]


class ProgressListener(StreamingQueryListener):
    """Keeps the rows of each stream's micro-batches, by the stream's name."""

    def __init__(self):
        self.rows: dict[str, list[int]] = {}
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(event.name or str(event.id), [])

    def onQueryProgress(self, event) -> None:
        self.rows.setdefault(event.progress.name or str(event.progress.id), []).append(event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)] = event.exception


def log_rows(df: DataFrame, place: str, by: str, level: int = logging.INFO) -> None:
    """Log the counts of a column's values at a level."""
    for r in df.groupBy(by).count().orderBy(by).collect():
        log.log(level, "%s %s: %d", place, r[0], r[1])
