"""Flows: children with dependencies, run in order, with hooks, cancelling and clean-up.

A child is a sink with its plan, a flow, or any action. The driver runs ready children side by side; Spark runs their
jobs. The first failure cancels what is running and what waits, and is the error that the caller sees.
"""

from __future__ import annotations

import itertools
import logging
import threading
from collections import defaultdict
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from contextlib import nullcontext
from dataclasses import dataclass

from pyspark import InheritableThread, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from weir.errors import EmptyFlowError, FlowCancelledError, SiblingCancelledError, SiblingFailedError, UpstreamCancelledError, UpstreamFailedError
from weir.plans.monitor import Monitor

log = logging.getLogger("weir")
_numbers: dict[str, itertools.count] = defaultdict(lambda: itertools.count(1))


@dataclass
class Options:
    """Options of a flow. parallelism: children that run at once. The others are for streams and for the monitor."""

    parallelism: int = 4
    monitor: bool = False
    verbose: bool = False
    interval_seconds: float = 10.0
    max_files_per_trigger: int | None = None

    def __post_init__(self):
        if self.interval_seconds <= 0:
            self.interval_seconds = 10.0


class Action:
    """A leaf: a name and a function without arguments that runs a Spark action."""

    def __init__(self, fn: Callable[[], object], name: str | None = None):
        self.fn, self.name = fn, name or getattr(fn, "__name__", type(fn).__name__)

    def run(self) -> object:
        return self.fn()


class Flow:
    """A named graph of children. Subclass it or use it as it is."""

    def __init__(self, spark: SparkSession | None = None, name: str | None = None, options: Options | None = None):
        self.spark, self.options = spark, options or Options()
        kind = type(self).__name__
        self.name = name or f"{kind}{next(_numbers[kind])}"
        self.parent: Flow | None = None
        self.children: list[Action | Flow] = []
        self._needs: dict[int, list[Action | Flow]] = defaultdict(list)
        self._on_success: list[Callable[[], object]] = []
        self._on_cancel: list[Callable[[], object]] = []
        self._tag = f"weir-{self.name}-{id(self)}"
        self._cancelled = threading.Event()
        self.error: BaseException | None = None
        self.results: dict[str, object] = {}
        self._running: dict = {}
        self.monitor = Monitor(self.full_name, verbose=self.options.verbose)

    # ---- building

    @property
    def full_name(self) -> str:
        return f"[{self.parent.full_name}]->[{self.name}]" if self.parent else self.name

    def add(self, child: Action | Flow | Callable[[], object], name: str | None = None, allow_duplicate: bool = False) -> Action | Flow:
        """Register a child. One may be registered twice only if allowed, and never an ancestor."""
        child = child if isinstance(child, (Action, Flow)) else Action(child, name)
        if any(c is child for c in self.children):
            if allow_duplicate:
                return child
            raise ValueError(f"{child.name} is a child of {self.name} already")
        if isinstance(child, Flow):
            if child is self or child.has(self):
                raise ValueError(f"{child.name} is an ancestor of {self.name}")
            child.parent = self
            child.spark = child.spark or self.spark
        self.children.append(child)
        return child

    def add_sink(self, df: DataFrame, sink: Callable[[DataFrame], object], name: str | None = None) -> Action:
        """A sink and the plan that feeds it, counted by the monitor if that is on."""
        label = name or getattr(sink, "name", None) or type(sink).__name__
        rows = self.monitor.watch(df, label) if self.options.monitor else df
        return self.add(Action(lambda: sink(rows), label))

    @property
    def busy(self) -> bool:
        """Whether a child of this flow, or of one below, is running."""
        return bool(self._running) or any(c.busy for c in self.children if isinstance(c, Flow))

    def has(self, child: Action | Flow) -> bool:
        """Whether it is a child of this flow or of one below."""
        return any(c is child or isinstance(c, Flow) and c.has(child) for c in self.children)

    def depends(self, child: Action | Flow, *upstream: Action | Flow) -> None:
        """Run a child only after all of `upstream`. Repeating a dependency has no effect."""
        for u in upstream:
            if isinstance(child, Flow) and child.has(u):
                raise ValueError(f"{u.name} is part of {child.name}, which cannot wait for it")
            if u is child or self._reaches(u, child):
                raise ValueError(f"{child.name} and {u.name} would wait for each other")
            if any(x is u for x in self._needs[id(child)]):
                log.warning("%s depends on %s already", child.name, u.name)
            else:
                self._needs[id(child)].append(u)

    def _reaches(self, a, b) -> bool:
        return any(x is b or self._reaches(x, b) for x in self._needs.get(id(a), ()))

    def on_success(self, hook: Callable[[], object]) -> None:
        """Run after all children have succeeded; a hook that fails fails the flow."""
        self._on_success.append(hook)

    def on_cancel(self, hook: Callable[[], object]) -> None:
        """Run when the flow fails or is cancelled, to stop what runs outside."""
        self._on_cancel.append(hook)

    def clean_up(self, error: BaseException | None) -> None:
        """Override: always called at the end, with the error or None."""

    # ---- running

    def cancel(self, why: BaseException | None = None) -> None:
        """Stop running jobs and start no more children. Spark launches no more tasks of a stopped job; one that runs and does
        not notice ends by itself."""
        first = not self._cancelled.is_set()
        self._cancelled.set()
        self.error = self.error or why or FlowCancelledError(f"{self.full_name} was cancelled")
        if first:
            for hook in self._on_cancel:
                hook()
            for c in self.children:
                if isinstance(c, Flow):
                    c.cancel(SiblingFailedError(f"{c.full_name} was stopped"))
        if self.spark is not None:
            self.spark.sparkContext.cancelJobsWithTag(self._tag)

    def run(self) -> dict[str, object]:
        """Run all children to their end. Gives their results by name, or raises the first failure."""
        error: BaseException | None = None
        try:
            if not self.children:
                raise EmptyFlowError(f"{self.full_name} has no children")
            with self.monitor.loop(self.options.interval_seconds, self.spark) if self.options.monitor else nullcontext():
                error = self._run_children()
            if error is None:
                for hook in self._on_success:
                    hook()
        except BaseException as e:
            error = e
        self.error = error
        try:
            self.clean_up(error)
        except BaseException as e:
            error = error or e
        if error is not None:
            raise error
        return self.results

    def _one(self, child: Action | Flow) -> object:
        if self.spark is not None:
            sc = self.spark.sparkContext
            sc.addJobTag(self._tag)
            sc.setJobDescription(f"{self.full_name} / {child.name}")
        return child.run()

    def _run_children(self) -> BaseException | None:
        waiting, running, done = list(self.children), self._running, set()
        error: BaseException | None = None
        self.failures: dict[str, BaseException] = {}
        with ThreadPoolExecutor(max(1, self.options.parallelism), thread_name_prefix=self.name) as pool:
            while waiting or running:
                if self._cancelled.is_set() and error is None:
                    error = self.error
                if error is None:
                    for c in [c for c in waiting if all(id(u) in done for u in self._needs[id(c)])]:
                        waiting.remove(c)
                        fn = inheritable_thread_target(self.spark)(self._one) if self.spark is not None else self._one
                        running[pool.submit(fn, c)] = c
                    if not running and waiting:
                        return UpstreamFailedError(f"{waiting[0].name} waits for something that is not part of {self.full_name}")
                else:
                    stopped = isinstance(error, FlowCancelledError)
                    for c in waiting:
                        kinds = (UpstreamCancelledError, SiblingCancelledError) if stopped else (UpstreamFailedError, SiblingFailedError)
                        self.failures[c.name] = kinds[0 if self._needs[id(c)] else 1](f"{c.name} did not run")
                    waiting = []
                    if not running:
                        break
                if self._cancelled.is_set() and self.spark is not None:  # again, for a job that had not begun when the flow was cancelled
                    self.spark.sparkContext.cancelJobsWithTag(self._tag)
                for f in wait(running, timeout=0.05 if self._cancelled.is_set() or error is None else None, return_when=FIRST_COMPLETED).done:
                    c = running.pop(f)
                    e = f.exception()
                    if e is None:
                        done.add(id(c))
                        self.results[c.name] = f.result()
                    elif error is None:
                        # a job that a cancelled flow stopped fails too, but is not the cause
                        error = self.error if self._cancelled.is_set() and self.error is not None else e
                        self.failures[c.name] = e
                        self.cancel(error)
                    else:
                        sibling = (SiblingCancelledError if isinstance(error, FlowCancelledError) else SiblingFailedError)(f"{c.name} was stopped")
                        sibling.__cause__ = e
                        self.failures[c.name] = sibling
        return error

    def start(self) -> InheritableThread:
        """Run in the background; join the thread, then look at `error`."""

        def go():
            try:
                self.run()
            except BaseException:
                log.debug("%s failed", self.full_name, exc_info=True)

        thread = InheritableThread(target=go, session=self.spark) if self.spark is not None else threading.Thread(target=go)
        thread.start()
        return thread


def process(spark: SparkSession, source: DataFrame, *sinks: Callable[[DataFrame], object], options: Options | None = None) -> int:
    """Feed a source to sinks and wait for all. Gives the number of rows of the source.

    One sink's rows are counted while it reads them, so of a sink that stops early those that it took; only where no
    action counted any is the source read for it. Several sinks share persisted rows, which are counted from there.
    """
    flow = Flow(spark, options=options)
    if len(sinks) == 1:
        watched = flow.monitor.watch(source, "source")
        flow.add(Action(lambda: sinks[0](watched), "sink0"))
        flow.run()
        n = flow.monitor.counted("source")
        return source.count() if n is None else n
    rows = source.persist()
    try:
        for k, s in enumerate(sinks):
            flow.add(Action(lambda s=s: s(rows), f"sink{k}"))
        counted = flow.add(Action(rows.count, "count"))
        flow.run()
        return flow.results[counted.name]
    finally:
        rows.unpersist()
