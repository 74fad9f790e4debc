"""Two-level event counting: how many rows of each entity, and of each event with up to two levels."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Kinds of entities, and of events, that a recorder takes from one DataFrame.
MAX_KINDS = 100_000


@dataclass(frozen=True)
class Event:
    """An event; both levels may be missing, and an event without either is empty."""

    level1: str | None = None
    level2: str | None = None

    @property
    def empty(self) -> bool:
        return self.level1 is None and self.level2 is None

    def __str__(self) -> str:
        return "-".join(x for x in (self.level1, self.level2) if x is not None)


def event_text(level1: Column, level2: Column) -> Column:
    """An event as text: its levels joined by a hyphen."""
    return F.concat_ws("-", level1, level2)


def count_entities(df: DataFrame, entity: Column | str, name: str = "entity") -> DataFrame:
    """(entity, n), counted in the map tasks first."""
    return df.groupBy(_col(entity).alias(name)).agg(F.count("*").alias("n"))


def count_events(df: DataFrame, level1: Column | str, level2: Column | str | None = None) -> DataFrame:
    """(level1, level2, n); rows with an empty event are left out."""
    second = F.lit(None).cast("string") if level2 is None else _col(level2).cast("string")
    rows = df.select(_col(level1).cast("string").alias("level1"), second.alias("level2"))
    return rows.filter("level1 IS NOT NULL OR level2 IS NOT NULL").groupBy("level1", "level2").agg(F.count("*").alias("n"))


def event_lookup(counts: DataFrame) -> DataFrame:
    """(level1, n) as `Recorder.event(level1)` gives it, for all first levels: the count of the bare event if that ever
    occurred, else the sum over its second levels."""
    bare = F.max(F.when(F.col("level2").isNull(), F.col("n")))
    return counts.filter("level1 IS NOT NULL").groupBy("level1").agg(F.coalesce(bare, F.sum("n")).alias("n"))


def event_rollup(counts: DataFrame) -> DataFrame:
    """(level1, n) with the bare event and all its second levels added up."""
    return counts.filter("level1 IS NOT NULL").groupBy("level1").agg(F.sum("n").alias("n"))


def with_total(counts: DataFrame, label: str = "TOTAL") -> DataFrame:
    """The counts and one row with their sum."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return counts.unionByName(total.select(F.lit(label).alias("level1"), F.lit(None).cast("string").alias("level2"), "n"))


def total(counts: DataFrame, name: str = "total") -> DataFrame:
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))


def first_by_key(df: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row for each key: the least by `order`, or any. Aggregated in the map tasks first."""
    if order is None:
        return df.dropDuplicates([key])
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("__r")).select(key, *(F.col("__r")[c].alias(c) for c in rest))


class Recorder:
    """Counts on the driver, filled from DataFrames of any size: only the grouped counts are collected.

    `parents` maps an entity to its direct supertypes. An entity's count is its own if it was ever recorded, else the
    sum over its subtypes.
    """

    def __init__(self, name: str = "recorder", parents: Mapping[str, Iterable[str]] | None = None, exceptions: Iterable[str] = ()):
        self.name = name
        self.parents = {k: tuple(v) for k, v in (parents or {}).items()}
        self.exceptions = set(exceptions)
        self._entities: dict[str, int] = {}
        self._events: dict[Event, int] = {}

    # ---- recording

    def record(self, df: DataFrame, entity: Column | str, level1: Column | str | None = None, level2: Column | str | None = None) -> Recorder:
        """Count a DataFrame's rows by entity, and their events where level1 or level2 is not null."""
        for r in _bounded(count_entities(df, entity)):
            self.record_entity(r["entity"], r["n"])
        if level1 is not None:
            self.record_events(df, level1, level2)
        return self

    def record_events(self, df: DataFrame, level1: Column | str, level2: Column | str | None = None) -> Recorder:
        for r in _bounded(count_events(df, level1, level2)):
            self.record_event(r["level1"], r["level2"], r["n"])
        return self

    def record_entity(self, entity: str, n: int = 1) -> None:
        self._entities[entity] = self._entities.get(entity, 0) + n

    def record_event(self, level1: str | None | Event, level2: str | None = None, n: int = 1) -> None:
        event = level1 if isinstance(level1, Event) else Event(level1, level2)
        if not event.empty:
            self._events[event] = self._events.get(event, 0) + n

    def clear(self) -> None:
        self._entities.clear()
        self._events.clear()

    # ---- looking up

    def entity(self, entity: str) -> int:
        if entity in self._entities:
            return self._entities[entity]
        return sum(n for e, n in self._entities.items() if self._is_a(e, entity))

    def _is_a(self, entity: str, ancestor: str) -> bool:
        return any(p == ancestor or self._is_a(p, ancestor) for p in self.parents.get(entity, ()))

    def event(self, level1: str | None | Event, level2: str | None = None) -> int:
        event = level1 if isinstance(level1, Event) else Event(level1, level2)
        if event in self._events:
            return self._events[event]
        return sum(n for e, n in self._events.items() if e.level1 == event.level1) if event.level2 is None else 0

    def __getitem__(self, key: str | Event) -> int:
        """The count of an event. Entities have `entity()`."""
        return self.event(key)

    def rollup(self, level1: str) -> int:
        """The bare event and all its second levels."""
        return sum(n for e, n in self._events.items() if e.level1 == level1)

    @property
    def exception_count(self) -> int:
        """Rows of the exception types and of all their subtypes."""
        return sum(n for e, n in self._entities.items() if self.is_exception(e))

    def is_exception(self, entity: str) -> bool:
        return entity in self.exceptions or any(self._is_a(entity, x) for x in self.exceptions)

    @property
    def total(self) -> int:
        return sum(self._entities.values())

    def snapshot(self) -> tuple[dict[str, int], dict[Event, int]]:
        return dict(self._entities), dict(self._events)

    def dump(self) -> str:
        """The counts as text; exceptions are not listed as entities."""
        kinds = ", ".join(f"{e}({n})" for e, n in sorted(self._entities.items()) if not self.is_exception(e))
        events = ", ".join(f"{e}({n})" for e, n in sorted(self._events.items(), key=lambda x: str(x[0])))
        return f"[{self.name}] entities: {kinds}\n[{self.name}] events: {events}"


def _bounded(counts: DataFrame) -> list:
    found = counts.limit(MAX_KINDS + 1).collect()
    if len(found) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds: keep the counts as a DataFrame")
    return found


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
