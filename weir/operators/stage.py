"""Named stages: functions from DataFrame to DataFrame that compose, so Catalyst sees one plan."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Transform = Callable[[DataFrame], DataFrame]


class Stage:
    """A transformation with a name. Calling it applies it; `then` chains; nothing runs before a sink's action."""

    def __init__(self, name: str, fn: Transform):
        self.name, self._fn = name, fn

    def __call__(self, df: DataFrame) -> DataFrame:
        return self._fn(df)

    def __repr__(self) -> str:
        return f"Stage({self.name!r})"

    def then(self, *others: Stage | Transform) -> Stage:
        """This stage, then the others, as one stage."""
        return merge(self, *others)


def as_stage(fn: Stage | Transform, name: str | None = None) -> Stage:
    return fn if isinstance(fn, Stage) and name is None else Stage(name or getattr(fn, "name", None) or getattr(fn, "__name__", "stage"), fn)


def merge(*stages: Stage | Transform) -> Stage:
    """Two or more stages as one, applied from left to right."""
    parts = [as_stage(s) for s in stages]
    if not parts:
        raise ValueError("nothing to merge")

    def run(df: DataFrame) -> DataFrame:
        for s in parts:
            df = df.transform(s)
        return df

    return Stage(" > ".join(s.name for s in parts), run)


def map_columns(name: str = "map", **exprs: Column | str) -> Stage:
    """One row in, one row out: the named expressions are the new row."""
    return Stage(name, lambda df: df.select(*(_expr(e).alias(k) for k, e in exprs.items())))


def with_columns(name: str = "extend", **exprs: Column | str) -> Stage:
    """One row in, one row out: expressions are added to the row."""
    return Stage(name, lambda df: df.withColumns({k: _expr(e) for k, e in exprs.items()}))


def flat_map(items: Column | str, alias: str = "value", keep: Iterable[str] = (), name: str = "flat_map") -> Stage:
    """One row in, a row out for each item of an array; null and empty arrays give no row."""
    return Stage(name, lambda df: df.select(*keep, F.explode(_expr(items)).alias(alias)))


def filtered(predicate: Column | str, name: str = "filter") -> Stage:
    """Rows for which the predicate holds. A filter takes null for false by itself, so the bare predicate can be pushed
    down to the scan."""
    return Stage(name, lambda df: df.filter(_expr(predicate)))


def from_batches(fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, name: str | None = None) -> Stage:
    """An opaque function on batches of rows, over Arrow. It must be pure: a lost task is run again."""

    def run(batches):
        for b in batches:
            yield fn(b)

    return Stage(name or getattr(fn, "__name__", "batches"), lambda df: df.mapInPandas(run, schema))


def consume(fn: Callable[[DataFrame], None], name: str | None = None) -> Callable[[DataFrame], None]:
    """A terminal consumer. It gets the DataFrame and runs its own action."""
    fn.__name__ = name or getattr(fn, "__name__", "consume")
    return fn


def holds(predicate: Column | str) -> Column:
    """A predicate with two values: null counts as false."""
    return F.coalesce(_expr(predicate), F.lit(False))


def _expr(e: Column | str) -> Column:
    return F.expr(e) if isinstance(e, str) else e
