"""Fan-out and fan-in: broadcast to all, dispatch by key, union."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.operators.stage import Transform

#: Keys that may have a child of their own.
MAX_CHILDREN = 10_000


class Broadcaster:
    """Every target gets every row. A predicate on a target is an error: that would be routing."""

    def __init__(self, df: DataFrame, copy: Transform | None = None):
        self.df, self._copy, self._targets = df, copy, []

    def link(self, consumer: Callable[[DataFrame], object], predicate: Column | str | None = None) -> Broadcaster:
        if predicate is not None:
            raise ValueError("a broadcaster sends every row to every target; use a router for predicates")
        self._targets.append(consumer)
        return self

    def outputs(self) -> list[DataFrame]:
        """A DataFrame for each target: the rows as they are for the first, through the copy function for the others."""
        return [self.df if k == 0 or self._copy is None else self.df.transform(self._copy) for k in range(len(self._targets))]

    def run(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> list[object]:
        """Feed all targets. With more than one the rows are persisted, so that each sees the same ones."""
        if len(self._targets) > 1:
            self.df = self.df.persist(level)
        try:
            return [t(df) for t, df in zip(self._targets, self.outputs(), strict=True)]
        finally:
            if len(self._targets) > 1:
                self.df.unpersist()


def link_to_all(df: DataFrame, *consumers: Callable[[DataFrame], object], copy: Transform | None = None) -> list[object]:
    b = Broadcaster(df, copy)
    for c in consumers:
        b.link(c)
    return b.run()


class Dispatcher:
    """One target for each distinct key; a row goes to the target of its key.

    `normalise` makes keys equal that differ in writing, such as F.lower. Null is a key like any other. The set of
    keys is read once and refused beyond MAX_CHILDREN, since every key has a child of its own; `by_path` has no such bound.
    """

    def __init__(self, df: DataFrame, key: Column | str, normalise: Callable[[Column], Column] | None = None):
        key = F.col(key) if isinstance(key, str) else key
        self.df, self.key = df, normalise(key) if normalise else key

    def keyed(self, name: str = "child") -> DataFrame:
        return self.df.withColumn(name, self.key)

    def keys(self) -> list[object]:
        found = self.df.select(self.key.alias("k")).distinct().limit(MAX_CHILDREN + 1).collect()
        if len(found) > MAX_CHILDREN:
            raise ValueError(f"more than {MAX_CHILDREN} keys: write them with by_path, or use by_group")
        return sorted((r[0] for r in found), key=lambda k: (k is not None, str(k)))

    def child(self, key: object) -> DataFrame:
        return self.df.filter(self.key.eqNullSafe(F.lit(key)))

    def run(self, create_child: Callable[[object], Callable[[DataFrame], object]]) -> dict[object, object]:
        """Create each key's child once and feed it."""
        rows = self.df.persist()
        try:
            return {k: create_child(k)(Dispatcher(rows, self.key).child(k)) for k in self.keys()}
        finally:
            rows.unpersist()

    def by_group(self, fn: Callable, schema: str) -> DataFrame:
        """A function on each key's rows, run on the executors."""
        return self.keyed("__child").groupBy("__child").applyInPandas(fn, schema)

    def by_path(self, path: str, name: str = "child", format: str = "parquet", mode: str = "append") -> None:
        """One directory for each key, written in a single pass with any number of keys."""
        self.keyed(name).write.partitionBy(name).mode(mode).format(format).save(path)


def union(*dfs: DataFrame) -> DataFrame:
    """Fan-in: the rows of all inputs, matched by column name; repeated rows stay."""
    if not dfs:
        raise ValueError("nothing to unite")
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df)
    return out
