"""Dimension lookup: join facts to a dimension by key, inserting rows for keys that it lacks."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.operators.batching import numbered
from weir.operators.stage import holds

_PATH = re.compile(r"[^\W\d]\w*(\.[^\W\d]\w*)*")
_KEY = "__fact_key"
#: Rows of a dimension that a warm cache holds at most.
CACHE_ROWS = 1 << 20
#: Bytes, measured by the planner, up to which a dimension is broadcast; beyond it both sides are shuffled.
BROADCAST_BYTES = 64 << 20


class Strategy(Enum):
    """no_lookup: rows are joined already. local: keys that the dimension lacks are discarded. remote: they are inserted."""

    NO_LOOKUP = "no_lookup"
    LOCAL = "local"
    REMOTE = "remote"


@dataclass
class LookupResult:
    """joined: the facts with their dimension key. dimension: with the new rows. new_rows: those alone. discarded: facts."""

    joined: DataFrame
    dimension: DataFrame
    new_rows: DataFrame
    discarded: DataFrame


def small_enough(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the planner's size of a DataFrame is within a limit."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def sized(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The DataFrame with a broadcast hint if its size is known to be small; else the planner chooses at run time."""
    return F.broadcast(df) if small_enough(df, limit) else df


def newest(dim: DataFrame, key: str, n: int = CACHE_ROWS) -> DataFrame:
    """The n rows of the greatest surrogate key: a top-n, which no task holds more of than n rows."""
    return dim.orderBy(F.col(key).desc()).limit(n)


class Lookup:
    """Facts joined to a dimension on a key.

    key: column or path of the facts; dim_key: its column in the dimension; surrogate: the dimension's integer key.
    attributes: columns of a new dimension row, from expressions on the facts. Of facts that share a new key the row
    with the least `order` gives them (by default the least attributes), so a rerun makes the same dimension. Rows that
    the dimension has are never changed. A null key fails the flow, as does a key that the dimension has twice.
    """

    def __init__(self, key: str, dim_key: str, surrogate: str, attributes: dict[str, Column | str] | None = None, order: str | None = None, strategy: Strategy = Strategy.REMOTE, unique_check: bool = True):
        if not isinstance(key, str) or not _PATH.fullmatch(key):
            raise ValueError("the key must be a column or a path of fields")
        self.key, self.dim_key, self.surrogate = key, dim_key, surrogate
        self.attributes = {k: F.expr(v) if isinstance(v, str) else v for k, v in (attributes or {}).items()}
        self.order, self.strategy, self.unique_check = order, strategy, unique_check

    def keyed(self, facts: DataFrame) -> DataFrame:
        """The facts with their key as a column of its own, which fails on null when it is joined or grouped on.

        A filter would do so too, but the planner copies filters on a join's key to the other side, where a null is fine.
        """
        kind = facts.select(F.col(self.key)).schema[0].dataType
        return facts.withColumn(_KEY, F.coalesce(F.col(self.key), F.raise_error(F.lit("a lookup key is null")).cast(kind)))

    def check_dimension(self, dim: DataFrame) -> None:
        if self.unique_check and not dim.groupBy(self.dim_key).count().filter("count > 1").isEmpty():
            raise ValueError(f"the dimension has several rows of one {self.dim_key}")

    def missing(self, facts: DataFrame, dim: DataFrame) -> DataFrame:
        """One row for each key that the dimension lacks: the key and the attributes."""
        rows = self.keyed(facts).select(F.col(_KEY).alias(self.dim_key), *(e.alias(k) for k, e in self.attributes.items()), *([F.col(self.order).alias("__order")] if self.order else []))
        names = list(self.attributes)
        if names:  # aggregated in the map tasks, so a hot key is a row for each of them
            pick = F.struct(*names)
            first = F.min_by(pick, F.struct("__order", pick)) if self.order else F.min(pick)
            rows = rows.groupBy(self.dim_key).agg(first.alias("__a")).select(self.dim_key, *(F.col("__a")[k].alias(k) for k in names))
        else:
            rows = rows.select(self.dim_key).distinct()
        return rows.join(sized(dim.select(self.dim_key)), self.dim_key, "left_anti")

    def new_rows(self, facts: DataFrame, dim: DataFrame) -> DataFrame:
        """Missing rows with surrogate keys that follow the greatest one, dense and in the order of the key."""
        top = dim.agg(F.coalesce(F.max(self.surrogate), F.lit(0)).cast("bigint").alias("__top"))
        return numbered(self.missing(facts, dim), self.dim_key, "__n").join(F.broadcast(top)).withColumn(self.surrogate, F.col("__top") + F.col("__n") + 1).drop("__n", "__top")

    def run(self, facts: DataFrame, dim: DataFrame, on_found: Callable[[DataFrame], DataFrame] | None = None) -> LookupResult:
        """Look up, and by strategy insert or discard. Every fact is in `joined` once, or in `discarded`."""
        none = dim.limit(0)
        if self.strategy is Strategy.NO_LOOKUP:
            return LookupResult(facts, dim, none, facts.limit(0))
        self.check_dimension(dim)
        if self.strategy is Strategy.LOCAL:
            return LookupResult(self._join(facts, dim, on_found), dim, none, self.unmatched(facts, dim))
        new = self.new_rows(facts, dim)
        full = dim.unionByName(new, allowMissingColumns=True)
        return LookupResult(self._join(facts, full, on_found), full, new, facts.limit(0))

    def unmatched(self, facts: DataFrame, dim: DataFrame) -> DataFrame:
        k = dim.select(F.col(self.dim_key).alias("__k"))
        return self.keyed(facts).join(sized(k), F.col(_KEY) == F.col("__k"), "left_anti").drop(_KEY)

    def _join(self, facts: DataFrame, dim: DataFrame, on_found) -> DataFrame:
        side = dim.select(F.col(self.dim_key).alias("__k"), *(F.col(c) for c in dim.columns if c != self.dim_key and c not in facts.columns))
        joined = self.keyed(facts).join(sized(side), F.col(_KEY) == F.col("__k")).drop("__k", _KEY)
        return on_found(joined) if on_found else joined


def hit_counts(facts: DataFrame, dim: DataFrame, key: str, dim_key: str) -> DataFrame:
    """(outcome, n): facts that a local lookup finds, and those it discards. One join, a partial count in each task."""
    known = dim.select(F.col(dim_key).alias("__k")).distinct().withColumn("__hit", F.lit(True))
    rows = facts.join(sized(known), F.col(key) == F.col("__k"), "left")
    n = rows.agg(F.count_if(holds("__hit")).alias("hit"), F.count_if(~holds("__hit")).alias("discarded"))
    return n.select(F.explode(F.array(F.struct(F.lit("hit").alias("outcome"), F.col("hit").alias("n")), F.struct(F.lit("discarded").alias("outcome"), F.col("discarded").alias("n")))).alias("r")).select("r.*")
