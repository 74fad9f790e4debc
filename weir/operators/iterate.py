"""Fixpoint iteration for cyclic flows: a step is applied to what the last step gave, until nothing is left."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.errors import FlowError
from weir.sources.storage import staging_path, stored


@dataclass
class Rounds:
    """The rows of every round with the round's number, and how many rounds there were."""

    rows: DataFrame
    rounds: int


#: Steps that one job takes before its rows are stored.
UNROLLED = 6


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], max_iterations: int = 1000, number: str = "step", unrolled: int = UNROLLED) -> Rounds:
    """Apply `step` until it gives no rows. So many steps as `unrolled` are one plan, whose rows are stored in the shared
    folder, each with its round's number; so plans stay short, a lost executor costs no earlier plan, and all rounds are
    read back as one table. A ring that does not shrink is stopped after max_iterations."""
    spark, base = seed.sparkSession, staging_path(seed.sparkSession, "rounds")
    seed.withColumn(number, F.lit(0)).write.parquet(f"{base}/plan=0")
    first = spark.read.parquet(f"{base}/plan=0")
    frontier, last, plan, schema = first.drop(number), 0, 0, first.schema
    while last < max_iterations:
        plan += 1
        parts, at = [], frontier
        for k in range(last + 1, min(last + unrolled, max_iterations) + 1):
            at = step(at)
            parts.append(at.withColumn(number, F.lit(k)))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        out.write.parquet(f"{base}/plan={plan}")
        rows = spark.read.schema(out.schema).parquet(f"{base}/plan={plan}")
        reached = rows.agg(F.max(number)).first()[0]
        last += len(parts)
        if reached is None or reached < last:
            every = spark.read.schema(schema).option("basePath", base).parquet(base).drop("plan")
            return Rounds(every, (reached if reached is not None else last - len(parts)) + 1)
        frontier = rows.filter(F.col(number) == last).drop(number)
    raise FlowError(f"the ring still has rows after {max_iterations} rounds")


def closure(edges: DataFrame, max_iterations: int = 1000) -> DataFrame:
    """All pairs (src, dst) that a path of edges joins: reachability as a fixpoint. Each round puts the pairs that the last
    one found together with all pairs known, on either side, so the longest path doubles with each round."""
    known = fresh = stored(edges.select("src", "dst").distinct())
    for _ in range(max_iterations):
        after = fresh.alias("a").join(known.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        before = known.alias("a").join(fresh.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        fresh = stored(after.unionByName(before).distinct().join(known, ["src", "dst"], "left_anti"))
        if fresh.isEmpty():
            return known
        known = stored(known.unionByName(fresh))
    raise FlowError(f"paths still grow after {max_iterations} rounds")
