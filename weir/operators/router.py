"""Exclusive routing: each row travels to the first link whose predicate holds, what is left must be dealt with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.errors import RoutingError
from weir.operators.stage import Transform, holds

LEFT = "left"


@dataclass
class Branch:
    """One outgoing edge: its name, its predicate, the transform on it."""

    name: str
    predicate: Column
    transform: Transform | None = None
    bare: Column | None = None
    """The predicate as it was given, null or not: a filter on it can be pushed down to the scan."""


class Router:
    """Links of one DataFrame. Predicates are tried in the order of linking, and null counts as false.

    The routing table is frozen once what is left has been dealt with. A table that leaves rows without a target
    is refused by `branches()` and `branch()`, where a plain filter would drop them in silence.
    """

    def __init__(self, df: DataFrame, kind: str = "kind"):
        self.df, self.kind = df, kind
        self._links: list[Branch] = []
        self._left: str | None = None
        self._recorder: Callable[[DataFrame], object] | None = None
        self._open = True

    # ---- links

    def link(self, predicate: Column | str | None = None, name: str | None = None) -> Router:
        """Rows for which the predicate holds; without one, all that are left."""
        return self._add(predicate, None, name)

    def transform_link(self, transform: Transform, predicate: Column | str | None = None, name: str | None = None) -> Router:
        """A link with a transformation on it, fused into the same plan."""
        return self._add(predicate, transform, name)

    def subtype_link(self, kind: str, transform: Transform | None = None, name: str | None = None) -> Router:
        """Rows whose discriminator column says `kind`."""
        return self._add(F.col(self.kind) == kind, transform, name or kind)

    def match_link(self, condition, column: Column | str, transform: Transform | None = None, name: str | None = None) -> Router:
        """Rows that a match condition accepts on a column."""
        return self._add(condition.test(column), transform, name)

    def _add(self, predicate, transform, name) -> Router:
        if not self._open:
            raise RoutingError("the routing table is frozen: rows that are left have a target already")
        name = name or f"link{len(self._links)}"
        if name == LEFT or any(b.name == name for b in self._links):
            raise RoutingError(f"there is a link named {name!r} already")
        bare = F.lit(True) if predicate is None else F.expr(predicate) if isinstance(predicate, str) else predicate
        self._links.append(Branch(name, holds(bare), transform, bare))
        return self

    # ---- what is left

    def left_to(self, name: str = LEFT) -> Router:
        """Rows that no predicate holds for go to a branch of their own."""
        return self._close(name)

    def left_to_null(self, recorder: Callable[[DataFrame], object] | None = None) -> Router:
        """They are dropped; `garbage()` has them, and `garbage_counts()` what the recorder makes of them."""
        self._recorder = recorder
        return self._close("null")

    def left_to_error(self) -> Router:
        """Any such row fails the action that meets it."""
        return self._close("error")

    def _close(self, what: str) -> Router:
        if not self._open:
            raise RoutingError("rows that are left have a target already")
        self._open, self._left = False, what
        return self

    # ---- results

    def route(self, default: str = LEFT) -> Column:
        """Name of the first link whose predicate holds."""
        out = F.lit(default)
        for b in reversed(self._links):
            out = F.when(b.predicate, F.lit(b.name)).otherwise(out)
        return out

    def left(self) -> Column:
        """True where no recorded predicate holds."""
        out = F.lit(True)
        for b in self._links:
            out = out & ~b.predicate
        return out

    def routed(self, column: str = "route", default: str = LEFT) -> DataFrame:
        """All rows with the name of their branch: one pass, whatever the number of branches."""
        self._complete()
        return self._checked().withColumn(column, self.route(default))

    def branch(self, name: str) -> DataFrame:
        """The rows of one branch, transformed as its link says."""
        self._complete()
        if name == self._left and name not in ("null", "error"):
            return self.df.filter(self.left())
        rows = self._checked()
        for b in self._links:
            if b.name == name:
                rows = rows.filter(b.bare)
                return rows.transform(b.transform) if b.transform else rows
            rows = rows.filter(~b.predicate)
        raise RoutingError(f"no link is named {name!r}")

    def branches(self) -> dict[str, DataFrame]:
        names = [b.name for b in self._links] + ([self._left] if self._left not in (None, "null", "error") else [])
        return {n: self.branch(n) for n in names}

    def garbage(self) -> DataFrame:
        """The rows that go to null."""
        return self.df.filter(self.left())

    def garbage_counts(self) -> object:
        """What the recorder given with `left_to_null` makes of the dropped rows; without one, their count by kind or in all."""
        if self._recorder is not None:
            return self._recorder(self.garbage())
        by = self.kind if self.kind in self.df.columns else None
        return self.garbage().groupBy(*([by] if by else [])).agg(F.count("*").alias("n"))

    def _checked(self) -> DataFrame:
        return fail_on_rows(self.df, self.left()) if self._left == "error" else self.df

    def _complete(self) -> None:
        if self._left is None:
            raise RoutingError("rows may be left without a target: call left_to(), left_to_null() or left_to_error()")


def fail_on_rows(df: DataFrame, bad: Column, message: str = "a row was left that no link takes") -> DataFrame:
    """The same rows, but an action fails on a bad one.

    It is a filter, since column pruning removes a projection that nothing reads. The second condition is always true
    and not deterministic: so no later filter is moved before this one, and every row that an earlier one kept is checked.
    """
    return df.filter(F.assert_true(~holds(bad), F.lit(message)).isNull() & (F.monotonically_increasing_id() >= 0))
