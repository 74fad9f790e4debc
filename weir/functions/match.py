"""Match conditions as Column predicates, and multi-rule matching.

Exact, begins, ends and contains compare code points as they stand; regular expressions ignore case (in Unicode) and
may match anywhere. A null input matches nothing. URL conditions can first drop what follows ? or #, and ignore case
in all kinds by default.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from enum import IntEnum
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class MatchKind(IntEnum):
    EXACT = 0
    BEGINS = 1
    ENDS = 2
    CONTAINS = 3
    REGEX = 4


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def url_without_param(url: Column | str) -> Column:
    """The trimmed URL up to its first ? or #. All Unicode white space is trimmed."""
    return F.regexp_extract(F.regexp_replace(_col(url), r"(?U)^\s+|\s+$", ""), "^[^?#]*", 0)


class Condition:
    """A predicate on one value."""

    def test(self, value: Column | str) -> Column:
        """The predicate, null for a null value: for filters, which take null for false and push it down to the scan."""
        raise NotImplementedError

    def matches(self, value: Column | str) -> Column:
        """The predicate with two values: false for a null value."""
        return F.coalesce(self.test(value), F.lit(False))

    def leaves(self) -> list[Condition]:
        """The conditions that can be the exact one to hit, in order."""
        return [self]

    def exact(self, value: Column | str) -> Column:
        """Index in leaves() of the condition that hit, or null."""
        return _first([c.matches(value) for c in self.leaves()])

    def __or__(self, other: Condition) -> AnyOf:
        return AnyOf([self, other])


class Nothing(Condition):
    """Matches no value."""

    def test(self, value: Column | str) -> Column:
        return F.lit(False)


NOTHING = Nothing()


@dataclass(frozen=True)
class Text(Condition):
    pattern: str
    kind: MatchKind = MatchKind.EXACT

    def __post_init__(self):
        if self.pattern is None:
            raise TypeError("a pattern is needed")

    def test(self, value: Column | str) -> Column:
        return _compare(_col(value), self.pattern, self.kind)


@dataclass(frozen=True)
class Url(Condition):
    pattern: str
    kind: MatchKind = MatchKind.EXACT
    exclude_param: bool = False
    ignore_case: bool = True

    def __post_init__(self):
        if self.pattern is None:
            raise TypeError("a pattern is needed")

    def test(self, value: Column | str) -> Column:
        v = url_without_param(value) if self.exclude_param else _col(value)
        if self.ignore_case and self.kind != MatchKind.REGEX:
            return _compare(F.upper(v), self.pattern.upper(), self.kind)
        return _compare(v, self.pattern, self.kind)


@dataclass(frozen=True)
class AnyOf(Condition):
    """Matches where any of its conditions does; the first that does is the exact one."""

    conditions: Sequence[Condition]

    def test(self, value: Column | str) -> Column:
        return reduce(lambda a, b: a | b, [c.test(value) for c in self.conditions]) if self.conditions else F.lit(False)

    def leaves(self) -> list[Condition]:
        return [x for c in self.conditions for x in c.leaves()]


def exact(p: str) -> Text:
    return Text(p, MatchKind.EXACT)


def begins(p: str) -> Text:
    return Text(p, MatchKind.BEGINS)


def ends(p: str) -> Text:
    return Text(p, MatchKind.ENDS)


def contains(p: str) -> Text:
    return Text(p, MatchKind.CONTAINS)


def regex(p: str) -> Text:
    return Text(p, MatchKind.REGEX)


@dataclass(frozen=True)
class Rule:
    """A result and the condition it stands for."""

    result: object
    condition: Condition


class Matcher:
    """An ordered list of rules over one value. All methods give Columns, so a match is part of the scan's stage."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = list(rules)

    def __getitem__(self, index: int) -> Rule:
        return self.rules[index]

    def __len__(self) -> int:
        return len(self.rules)

    def index(self, value: Column | str) -> Column:
        """Place of the first rule that matches, or null."""
        return _first([r.condition.matches(value) for r in self.rules])

    def first(self, value: Column | str) -> Column:
        """Result of the first rule that matches, or null."""
        return self._pick(value, None)

    def first_or(self, value: Column | str, default: Column | object) -> Column:
        """Result of the first rule that matches, or the default: a constant or an expression."""
        return F.coalesce(self.first(value), default if isinstance(default, Column) else F.lit(default))

    def first_exact(self, value: Column | str) -> Column:
        """struct(rule, condition): places of the first rule that matches and of the exact condition in it, or null."""
        pairs = [F.when(r.condition.matches(value), F.struct(F.lit(k).alias("rule"), r.condition.exact(value).alias("condition"))) for k, r in enumerate(self.rules)]
        return F.coalesce(*pairs) if pairs else F.lit(None).cast("struct<rule:int,condition:int>")

    def every(self, value: Column | str) -> Column:
        """Array with the results of all rules that match, in order."""
        hits = [F.when(r.condition.matches(value), F.lit(r.result)) for r in self.rules]
        return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<int>")

    def explode(self, df: DataFrame, value: Column | str, name: str = "rule") -> DataFrame:
        """A row for each rule that matches a row."""
        return df.withColumn(name, F.explode(self.every(value)))

    def _pick(self, value, default) -> Column:
        hits = [F.when(r.condition.matches(value), F.lit(r.result)) for r in self.rules]
        return F.coalesce(*hits) if hits else F.lit(default)


def _compare(v: Column, p: str, kind: MatchKind) -> Column:
    if kind == MatchKind.EXACT:
        return v == F.lit(p)
    if kind == MatchKind.BEGINS:
        return v.startswith(F.lit(p))
    if kind == MatchKind.ENDS:
        return v.endswith(F.lit(p))
    if kind == MatchKind.REGEX:
        return v.rlike("(?iu)" + p)
    return v.contains(F.lit(p))


def _first(hits: list[Column]) -> Column:
    return F.coalesce(*(F.when(h, F.lit(k)) for k, h in enumerate(hits))) if hits else F.lit(None).cast("int")
