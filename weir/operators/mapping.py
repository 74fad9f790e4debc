"""The mapping compiler: nested rows to the columns of a target table, as one projection.

A mapping ties a path of the source ("a.b.c") to a column of a labelled target, with a default for null and an
option. Several mappings may want one column; the least `10 * depth + option` wins, declared before registered ones.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from datetime import date, datetime
from decimal import Decimal
from enum import IntEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.errors import MappingError
from weir.operators.router import fail_on_rows


log = logging.getLogger("weir.mapping")


class Option(IntEnum):
    MANDATORY = 1
    OPTIONAL = 2
    OVERWRITE = -32768


@dataclass(frozen=True)
class TargetTable:
    """Identity of a sink: equal if label, place and name are."""

    label: str
    url: str = ""
    name: str = ""


@dataclass(frozen=True)
class ColumnMapping:
    """A source path's column: by name, by offset, by both (which must agree), or by neither (the path's last name)."""

    label: str
    name: str | None = None
    offset: int | None = None
    default: object = None
    option: Option = Option.MANDATORY


@dataclass(frozen=True)
class Resolved:
    """A mapping with its place in the target: column name and offset, source path and depth."""

    mapping: ColumnMapping
    path: tuple[str, ...]
    kind: T.DataType
    nullable: bool
    name: str
    offset: int

    @property
    def weight(self) -> int:
        return 10 * len(self.path) + int(self.mapping.option)


@dataclass
class Entity:
    """A source schema with its mappings, by path.

    no_expand: paths of structs that are not looked into. no_null_check: paths of structs that must not be null, which
    fails the flow. read_only: target columns that automatic mapping skips.
    """

    mappings: Mapping[str, Iterable[ColumnMapping] | ColumnMapping] = field(default_factory=dict)
    no_expand: frozenset[str] = frozenset()
    no_null_check: frozenset[str] = frozenset()


#: Mappings registered from outside, by (entity name, path).
_REGISTERED: dict[tuple[str, str], list[ColumnMapping]] = {}


def register(entity: str, path: str, mapping: ColumnMapping) -> None:
    _REGISTERED.setdefault((entity, path), []).append(mapping)


def clear_registered() -> None:
    _REGISTERED.clear()


def paths_of(schema: T.StructType, no_expand: frozenset[str] = frozenset()) -> list[tuple[tuple[str, ...], T.StructField]]:
    """Leaf fields, level by level. Structs are looked into, unless excluded; arrays and maps are left out.

    A struct may name its entity in its field's metadata. One that stands below a struct of the same entity closes a
    loop of references: it is left out, with a warning.
    """
    level = [((f.name,), f, frozenset()) for f in schema.fields]
    out = []
    while level:
        below = []
        for path, f, above in level:
            if isinstance(f.dataType, T.StructType):
                kind = (f.metadata or {}).get("entity")
                if kind is not None and kind in above:
                    log.warning("%s refers to %s, which it is a part of, and is left out", ".".join(path), kind)
                elif ".".join(path) not in no_expand:
                    below += [((*path, g.name), g, above | ({kind} - {None})) for g in f.dataType.fields]
            elif not isinstance(f.dataType, (T.ArrayType, T.MapType)):
                out.append((path, f))
        level = below
    return out


#: Value types of the defaults that a column takes, by the type's name without parameters.
_PYTHON = {
    "string": (str,), "boolean": (bool,), "tinyint": (int,), "smallint": (int,), "int": (int,), "bigint": (int,),
    "float": (float, int), "double": (float, int), "binary": (bytes, bytearray),
    "decimal": (Decimal, int), "date": (date,), "timestamp": (datetime,), "timestamp_ntz": (datetime,),
}
#: What a missing value of a column that cannot be null reads as.
_ZERO = {"string": None, "boolean": False, "tinyint": 0, "smallint": 0, "int": 0, "bigint": 0, "float": 0.0, "double": 0.0, "decimal": 0, "date": "0001-01-01", "timestamp": "0001-01-01 00:00:00", "timestamp_ntz": "0001-01-01 00:00:00"}


def _plain(kind: T.DataType) -> str:
    return kind.simpleString().split("(")[0]


class Accessor:
    """The compiled mapping of one source schema to one target."""

    def __init__(self, source: T.StructType, target: T.StructType, label: str, entity: Entity | None = None, name: str = "", read_only: Iterable[str] = ()):
        self.source, self.target, self.label = source, target, label
        self.entity = entity or Entity()
        self._by_lower = {f.name.lower(): k for k, f in enumerate(target.fields)}
        leaves = paths_of(source, self.entity.no_expand)
        found: list[Resolved] = []
        declared, registered = [], []
        for path, f in leaves:
            dotted = ".".join(path)
            own = self.entity.mappings.get(dotted, ())
            declared += [(m, path, f) for m in ([own] if isinstance(own, ColumnMapping) else own) if m.label == label]
            registered += [(m, path, f) for m in _REGISTERED.get((name, dotted), ()) if m.label == label]
        for m, path, f in declared + registered:
            self._check_default(m, path, f)
            if (r := self._resolve(m, path, f)) is not None:
                found.append(r)
        if not declared and not registered:
            found = self._automatic(leaves, {c.lower() for c in read_only})
        best: dict[int, Resolved] = {}
        for r in found:
            if r.offset not in best or r.weight < best[r.offset].weight:
                best[r.offset] = r
        self.resolved = [best[k] for k in sorted(best)]

    # ---- resolution

    def _check_default(self, m: ColumnMapping, path: tuple[str, ...], f: T.StructField) -> None:
        if m.default is None:
            return
        kind = f.dataType.simpleString()
        if not f.nullable and kind != "string" and kind != "binary":
            raise MappingError("a default was given for a value that cannot be null", m, ".".join(path))
        allowed = _PYTHON.get(_plain(f.dataType))
        if kind == "date" and isinstance(m.default, datetime) or allowed and (not isinstance(m.default, allowed) or isinstance(m.default, bool) and bool not in allowed):
            raise MappingError(f"a default of type {type(m.default).__name__} does not fit {kind}", m, ".".join(path))

    def _resolve(self, m: ColumnMapping, path: tuple[str, ...], f: T.StructField) -> Resolved | None:
        at = None
        if m.offset is not None:
            if not 0 <= m.offset < len(self.target.fields):
                raise MappingError(f"the target has {len(self.target.fields)} columns", m, ".".join(path))
            at = m.offset
            if m.name is not None and self.target.fields[at].name != m.name:
                raise MappingError(f"column {at} is {self.target.fields[at].name!r}, not {m.name!r}", m, ".".join(path))
        else:
            at = self._by_lower.get((m.name if m.name is not None else path[-1]).lower())
        if at is None:
            if m.option == Option.OPTIONAL:
                return None
            raise MappingError(f"the target has no column {(m.name or path[-1])!r}", m, ".".join(path))
        return Resolved(m, path, f.dataType, f.nullable, self.target.fields[at].name, at)

    def _automatic(self, leaves, read_only: set[str]) -> list[Resolved]:
        out = []
        for path, f in leaves:
            k = self._by_lower.get(path[-1].lower())
            if k is not None and path[-1].lower() not in read_only:
                out.append(Resolved(ColumnMapping(self.label), path, f.dataType, f.nullable, self.target.fields[k].name, k))
        if not out:
            raise MappingError(f"no column of target {self.label!r} has a mapping or a field of its name")
        return out

    # ---- looking up

    @property
    def field_count(self) -> int:
        return len(self.resolved)

    def name_of(self, offset: int) -> str:
        return self.target.fields[offset].name

    def offset_of(self, name: str) -> int:
        """Offset of a column, ignoring case; -1 if there is none."""
        return self._by_lower.get(name.lower(), -1)

    def mapping_of(self, offset: int) -> ColumnMapping | None:
        return next((replace(r.mapping, name=r.name, offset=r.offset) for r in self.resolved if r.offset == offset), None)

    # ---- the projection

    def columns(self) -> list[Column]:
        """One expression for each mapped column, in the target's order, cast to its type."""
        return [self._value(r).cast(self.target.fields[r.offset].dataType).alias(r.name) for r in self.resolved]

    def _value(self, r: Resolved) -> Column:
        value = F.col(".".join(f"`{p}`" for p in r.path))
        if r.mapping.default is not None:
            return F.coalesce(value, F.lit(r.mapping.default).cast(r.kind))
        zero = _ZERO.get(_plain(r.kind))
        if not r.nullable and zero is not None and len(r.path) > 1:  # below a null parent
            return F.coalesce(value, F.lit(zero).cast(r.kind))
        return value

    def apply(self, df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
        """The mapped columns, after those in keep as they are."""
        for path in sorted(self.entity.no_null_check):
            df = fail_on_rows(df, F.col(path).isNull(), f"{path} is null and has no null check")
        return df.select(*keep, *self.columns())


_ACCESSORS: dict[tuple, Accessor] = {}


def accessor_for(source: T.StructType, target: TargetTable, schema: T.StructType, entity: Entity | None = None, name: str = "") -> Accessor:
    """The accessor of a source and a target, made once for each pair."""
    key = (source.json(), target, schema.json(), name, id(entity), sum(map(len, _REGISTERED.values())))
    if key not in _ACCESSORS:
        _ACCESSORS[key] = Accessor(source, schema, target.label, entity, name)
    return _ACCESSORS[key]


def flat_names(schema: T.StructType, skip: Iterable[str] = ()) -> str:
    """Column names of a table as a comma-separated list."""
    left_out = {s.lower() for s in skip}
    return ", ".join(f.name for f in schema.fields if f.name.lower() not in left_out)
