"""Small value functions used by flows, all on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key_of(pair: Column | str, sep: str = "=") -> Column:
    """What stands before the separator of a key=value token."""
    return F.split_part(col(pair), F.lit(sep), F.lit(1))


def int_value_of(pair: Column | str, sep: str = "=") -> Column:
    """The integer after the separator. A token without one, or with other text there, fails the flow (ANSI cast)."""
    return F.element_at(F.split(col(pair), F.regexp_replace(F.lit(sep), r"(\W)", r"\\$1")), 2).cast("int")


def or_default(value: Column | str, default: object) -> Column:
    return F.coalesce(col(value), F.lit(default))


def md5_key(value: Column | str) -> Column:
    """Hex MD5 of a text, as a key of fixed length."""
    return F.md5(col(value).cast("binary"))


def binary_key(value: Column | str) -> Column:
    """The UTF-8 bytes of a value as a key that is compared by content."""
    return F.encode(col(value).cast("string"), "UTF-8")


def bytes_hash(value: Column | str) -> Column:
    """Hash of a binary value, equal for equal contents."""
    return F.xxhash64(col(value))


def row_id() -> Column:
    """A random id for each row. Persist or store the rows before they feed more than one sink."""
    return F.expr("uuid()")


def json_fields(text: Column | str, schema: str, lenient: bool = True) -> Column:
    """A JSON text as a struct. Malformed text fails the flow; unquoted names and single quotes are read if lenient."""
    options = {"mode": "FAILFAST"} | ({"allowUnquotedFieldNames": "true", "allowSingleQuotes": "true"} if lenient else {})
    return F.from_json(col(text), schema, options)
