"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only.

Each step hands the next one a bitmap of the hashes of what is repeated so far: SIZE bits, built by partial aggregates
and broadcast, so a proven bound, whatever the input. A set bit may also be another value's; that only means that a row
stays for the next step, whose groups are exact. So no text is shuffled to find out which rows survive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.common import ascii_lower, fresh_prefix, stored

#: Characters of a text that the second step hashes.
PREFIX_CHARS = 256
#: Bits of a bitmap (8 MB). With more repeated values than that, rows stay that need not; the result is the same.
SIZE = 1 << 26
#: Bits and bytes of one value of the built-in bitmap aggregates.
PART_BITS, PART_BYTES = 32768, 4096


def _slot(*values: Column) -> Column:
    return F.pmod(F.xxhash64(*values), F.lit(SIZE))


def _bitmap(repeated: DataFrame, *keys: str) -> DataFrame:
    """(part, bits): at most SIZE / PART_BITS rows of PART_BYTES each."""
    at = repeated.select(_slot(*(F.col(k) for k in keys)).alias("s")).select(F.floor(F.col("s") / PART_BITS).cast("int").alias("part"), (F.col("s") % PART_BITS).alias("b"))
    return at.groupBy("part").agg(F.bitmap_construct_agg("b").alias("bits"))


def _marked(rows: DataFrame, bitmap: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The rows with a flag: whether the bitmap has their keys. The bitmap's side has a proven bound, so it is broadcast."""
    slot = _slot(*(F.col(k) for k in keys))
    part = bitmap.select(F.col("part").alias(f"{name}part"), F.col("bits").alias(f"{name}bits"))
    joined = rows.join(F.broadcast(part), F.floor(slot / PART_BITS).cast("int") == F.col(f"{name}part"), "left")
    bit = slot % PART_BITS
    byte = F.conv(F.hex(F.substring(F.col(f"{name}bits"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return joined.withColumn(f"{name}on", there).drop(f"{name}part", f"{name}bits")


def _keys(text: Column, prefix_chars: int) -> list[Column]:
    return [F.octet_length(text), F.xxhash64(ascii_lower(F.substring(text, 1, prefix_chars)))]


def survivors(docs: DataFrame, text_col: str, prefix_chars: int) -> DataFrame:
    """The bitmap of (length, prefix hash) of more than one row; the prefix is only looked at where the length is not alone."""
    n, p = _keys(F.coalesce(F.col(text_col), F.lit("")), prefix_chars)
    narrow = stored(docs.select(n.alias("n"), p.alias("p")))
    # every count is taken before its shuffle, so a hot length or group is a row for each task from here on
    lengths = narrow.groupBy("n").agg(F.count("*").alias("c")).filter("c > 1")
    again = _marked(narrow, _bitmap(lengths, "n"), ["n"], "_").filter("_on").drop("_on")
    return stored(_bitmap(again.groupBy("n", "p").agg(F.count("*").alias("c")).filter("c > 1"), "n", "p"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, digest: bool = False) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept[, text_sha256].

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of equal texts the row
    with the largest id stays; among equal ids exactly one row stays, a null id loses against any other.
    Empty tables give no rows; columns beside the two named ones are not looked at, so their names cannot clash. Very
    long texts are hashed where they are read, and never shuffled.

    Lengths are counted first, prefix hashes only of rows whose length is repeated, and only rows whose length and
    prefix are repeated are hashed in full and grouped. The digest column, if asked for, is the full hash of every
    row; then every row is hashed, but still only those rows are grouped. Groups of any size are pre-aggregated
    before the shuffle, and the join back is one that AQE can split.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    n, p = _keys(text, prefix_chars)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"), n.alias("n"), p.alias("p"))
    full = F.unhex(F.sha2(ascii_lower(F.col("t")).cast("binary"), 256))
    marked = _marked(rows, survivors(docs, text_col, prefix_chars), ["n", "p"], "_")
    rows = marked.select("id", "n", "p", F.col("_on").alias("on"), (full if digest else F.when(F.col("_on"), full)).alias("h"), F.monotonically_increasing_id().alias("row"))
    rows = stored(rows)
    alive = rows.filter("on")
    groups = alive.groupBy("n", "p", "h").agg(F.count("*").alias("size"), F.max(F.struct("id", "row")).alias("top")).filter("size > 1")
    groups = stored(groups)  # so that both sides of the join are plain shuffles, which can be split at a hot key
    r, g = alive.alias("r"), groups.alias("g")
    grouped = r.join(g, (F.col("r.n") == F.col("g.n")) & (F.col("r.p") == F.col("g.p")) & (F.col("r.h") == F.col("g.h")), "left").select("r.id", "r.row", "r.h", "g.size", "g.top")
    alone = rows.filter("NOT on").select("id", "row", "h", F.lit(None).cast("bigint").alias("size"), F.lit(None).cast(groups.schema["top"].dataType).alias("top"))
    return grouped.unionByName(alone).select(
        F.col("id").alias(id_col),
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("top.id")).alias("keep_id"),
        F.coalesce(F.col("size"), F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("top.row") == F.col("row"), F.lit(True)).alias("kept"),
        *([F.lower(F.hex(F.col("h"))).alias("text_sha256")] if digest else []),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The rows that stay, as they are: of equal texts one row of the largest id.

    The steps are those of `exact_dedup`, and rows that leave them early are passed on from the scan. Only rows whose
    length and prefix are repeated are shuffled, by their text's hash and id. Fully repeated rows are one row then;
    of rows equal in text and id but not in other columns one stays, any. Null texts, null ids, empty tables and long
    texts are as in `exact_dedup`; names of other columns cannot clash.
    """
    q = fresh_prefix(docs.columns)
    text = F.coalesce(F.col(text_col), F.lit(""))
    n, p = _keys(text, prefix_chars)
    marked = _marked(docs.withColumns({f"{q}n": n, f"{q}p": p}), survivors(docs, text_col, prefix_chars), [f"{q}n", f"{q}p"], q)
    alone = marked.filter(~F.col(f"{q}on")).select(*docs.columns)
    # a null id is the least of all, so a flag goes before it
    key = [F.col(id_col).isNotNull().alias(f"{q}there"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias(f"{q}id")]
    alive = stored(marked.filter(f"{q}on").select(*docs.columns, *key, F.sha2(ascii_lower(text).cast("binary"), 256).alias(f"{q}h")))
    top = alive.groupBy(f"{q}h").agg(F.max(F.col(id_col)).alias(f"{q}top"))
    top = top.select(f"{q}h", F.col(f"{q}top").isNotNull().alias(f"{q}there"), F.coalesce(F.col(f"{q}top").cast("string"), F.lit("")).alias(f"{q}id"))
    on = [f"{q}h", f"{q}there", f"{q}id"]
    return alone.unionByName(alive.join(stored(top), on, "left_semi").dropDuplicates(on).select(*docs.columns))


ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM t
"""
