"""Pieces that the corpus operators share: table access, Arrow text buffers, numpy hashing, blob exchange.

The heavy operators move *blobs* (one binary value per pair of map chunk and hash bucket) instead of one
row per window. Spark still plans, shuffles and retries everything, but hashing, sorting and counting
run on numpy arrays, and a window that is hot in one chunk is sent once from that chunk.
"""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes of one numpy pass, so that its arrays stay in a core's cache (a longer document is one pass).
SLICE_BYTES = 1 << 16
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names; set one only where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    sc.setCheckpointDir(named or "/tmp/checkpoints")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return os.path.join(spark.sparkContext._jsc.sc().getCheckpointDir().get(), f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut, and lost executors cost nothing before it.

    A DataFrame's checkpoint() would run its last stage twice, once to count and once to write.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_owner: tuple[str, Callable[[], None]] = ("", lambda: None)


def claim(name: str, forget: Callable[[], None] = lambda: None) -> None:
    """Called by an operator's task in its worker. Workers outlive stages; what the operator before has remembered
    there goes when the worker turns to another one, and the memory goes back to the system."""
    global _owner
    if _owner[0] not in ("", name):
        _owner[1]()
        gc.collect()
        if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
            trim(0)
    _owner = (name, forget)


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh_prefix(taken: list[str]) -> str:
    """A prefix that none of the names begins with."""
    p = "_"
    while any(t.lower().startswith(p) for t in taken):
        p += "_"
    return p


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column, mod: int, remainder: int) -> Column:
    """crc32(doc_id as text) mod `mod` = `remainder`; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == remainder, F.lit(False))


# ---- Arrow text ---------------------------------------------------------------------------------


def text_buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column as one buffer; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(off: np.ndarray, budget: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of documents whose texts come to `budget` bytes or are one document."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + budget, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


# ---- numpy hashing ------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place on a fresh array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """The first n numbers of a fixed pseudo-random sequence."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 20)) * U64(0x9E3779B97F4A7C15))


BYTE_CODES = stream(256, 1)
_POWERS = stream(1 << 12, 2) | U64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTE_CODES[IS_SPACE] = 0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words [^\\x20\\x09-\\x0D]+ in the buffer, and for each document the index of its first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    space = IS_SPACE[data]
    begin = np.empty(len(data), bool)
    begin[0] = True
    begin[1:] = space[:-1]
    begin[off[:-1][off[:-1] < len(data)]] = True
    begin &= ~space
    starts = np.flatnonzero(begin)
    return starts, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word. data holds nothing but words and white space, which counts as zero."""
    if not len(starts):
        return np.zeros(0, U64)
    ends = np.append(starts[1:], len(data))
    span = ends - starts
    power = _POWERS if span.max() <= len(_POWERS) else stream(int(span.max()), 2) | U64(1)
    at = np.arange(starts[0], len(data))
    at -= np.repeat(starts, span)
    codes = BYTE_CODES[data[starts[0] :]]
    codes *= power[at]
    return mix(np.add.reduceat(codes, starts - starts[0]))


def doc_rows(first: np.ndarray, width: int) -> np.ndarray:
    """Starts of all runs of `width` items that stay inside a document. first: index of each document's first item."""
    n = int(first[-1])
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    return np.flatnonzero(left >= width)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, mod: int, remainder: int, bounds: tuple[int, int], reduce: Callable[[str], object], kind: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """((id, label, value) of at most bounds[label] labelled documents, the number of all labels that may be learned from).

    A value is what `reduce` makes of a whole text, in the task that reads it, so texts of any length may be learned
    from. Labels of held-out ids, null ids and labels other than 0 and 1 are never used; of several labels of an id the
    largest counts, of several rows of an id the largest value. The ids with the least hashes are taken, so the sample
    is the same in every run. The ids' side of the join is bounded, so broadcast.
    """
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id IS NOT NULL AND label IN (0, 1)")
    usable = usable.filter(~held_out(F.col("id"), mod, remainder)).groupBy("id").agg(F.max("label").alias("label"))
    counts = {r.label: r["count"] for r in usable.groupBy("label").count().collect()}
    first, second = (usable.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(bounds[k]) for k in (0, 1))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(first.unionByName(second)), "id").select("id", "label", "text")

    def run(batches):
        claim("sample")
        for batch in batches:
            values = pa.array([reduce(t.as_py()) for t in batch.column("text")], pa.binary() if kind == "binary" else pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), values], names=["id", "label", "value"])

    values = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, label int, value {kind}")
    return values.groupBy("id", "label").agg(F.max("value").alias("value")), counts
