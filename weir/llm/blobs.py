"""The blob exchange: chunks of documents send packed keys to hash buckets, and get one bit for each key back.

`chunked` deals the documents once into chunks by their id. In each round `send` turns a chunk into one row for
each bucket (a binary value with all its keys), `decide` takes all rows of one bucket and answers each with a row
that holds a bit for each key, and the next round meets the chunk's documents and its answers in a cogroup. Sending
is a pure function of the chunk, so later rounds compute the order of the keys again instead of storing it, and
Spark can run any lost task again. The documents' shuffle is the same subplan in each round and is reused.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.common import claim, parallelism, text_buffer

#: Chunks and buckets for each shuffle partition, and the stored bytes below which neither is split further: the
#: blobs are as many as chunks times buckets at most, so they must not multiply where partitions are many and small.
CHUNKS_PER_PARTITION, BUCKETS_PER_PARTITION = 4, 2
LEAST_BYTES = 512 << 10
#: Stored bytes of a chunk beyond which a worker may not have room for it: then the job is refused before it begins.
#: Sizes from UNKNOWN on are the planner's for sources that it knows nothing of.
MOST_BYTES, UNKNOWN = 256 << 20, 1 << 60
ANSWER = "chunk int, bucket int, bits binary"
#: Order of a null id: before all others.
NULL_ID = np.iinfo(np.int64).min


def layout(docs: DataFrame) -> tuple[int, int]:
    """(chunks, buckets, a power of two). The size is the planner's, from the files' lengths; unknown counts as large."""
    n = parallelism(docs.sparkSession)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = size // LEAST_BYTES + 1
    if MOST_BYTES * CHUNKS_PER_PARTITION * n < size < UNKNOWN:
        raise ValueError(f"{size} bytes need more shuffle partitions than {n}: a chunk of {size // (CHUNKS_PER_PARTITION * n)} bytes is held by one worker; set spark.sql.shuffle.partitions to {-(-size // (MOST_BYTES * CHUNKS_PER_PARTITION))} or more")
    return min(CHUNKS_PER_PARTITION * n, parts), 1 << (min(BUCKETS_PER_PARTITION * n, parts) - 1).bit_length()


def chunked(docs: DataFrame, id_col: str, text_col: str, chunks: int) -> DataFrame:
    """(chunk, id, text), dealt by a hash of the id, so by no source, length or text."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.select(F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk"), "id", "text").repartition(parallelism(docs.sparkSession), "chunk")


class Chunk:
    """The documents of a chunk in the order (id, text); fully repeated rows stand side by side."""

    def __init__(self, rows: pa.Table):
        claim("blobs")
        # offsets of 64 bits, so a chunk may have more than 2 GB of text
        rows = rows.set_column(rows.schema.get_field_index("text"), "text", rows.column("text").cast(pa.large_string()))
        rows = rows.sort_by([("id", "ascending"), ("text", "ascending")]) if rows.num_rows > 1 else rows
        self.number = rows.column("chunk")[0].as_py()
        self.ids = rows.column("id").combine_chunks()
        self.order = self.ids.fill_null(NULL_ID).to_numpy(zero_copy_only=False)
        self.data, self.off = text_buffer(rows.column("text"))


def pack(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def unpack(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def cuts(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that occur in a sorted array, and where each begins, with the end."""
    at = np.searchsorted(bucket, np.arange(buckets + 1))
    there = np.flatnonzero(np.diff(at))
    return there, np.append(at[there], len(bucket))


def answers(answer: pa.Table, n: int, sizes: dict[int, int]) -> np.ndarray:
    """The bits of all buckets of a chunk in the order of the buckets. sizes: keys sent to each."""
    rows = sorted(zip(answer.column("bucket").to_pylist(), answer.column("bits").to_pylist(), strict=True))
    if [b for b, _ in rows] != sorted(sizes):
        raise ValueError("a chunk's answers don't match what it sent")
    parts = [unpack(raw, sizes[b]) for b, raw in rows]
    return np.concatenate(parts) if parts else np.zeros(n, bool)


# ---- keys that only have to be counted ----------------------------------------------------------


class Keys:
    """Distinct keys of a chunk, cut to the bits of the bucket and `width` bytes more, and what each item's key is."""

    def __init__(self, hashes: np.ndarray, buckets: int, width: int):
        self.width = width
        self.n_bits = buckets.bit_length() - 1
        cut = hashes >> np.uint64(64 - self.n_bits - 8 * width)
        self.keys, self.inverse, self.counts = np.unique(cut, return_inverse=True, return_counts=True)
        self.buckets, self.at = cuts((self.keys >> np.uint64(8 * width)).astype(np.int64), buckets)

    def rows(self, chunk: int) -> pa.Table:
        low = np.ascontiguousarray(self.keys).view(np.uint8).reshape(-1, 8)[:, : self.width]
        raw = [low[a:b].tobytes() for a, b in zip(self.at[:-1], self.at[1:], strict=True)]
        return pa.table({"bucket": pa.array(self.buckets, pa.int32()), "chunk": pa.array([chunk] * len(raw), pa.int32()), "keys": pa.array(raw, pa.binary())})

    def repeated(self, answer: pa.Table) -> np.ndarray:
        """For each item whether its key occurs again, here or in another chunk."""
        sizes = dict(zip(self.buckets.tolist(), np.diff(self.at).tolist(), strict=True))
        return (answers(answer, 0, sizes) | (self.counts > 1))[self.inverse] if len(self.keys) else np.zeros(0, bool)


KEY_ROWS = "bucket int, chunk int, keys binary"


def shared_keys(width: int) -> Callable[[pa.Table], pa.Table]:
    """Decide for a bucket: which keys come from more than one chunk."""

    def decide(rows: pa.Table) -> pa.Table:
        raw = [x.as_py() for x in rows.column("keys")]
        size = [len(x) // width for x in raw]
        wide = np.zeros((sum(size), 4), np.uint8)
        wide[:, :width] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, width)
        keys = wide.view(np.uint32).ravel()
        ordered = np.sort(keys)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        at = np.searchsorted(twice, keys)
        found = twice[np.minimum(at, len(twice) - 1)] == keys if len(twice) else np.zeros(len(keys), bool)
        ends = np.cumsum(size)
        bits = [pack(found[e - n : e]) for n, e in zip(size, ends, strict=True)]
        return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "bits": pa.array(bits, pa.binary())})

    return decide
