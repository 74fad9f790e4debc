"""Substring dedup by level-wise doubling.

Windows of a first length are hashed and only those that occur again are extended to twice the length, up to the
length asked for; both halves of a longer window must have survived. The first length costs a few bytes for each
word, later ones only touch survivors. At the last length the first occurrence stays and later ones are removed.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.blobs import ANSWER, KEY_ROWS, Chunk, Keys, answers, chunked, cuts, layout, pack, shared_keys, unpack
from weir.llm.common import U64, doc_rows, mix, slices, stream, word_hashes, words

WINDOW = 20
#: The first level has at least so many words.
LEAST_WORDS = 8
#: Bytes of a key beside the bits of its bucket at the levels before the last, where a false match only costs a later look.
KEY_BYTES = 3
_A, _B = stream(64, 5) | U64(1), stream(64, 6) | U64(1)


def lengths(window: int, least: int) -> list[int]:
    out = [window]
    while (half := -(-out[0] // 2)) >= least and half < out[0]:
        out.insert(0, half)
    return out


class Words(Chunk):
    """A chunk with the hash of each of its words, in two independent sums for each window."""

    def __init__(self, rows: pa.Table, steps: list[int]):
        super().__init__(rows)
        self.steps = steps
        hashes, counts = [], []
        for a, b in slices(self.off):
            lo, hi = self.off[a], self.off[b]
            starts, first = words(self.data[lo:hi], self.off[a : b + 1] - lo)
            hashes.append(word_hashes(self.data[lo:hi], starts))
            counts.append(np.diff(first))
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        self.first = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)

    def base(self, factor: np.ndarray) -> np.ndarray:
        n = self.steps[0]
        if len(self.hashes) < n:
            return np.zeros(0, U64)
        total = np.zeros(len(self.hashes) - n + 1, U64)
        for j in range(n):
            total += self.hashes[j : len(self.hashes) - n + 1 + j] * factor[j % 64]
            if j % 64 == 63:
                total = mix(total)
        return mix(total)

    def at(self, base: np.ndarray, level: int, pos: np.ndarray, factor: np.ndarray) -> np.ndarray:
        """Hashes of the windows of a level that start at pos: two of the level below, put together."""
        if level == 0:
            return base[pos]
        gap = self.steps[level] - self.steps[level - 1]
        return mix(self.at(base, level - 1, pos, factor) * factor[2 * level] + self.at(base, level - 1, pos + gap, factor) * factor[2 * level + 1])

    def extended(self, level: int, pos: np.ndarray, again: np.ndarray) -> np.ndarray:
        """Windows of `level` whose two halves, windows of the level below, both occur again."""
        alive = np.zeros(len(self.hashes) + 1, bool)
        alive[pos[again]] = True
        longer = doc_rows(self.first, self.steps[level])
        return longer[alive[longer] & alive[longer + self.steps[level] - self.steps[level - 1]]]


LAST_ROWS = "bucket int, chunk int, keys binary, more binary, ids binary"


class Last:
    """The windows of the last level: the first of each kind in the chunk is sent, later ones are known to be copies."""

    def __init__(self, chunk: Words, pos: np.ndarray, buckets: int):
        level = len(chunk.steps) - 1
        h = chunk.at(chunk.base(_A), level, pos, _A)
        g = (chunk.at(chunk.base(_B), level, pos, _B) >> U64(32)).astype(np.uint32)
        order = np.lexsort((g, h))  # stable: equal windows stay in the order of the documents
        h, g = h[order], g[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        self.h, self.g, self.pos, self.copies = h[new], g[new], pos[order[new]], pos[order[~new]]
        self.buckets, self.at = cuts((self.h >> U64(64 - buckets.bit_length() + 1)).astype(np.int64), buckets)
        self.chunk = chunk

    def rows(self) -> pa.Table:
        ids = self.chunk.order[np.searchsorted(self.chunk.first, self.pos, "right") - 1]
        part = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(self.at[:-1], self.at[1:], strict=True)], pa.binary())
        n = len(self.buckets)
        return pa.table({"bucket": pa.array(self.buckets, pa.int32()), "chunk": pa.array([self.chunk.number] * n, pa.int32()), "keys": part(self.h), "more": part(self.g), "ids": part(ids)})

    def later(self, answer: pa.Table) -> np.ndarray:
        """Starts of all windows that also start earlier."""
        sizes = dict(zip(self.buckets.tolist(), np.diff(self.at).tolist(), strict=True))
        return np.concatenate([self.copies, self.pos[answers(answer, 0, sizes)]]) if len(self.h) else self.copies


def not_first(rows: pa.Table) -> pa.Table:
    """Decide for a bucket of the last level: all but the first window of each kind, in the order (id, chunk, place)."""
    rows = rows.sort_by("chunk")
    h = np.frombuffer(b"".join(rows.column("keys").to_pylist()), U64)
    g = np.frombuffer(b"".join(rows.column("more").to_pylist()), np.uint32)
    ids = np.frombuffer(b"".join(rows.column("ids").to_pylist()), np.int64)
    order = np.lexsort((ids, g, h))  # stable: equal ids stay in the order of chunk and place
    copy = np.zeros(len(h), bool)
    a, b = order[1:], order[:-1]
    copy[a] = (h[a] == h[b]) & (g[a] == g[b])
    size = [len(x) // 8 for x in rows.column("keys").to_pylist()]
    bits = [pack(copy[e - n : e]) for n, e in zip(size, np.cumsum(size), strict=True)]
    return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "bits": pa.array(bits, pa.binary())})


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, with_text: bool = True) -> DataFrame:
    """One row per document: id_col, n_words, n_removed, kept_sha256[, kept: the words left, joined by one space].

    Words are [^\\x20\\x09-\\x0D]+; a word goes if a window of `window` words covers it whose words also start earlier:
    at a smaller id, or before in the same document. Null and empty texts have no words. A null id comes before all
    others; rows of one id are ordered by text and fully repeated rows are documents of their own, so all but one
    of them lose every window. Texts are taken whole, ids are read as bigint, other columns aren't looked at.

    Windows are compared by 96 bits. A window that is frequent in a chunk is sent once from it, so a hot passage
    reaches its bucket at most once for each chunk.
    """
    chunks, buckets = layout(docs)
    steps = lengths(window, least_words)
    source = chunked(docs, id_col, text_col, chunks)
    final = len(steps) - 1

    def windows(chunk: Words, level: int, answer: pa.Table | None) -> np.ndarray:
        """Candidates of a level, from the answers to the level below."""
        if level == 0:
            return doc_rows(chunk.first, steps[0])
        pos = doc_rows(chunk.first, steps[level - 1])
        if level > 1:  # what was alive then has come along with the answers
            alive = np.zeros(len(pos), bool)
            for raw in answer.filter(pa.compute.equal(answer.column("bucket"), -1)).column("bits").to_pylist():
                alive = unpack(raw, len(pos))
            pos = pos[alive]
        answer = answer.filter(pa.compute.greater_equal(answer.column("bucket"), 0))
        again = Keys(chunk.at(chunk.base(_A), level - 1, pos, _A), buckets, KEY_BYTES).repeated(answer)
        return chunk.extended(level, pos, again)

    def send(level: int):
        def run(rows: pa.Table, answer: pa.Table | None) -> pa.Table:
            if not rows.num_rows:
                return pa.table({"bucket": pa.array([], pa.int32()), "chunk": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()), **({"more": pa.array([], pa.binary()), "ids": pa.array([], pa.binary())} if level == final else {})})
            chunk = Words(rows, steps)
            pos = windows(chunk, level, answer)
            alive = np.zeros(len(chunk.hashes) + 1, bool)
            alive[pos] = True
            mine = pack(alive[doc_rows(chunk.first, steps[level])])
            if level == final:
                sent = Last(chunk, pos, buckets).rows()
                note = {"more": pa.array([b""], pa.binary()), "ids": pa.array([b""], pa.binary())}
            else:
                sent, note = Keys(chunk.at(chunk.base(_A), level, pos, _A), buckets, KEY_BYTES).rows(chunk.number), {}
            # a note to the chunk itself, by way of a bucket of its own: which windows are alive
            note = {"bucket": pa.array([-1 - chunk.number], pa.int32()), "chunk": pa.array([chunk.number], pa.int32()), "keys": pa.array([mine], pa.binary())} | note
            return pa.concat_tables([sent, pa.table(note)]) if level else sent

        return run

    def decide(level: int):
        inner = not_first if level == final else shared_keys(KEY_BYTES)

        def run(rows: pa.Table) -> pa.Table:
            if rows.column("bucket")[0].as_py() < 0:
                return pa.table({"chunk": rows.column("chunk"), "bucket": pa.array([-1] * rows.num_rows, pa.int32()), "bits": rows.column("keys")})
            return inner(rows)

        return run

    answer = None
    for level in range(len(steps)):
        out = LAST_ROWS if level == final else KEY_ROWS
        if level == 0:
            first = send(0)
            sent = source.groupBy("chunk").applyInArrow(lambda rows: first(rows, None), out)
        else:
            sent = source.groupBy("chunk").cogroup(answer.groupBy("chunk")).applyInArrow(send(level), out)
        answer = sent.groupBy("bucket").applyInArrow(decide(level), ANSWER)

    def finish(rows: pa.Table, answer: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.string())] if with_text else []))})
        chunk = Words(rows, steps)
        if final:
            pos = doc_rows(chunk.first, steps[final])
            raw = answer.filter(pa.compute.equal(answer.column("bucket"), -1)).column("bits").to_pylist()
            pos = pos[unpack(raw[0], len(pos))]
            answer = answer.filter(pa.compute.greater_equal(answer.column("bucket"), 0))
        else:
            pos = doc_rows(chunk.first, steps[0])
        later = Last(chunk, pos, buckets).later(answer)
        edge = np.zeros(len(chunk.hashes) + window + 1, np.int64)
        np.add.at(edge, later, 1)
        np.add.at(edge, later + window, -1)
        gone = np.cumsum(edge)[: len(chunk.hashes)] > 0
        n = np.diff(chunk.first)
        removed, digest, kept = [], [], []
        for k in range(len(n)):
            text = chunk.data[chunk.off[k] : chunk.off[k + 1]].tobytes().split()
            mask = gone[chunk.first[k] : chunk.first[k + 1]]
            lost = int(np.count_nonzero(mask))
            left = b" ".join(compress(text, (~mask).tolist()) if lost else text)
            removed.append(lost)
            digest.append(hashlib.sha256(left).hexdigest())
            if with_text:
                kept.append(left.decode())
        out = {"id": chunk.ids, "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        return pa.table(out | ({"kept": pa.array(kept, pa.string())} if with_text else {}))

    schema = "id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept string" if with_text else "")
    done = source.groupBy("chunk").cogroup(answer.groupBy("chunk")).applyInArrow(finish, schema)
    return done.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)
