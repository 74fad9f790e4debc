"""Suffix-array dedup: longest previous factors on the bytes of all texts, removing later copies, keeping the first.

A string of `length` bytes that occurs twice has the same smallest hash among its 16-byte grams in both places. So
each text is cut into *stretches*, runs of starting places whose leftmost smallest gram is the same one. Each string of a
stretch has a half that all its copies have too: the gram with the bytes before it, or after it. A first round finds the
halves that occur again at all (a few bytes for each, one for about 25 bytes of text), a second sends the strings that have
them, as one piece of text for a half, to the bucket of the half's hash. There all pieces of a half are one text: its
suffixes are sorted into a suffix array, the previous and next smaller positions in that order are found, and the longer
common prefix with either is the longest previous factor. A place whose factor is `length` or more starts a copy.
Factors are cut at `length`, so suffixes are ordered by their first `length` bytes, and equal ones by position.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.blobs import ANSWER, KEY_ROWS, Chunk, Keys, answers, chunked, cuts, layout, pack, shared_keys
from weir.llm.common import U64, mix, slices, stream

LENGTH = 100
GRAM = 16
#: Bytes of a hash sent in the first round beside the bits of its bucket; a false match costs a later look only.
KEY_BYTES = 4
#: Bits of a gram's hash that give way to its place in a block, and the bytes of a block.
PLACE_BITS = 24
BLOCK = 8 << 20
#: Bytes of pieces that are sorted at once, if they aren't all of one half.
BATCH = 1 << 19
_C = stream(2, 9) | U64(1)


def byte_grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place; places with fewer bytes left have none."""
    if len(data) < GRAM:
        return np.zeros(0, U64)
    two = data[:-1].astype(U64)
    two |= data[1:].astype(U64) << U64(8)
    four = two[:-2] | two[2:] << U64(16)
    eight = four[:-4] | four[4:] << U64(32)
    return mix(mix(eight[:-8] * _C[0]) + eight[8:] * _C[1])


def window_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, in two sweeps over blocks of w."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    full = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, U64)
    full[: len(x)] = x
    blocks = full.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def stretches(data: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(first place, places, how many of them, the first ones, have the left half, the halves' hashes) of the stretches in
    a buffer.

    Places are those from first to before last of each document. A string of `length` bytes has either the bytes of
    its gram and as many before it as `half`, or the gram and enough after it; those are the halves.
    """
    gram = byte_grams(data)
    marked = gram & ~U64((1 << PLACE_BITS) - 1)
    marked |= np.arange(len(gram), dtype=U64)  # so the least is the leftmost of equal ones, and says where it stands
    low = window_minimum(marked, length - GRAM + 1)
    if not len(low) or not len(first):
        return *[np.zeros(0, np.int64)] * 3, *[np.zeros(0, U64)] * 2
    edge = np.zeros(len(low) + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, last, -1)
    valid = np.cumsum(edge[:-1], dtype=np.int32) > 0
    new = valid.copy()
    new[1:] &= ~(valid[:-1] & (low[1:] == low[:-1]))
    new[first] = True
    at = np.flatnonzero(new)
    stop = np.flatnonzero(new | ~valid)
    end = np.append(stop, len(low))[np.searchsorted(stop, at, "right")]
    place = (low[at] & U64((1 << PLACE_BITS) - 1)).astype(np.int64)
    half = (length - GRAM + 1) // 2
    sides = []
    for steps in ([*range(-half, 0, GRAM), 0], [*range(0, length - GRAM - half + 1, GRAM), length - GRAM - half + 1]):
        total = np.zeros(len(at), U64)
        for k in steps:
            total = mix(total + gram[np.clip(place + k, 0, len(gram) - 1)])
        sides.append(total)
    return at, end - at, np.clip(place - half + 1 - at, 0, end - at), sides[0], ~sides[1]


class Stretches(Chunk):
    """A chunk with the parts of its documents' stretches, in order: first place, number of places, hash of their half."""

    def __init__(self, rows: pa.Table, length: int):
        super().__init__(rows)
        self.length = length
        found = []
        for a, b in slices(self.off):
            lo, hi = int(self.off[a]), int(self.off[b])
            for at in range(lo, hi, BLOCK):  # more than one only for a very long document
                first = np.maximum(self.off[a:b], at) - at
                last = np.minimum(self.off[a + 1 : b + 1] - length + 1, at + BLOCK) - at
                one = stretches(self.data[at : min(hi, at + BLOCK + length - 1)], first[last > first], last[last > first], length)
                found.append((one[0] + at, *one[1:]))
        if not found:
            found.append(stretches(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), length))
        begin, count, before, left, right = (np.concatenate(x) for x in zip(*found, strict=True))
        # a stretch is two parts at most, side by side
        self.begin = np.stack([begin, begin + before], 1).ravel()
        self.count = np.stack([before, count - before], 1).ravel()
        self.half = np.stack([left, right], 1).ravel()
        there = self.count > 0
        self.begin, self.count, self.half = self.begin[there], self.count[there], self.half[there]

    def keys(self, buckets: int) -> Keys:
        return Keys(self.half, buckets, KEY_BYTES)

    def again(self, answer: pa.Table, buckets: int) -> np.ndarray:
        """Whether a part's half occurs again."""
        return self.keys(buckets).repeated(answer)


STRETCH_ROWS = "bucket int, chunk int, keys binary, ids binary, counts binary, text binary"


class Sent:
    """Parts whose half occurs again. Of equal ones in the chunk the first is sent, the others are copies."""

    def __init__(self, chunk: Stretches, again: np.ndarray, buckets: int):
        at = np.flatnonzero(again)
        seen: set[bytes] = set()
        fresh = np.ones(len(at), bool)
        text = chunk.data.tobytes()
        bits: list[bytes] = []
        for k, (a, n) in enumerate(zip(chunk.begin[at].tolist(), chunk.count[at].tolist(), strict=True)):
            piece = text[a : a + n + chunk.length - 1]
            if piece in seen:
                fresh[k] = False
            else:
                seen.add(piece)
                bits.append(piece)
        self.copies, at = at[~fresh], at[fresh]
        bucket = (chunk.half[at] >> U64(64 - buckets.bit_length() + 1)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        self.at, self.chunk = at[order], chunk
        self.text = [bits[k] for k in order.tolist()]
        self.buckets, self.cut = cuts(bucket[order], buckets)
        self.places = [int(chunk.count[self.at[a:b]].sum()) for a, b in zip(self.cut[:-1], self.cut[1:], strict=True)]

    def rows(self) -> pa.Table:
        c, spans = self.chunk, list(zip(self.cut[:-1].tolist(), self.cut[1:].tolist(), strict=True))
        ids = c.order[np.searchsorted(c.off, c.begin[self.at], "right") - 1]
        part = lambda x: pa.array([x[a:b].tobytes() for a, b in spans], pa.binary())
        return pa.table({
            "bucket": pa.array(self.buckets, pa.int32()), "chunk": pa.array([c.number] * len(spans), pa.int32()), "keys": part(c.half[self.at]),
            "ids": part(ids), "counts": part(c.count[self.at]), "text": pa.array([b"".join(self.text[a:b]) for a, b in spans], pa.binary()),
        })

    def later(self, answer: pa.Table) -> np.ndarray:
        """All places whose `length` bytes also start earlier."""
        bits = answers(answer, 0, dict(zip(self.buckets.tolist(), self.places, strict=True)))
        c = self.chunk
        return np.concatenate([_places(c.begin[self.at], c.count[self.at])[bits], _places(c.begin[self.copies], c.count[self.copies])])


def _places(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each stretch."""
    total = int(count.sum())
    return np.arange(total) + np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) if total else np.zeros(0, np.int64)


def ranks(text: np.ndarray, piece_end: np.ndarray, length: int, want: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes at `want` by their first `length` bytes: the (cut) suffix array, by tripling.

    piece_end: end of the piece that each byte belongs to; the suffixes at `want` have `length` bytes inside theirs.
    The first ranks are of 7 bytes, read as one number; each step then joins the ranks of two or three places.
    """
    n = len(text)
    join = 3 if n < 1 << 21 else 2  # ranks that fit into 63 bits
    left = piece_end - np.arange(n)
    known = min(7, length)
    key = np.zeros(n, np.int64)
    for k in range(known):
        key[: n - k] |= text[k:].astype(np.int64) << (8 * (6 - k))
    at = np.flatnonzero(left >= known)
    rank = np.zeros(n, np.int64)
    rank[at] = np.unique(key[at], return_inverse=True)[1]
    while known < length:
        size = min(join * known, length)
        at = np.flatnonzero(left >= size) if size < length else want
        mid, last = min(known, size - known), size - known
        key = (rank[at] << 42) | (rank[at + mid] << 21) | rank[at + last] if join == 3 else (rank[at] << 31) | rank[at + last]
        new = np.zeros(n, np.int64)
        new[at] = np.unique(key, return_inverse=True)[1]
        rank, known = new, size
    return rank[want]


def previous_smaller(x: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, or -1: a descent in a table of minima."""
    n = len(x)
    low = [x]  # low[k][i]: the least of the 2**k values that end at i + 2**k - 1
    while 2 << (len(low) - 1) <= n:
        gap = 1 << (len(low) - 1)
        low.append(np.minimum(low[-1][:-gap], low[-1][gap:]))
    at = np.arange(-1, n - 1)
    for k in range(len(low) - 1, -1, -1):
        begin = at - (1 << k) + 1
        jump = begin >= 0
        jump[jump] = low[k][begin[jump]] > x[jump]
        at[jump] -= 1 << k
    return at


def common_prefix(eight: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Bytes that the suffixes at a and at b have in common, cut at `length`. eight: 8 bytes from each place, as numbers."""
    out = np.full(len(a), length, np.int64)
    left = np.arange(len(a))
    for k in range(0, length, 8):
        differ = eight[a[left] + k] ^ eight[b[left] + k]
        found = np.flatnonzero(differ)
        x, same = differ[found], np.full(len(found), k, np.int64)
        for bits in range(8, 64, 8):
            same += x < U64(1 << bits)
        out[left[found]] = same
        left = left[differ == 0]
        if not len(left):
            break
    return np.minimum(out, length)


def longest_previous(text: np.ndarray, rank: np.ndarray, position: np.ndarray, length: int) -> np.ndarray:
    """The longest previous factor of each suffix, cut at `length`: the most bytes in common with one at a smaller position.

    rank orders the suffixes, equal ones go by position. Of all suffixes at smaller positions the nearest to either side in
    that order have the longest prefix in common.
    """
    padded = np.concatenate([text, np.zeros(length + 16, np.uint8)]).astype(U64)
    two = padded[:-1] << U64(8) | padded[1:]
    four = two[:-2] << U64(16) | two[2:]
    eight = four[:-4] << U64(32) | four[4:]
    order = np.lexsort((position, rank))
    p = position[order]
    sides = previous_smaller(p), len(p) - 1 - previous_smaller(p[::-1])[::-1]
    best = np.zeros(len(p), np.int64)
    for side in sides:
        there = np.flatnonzero((side >= 0) & (side < len(p)))
        best[there] = np.maximum(best[there], common_prefix(eight, p[there], p[side[there]], length))
    out = np.empty(len(p), np.int64)
    out[order] = best
    return out


def factors(length: int):
    """Decide for a bucket: which places have a previous factor of `length` bytes, in the order (id, chunk, place)."""

    def decide(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        get = lambda name, kind: [np.frombuffer(x, kind) for x in rows.column(name).to_pylist()]
        counts = get("counts", np.int64)
        sent = np.array([len(x) for x in counts])
        keys, ids, count = np.concatenate(get("keys", U64)), np.concatenate(get("ids", np.int64)), np.concatenate(counts)
        raw = b"".join(rows.column("text").to_pylist())
        size = count + length - 1
        ends = np.cumsum(size)
        order = np.lexsort((ids, keys))  # stable; by hash first: only pieces of one half can share a string
        bits = np.zeros(int(count.sum()), bool)
        out_at = np.cumsum(count) - count
        # equal stretches: the first stays in play, later ones are copies in full
        live, seen, last = [], set(), None
        for k in order.tolist():
            if keys[k] != last:
                seen.clear()
                last = keys[k]
            piece = raw[ends[k] - size[k] : ends[k]]
            if piece in seen:
                bits[out_at[k] : out_at[k] + count[k]] = True
            else:
                seen.add(piece)
                live.append(k)
        live = np.array(live)
        # a half with one live piece has nothing to compare: two equal strings have their least grams in two places
        alone = np.ones(len(live), bool)
        same = keys[live[1:]] == keys[live[:-1]]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        live = live[~alone]
        buffer = np.frombuffer(raw, np.uint8)
        at, batch = 0, 0
        while at < len(live):  # all pieces of a half, and of several small ones, at a time
            stop, batch = at, 0
            while stop < len(live) and (batch < BATCH or keys[live[stop]] == keys[live[stop - 1]]):
                batch += int(size[live[stop]])
                stop += 1
            part = live[at:stop]
            at = stop
            text = buffer[_places(ends[part] - size[part], size[part])]
            end = np.repeat(np.cumsum(size[part]), size[part])
            want = _places(np.cumsum(size[part]) - size[part], count[part])
            found = longest_previous(text, ranks(text, end, length, want), want, length) >= length
            bits[_places(out_at[part], count[part])] |= found
        edge = np.concatenate([[0], np.cumsum([int(c.sum()) for c in counts])])
        packed = [pack(bits[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "bits": pa.array(packed, pa.binary())})

    return decide


def suffix_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True) -> DataFrame:
    """One row per document: id_col, n_bytes, n_removed, n_spans, kept_sha256[, kept: the bytes left, binary].

    A byte goes if a string of `length` (at least 16) bytes covers it that also starts earlier, at a smaller id or
    before in the same document, overlaps included. Strings don't cross documents and are judged on the input.
    Null and empty texts have no bytes. A null id comes before all others; rows of one id are ordered by text, and
    fully repeated rows are documents of their own, so all but one lose all their strings. Texts are taken whole,
    ids are read as bigint, and other columns aren't looked at.

    A piece that is frequent in a chunk is sent once from it, and equal pieces are told apart before sorting, so
    a hot passage is sorted once however often it occurs. A gram with many surroundings is parted by its halves, of 58
    bytes at a length of 100; only text whose halves, too, have very many different surroundings meets in one bucket.
    """
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    chunks, buckets = layout(docs)
    source = chunked(docs, id_col, text_col, chunks)

    def first(rows: pa.Table) -> pa.Table:
        chunk = Stretches(rows, length)
        return chunk.keys(buckets).rows(chunk.number)

    def of(answer: pa.Table, kind: int) -> pa.Table:
        return answer.filter(pc.equal(answer.column("kind"), kind)).select(["chunk", "bucket", "bits"])

    def second(rows: pa.Table, answer: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("bucket", pa.int32()), ("chunk", pa.int32()), *((n, pa.binary()) for n in ("keys", "ids", "counts", "text")))})
        chunk = Stretches(rows, length)
        return Sent(chunk, chunk.again(answer, buckets), buckets).rows()

    def finish(rows: pa.Table, answer: pa.Table) -> pa.Table:
        names = (("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.binary())] if with_bytes else []))
        if not rows.num_rows:
            return pa.table({n: pa.array([], t) for n, t in names})
        chunk = Stretches(rows, length)
        repeated = chunk.again(of(answer, 1), buckets)
        later = Sent(chunk, repeated, buckets).later(of(answer, 2))
        edge = np.zeros(len(chunk.data) + length + 1, np.int32)
        np.add.at(edge, later, 1)
        np.add.at(edge, later + length, -1)
        gone = np.cumsum(edge, dtype=np.int32)[: len(chunk.data)] > 0
        n = np.diff(chunk.off)
        removed, spans, digest, kept = [], [], [], []
        for a, b in zip(chunk.off[:-1].tolist(), chunk.off[1:].tolist(), strict=True):
            mask, text = gone[a:b], chunk.data[a:b]
            lost = int(np.count_nonzero(mask))
            left = (text[~mask] if lost else text).tobytes()
            removed.append(lost)
            spans.append(int(mask[0]) + int(np.count_nonzero(mask[1:] & ~mask[:-1])) if lost else 0)
            digest.append(hashlib.sha256(left).hexdigest())
            if with_bytes:
                kept.append(left)
        cols = [chunk.ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), *([pa.array(kept, pa.binary())] if with_bytes else [])]
        return pa.table(cols, names=[n for n, _ in names])

    one = source.groupBy("chunk").applyInArrow(first, KEY_ROWS).groupBy("bucket").applyInArrow(shared_keys(KEY_BYTES), ANSWER)
    sent = source.groupBy("chunk").cogroup(one.groupBy("chunk")).applyInArrow(second, STRETCH_ROWS)
    two = sent.groupBy("bucket").applyInArrow(factors(length), ANSWER)
    both = one.withColumn("kind", F.lit(1)).unionByName(two.withColumn("kind", F.lit(2)))
    schema = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_bytes else "")
    done = source.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(finish, schema)
    return done.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)
