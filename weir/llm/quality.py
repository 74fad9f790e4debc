"""Quality by Bradley-Terry ranking: a text's strength is learned from preference pairs, then cut at a score quantile.

Of two labelled documents of the same training set the one labelled good is preferred. The chance of that is the
logistic function of the difference of strengths, and a strength is linear in a text's features, so the loss is
logistic on differences of features. Strengths only rank: the quantile of the training strengths at the share of
bad documents is where good begins, and the score is a logistic function that is `threshold` there.

Every labelled document that is not held out is learned from, and every pair of a good and a bad one. A pair's loss is
a smooth function of the difference of two strengths, so each strength is spread to its nearest nodes of a fine grid
by Lagrange's polynomials. Sums over all pairs are then sums over pairs of nodes, to about ten digits, and a step takes
two passes over the documents: what lies at each node, then features weighted by it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.common import LOWER, U64, claim, held_out, parallelism, slices, stored, text_buffer, word_hashes, words

#: Slots that words, lower-cased in A-Z, are hashed to; each becomes a share of all words.
SLOTS = 128
#: Rows, or drawn pairs, of one step of the normal equations.
BLOCK = 4096
#: Distance of the nodes that strengths are spread to, and nodes of a strength.
STEP, POINTS = 0.125, 10
#: Newton's steps at most; it is an error if these don't reach the minimum.
STEPS = 100
#: Tasks' sums that the driver adds up itself; more are first added in groups.
DIRECT = 32
THRESHOLD = 0.3
_BYTES = np.arange(256)
#: Classes of bytes that are counted; each becomes a share of all bytes.
CLASSES = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90), "lower": (_BYTES >= 97) & (_BYTES <= 122), "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "space": _BYTES == 32, "stop": np.isin(_BYTES, [44, 46]), "shout": np.isin(_BYTES, [33, 63]), "bar": _BYTES == 124,
    "symbol": np.isin(_BYTES, [35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 123, 125, 126]), "wide": _BYTES >= 128,
    "control": (_BYTES < 32) & (_BYTES != 10), "bracket": np.isin(_BYTES, [40, 41, 91, 93]), "mark": np.isin(_BYTES, [34, 39, 45, 47, 58, 59]),
}
_CLASS_TABLE = np.stack(list(CLASSES.values())).astype(np.float64)
NAMES = [*CLASSES, *(f"any_{k}" for k in ("upper", "shout", "bar", "symbol", "digit")), "log_bytes", "word_bytes", "distinct_words", "repeated_lines", "line_words", "odd_lines", "odd_words", "copies_in_row", *(f"words_{k}" for k in range(SLOTS))]


def shape(text: str | None) -> list[float]:
    """The features of a text that aren't hashed."""
    raw = (text or "").encode()
    n = max(1, len(raw))
    share = _CLASS_TABLE @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n
    words = raw.split()
    k = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    odd = sum(1 for x in lines if x.count(b"|") > 2 or x.count(b"!") > 2 or x.isupper())
    odd_words = sum(1 for w in words if w[-1:] in b"!|*&$%#" or (len(w) > 2 and w.isupper()))
    row = sum(1 for a, b in zip(words, words[1:]) if a == b)
    soft = np.sqrt(share[[0, 5, 6, 7, 2]])
    return [*share.tolist(), *soft.tolist(), np.log(n), sum(map(len, words)) / k / 10, len(set(words)) / k ** 0.9, 1 - len(set(lines)) / m, np.log1p(k / m), odd / m, odd_words / k, row / k]


def hashed(texts: pa.Array) -> np.ndarray:
    """For each text the square roots of the shares of its words that fall into each slot."""
    data, off = text_buffer(texts)
    out = []
    for a, b in slices(off):
        part = LOWER[data[off[a] : off[b]]]
        starts, first = words(part, off[a : b + 1] - off[a])
        slot = (word_hashes(part, starts) >> U64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        n = np.diff(first)
        row = np.repeat(np.arange(b - a), n)
        out.append(np.sqrt(np.bincount(row * SLOTS + slot, minlength=(b - a) * SLOTS).reshape(-1, SLOTS) / np.maximum(n, 1)[:, None]))
    return np.concatenate(out) if out else np.zeros((0, SLOTS))


def features(texts: pa.Array) -> np.ndarray:
    """A row of NAMES for each text."""
    x = np.array([shape(t.as_py()) for t in texts]).reshape(len(texts), len(NAMES) - SLOTS)
    return np.concatenate([x, hashed(texts)], 1)


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def strengths(self, x: np.ndarray) -> np.ndarray:
        """Each row is summed by itself, so that its strength doesn't hang on the rows beside it."""
        return (self.scaled(x) * self.weight).sum(1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        shift = np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(self.strengths(x) - self.cut + shift, -30, 30)))


# ---- sums over all rows -------------------------------------------------------------------------

#: Ascending keys and a row of sums for each.
Sums = tuple[np.ndarray, np.ndarray]
#: What a pass makes of the features and labels of a block of rows.
Work = Callable[[np.ndarray, np.ndarray], Sums]
#: The sums of a pass over all rows.
Total = Callable[[Work], Sums]


def added(parts: Iterable[Sums]) -> Sums:
    parts = [p for p in parts if len(p[0])]
    if not parts:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    keys, rows = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(keys[order]) != 0])
    return keys[order][first], np.add.reduceat(rows[order], first, axis=0)


def blocks(work: Work, x: np.ndarray, y: np.ndarray) -> Iterator[Sums]:
    for k in range(0, len(y), BLOCK):
        yield work(x[k : k + BLOCK].astype(np.float64), y[k : k + BLOCK].astype(np.int64))


def local(x: np.ndarray, y: np.ndarray) -> Total:
    return lambda work: added(blocks(work, x, y))


def matrix(col: pa.Array) -> np.ndarray:
    """The features of a binary column, a row of NAMES for each value."""
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1] if len(col) else [0, 0]
    data = col.buffers()[2]
    return np.frombuffer(data, "<f4", (off[-1] - off[0]) // 4, off[0]).reshape(-1, len(NAMES)) if len(col) else np.zeros((0, len(NAMES)), "<f4")


def packed(at: int, sums: Sums) -> dict[str, list]:
    return {"at": [at], "keys": [sums[0].astype("<i8").tobytes()], "sums": [sums[1].astype("<f8").tobytes()]}


def unpacked(keys: bytes, sums: bytes) -> Sums:
    k = np.frombuffer(keys, "<i8")
    return k, np.frombuffer(sums, "<f8").reshape(len(k), -1) if len(k) else np.zeros((0, 0))


def spread_out(table: DataFrame) -> Total:
    """Passes over the labelled rows of (label, x). A task sends nothing but its sums, and sums of many tasks are added
    in groups before the driver's. They are added in the tasks' order, so passes over the same files give the same."""
    rows = table.filter("label IS NOT NULL").select("label", "x").coalesce(parallelism(table.sparkSession))
    tasks = rows.rdd.getNumPartitions()
    schema = pa.schema([("at", pa.int32()), ("keys", pa.binary()), ("sums", pa.binary())])

    def total(work: Work) -> Sums:
        def run(batches):
            from pyspark import TaskContext

            claim("quality")
            so_far = added([])
            for batch in batches:
                for part in blocks(work, matrix(batch.column(1)), batch.column(0).to_numpy()):
                    so_far = added([so_far, part])
            yield pa.RecordBatch.from_pydict(packed(TaskContext.get().partitionId(), so_far), schema)

        def add(group: pa.Table) -> pa.Table:
            claim("quality")
            found = sorted(group.select(["at", "keys", "sums"]).to_pylist(), key=lambda r: r["at"])
            return pa.Table.from_pydict(packed(found[0]["at"], added(unpacked(r["keys"], r["sums"]) for r in found)), schema)

        sums = rows.mapInArrow(run, "at int, keys binary, sums binary")
        if tasks > DIRECT:
            sums = sums.groupBy((F.col("at") / math.isqrt(tasks)).cast("int")).applyInArrow(add, "at int, keys binary, sums binary")
        return added(unpacked(bytes(r["keys"]), bytes(r["sums"])) for r in sorted(sums.collect(), key=lambda r: r["at"]))

    return total


# ---- learning -----------------------------------------------------------------------------------


def spread(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of each strength's nearest nodes, and the weights by which a polynomial through them is read at it."""
    base = np.floor(s / STEP)
    t = s / STEP - base
    at = np.arange(POINTS) - (POINTS // 2 - 1)
    part = np.ones((len(s), POINTS))
    for k in range(POINTS):
        for j in range(POINTS):
            if j != k:
                part[:, k] *= (t - at[j]) / (at[k] - at[j])
    return base.astype(np.int64)[:, None] + at, part


def all_pairs(total: Total, start: Ranking, n_bad: int, n_good: int, ridge: float) -> np.ndarray:
    """The weights with the least mean of log(1 + exp(-d w)) over all pairs, d the difference of a pair's features, by Newton's method."""
    n, pairs, size = n_bad + n_good, float(n_bad) * n_good, len(start.weight)

    def at_nodes(w):
        """Keys (node * 2 + label), their rows, which are good, and the differences bad - good between nodes; the loss."""
        r = Ranking(start.mean, start.scale, w, 0.0)

        def work(x, y):
            nodes, part = spread(r.strengths(x))
            return added([((nodes * 2 + y[:, None]).ravel(), part.reshape(-1, 1))])

        keys, mass = total(work)
        good = (keys & 1) == 1
        gap = ((keys[~good] >> 1)[None] - (keys[good] >> 1)[:, None]) * STEP
        loss = mass[good, 0] @ np.logaddexp(0, gap) @ mass[~good, 0] / pairs + ridge / n / 2 * (w @ w)
        return r, keys, mass[:, 0], good, gap, loss

    now = at_nodes(start.weight)
    for _ in range(STEPS):
        r, keys, mass, good, gap, loss = now
        p = np.exp(-np.logaddexp(0, -gap))
        bend_at, load = p * (1 - p), np.zeros(len(keys))
        load[good], load[~good] = bend_at @ mass[~good], mass[good] @ bend_at

        def work(x, y, r=r, keys=keys, load=load):
            z, (nodes, part) = r.scaled(x), spread(r.strengths(x))
            at = np.searchsorted(keys, nodes * 2 + y[:, None])
            gram = (z * (part * load[at]).sum(1)[:, None]).T @ z
            used, column = np.unique(at, return_inverse=True)
            share = np.zeros((len(z), len(used)))
            share[np.arange(len(z))[:, None], column.reshape(at.shape)] = part
            return np.r_[np.arange(size), size + used], np.concatenate([gram, share.T @ z])

        _, rows = total(work)
        gram, (u, v) = rows[:size], (rows[size:][good], rows[size:][~good])
        slope = ridge / n * r.weight - ((p @ mass[~good]) @ u - (mass[good] @ p) @ v) / pairs
        cross = u.T @ bend_at @ v
        step = np.linalg.solve((gram - cross - cross.T) / pairs + ridge / n * np.eye(size), -slope)
        if np.abs(step).max() < 1e-6:
            return r.weight + step
        while True:  # a step that goes too far is halved
            now = at_nodes(r.weight + step)
            if now[-1] <= loss + 1e-12:
                break
            step = step / 2
            if np.abs(step).max() < 1e-9:
                raise ArithmeticError("the ranking's loss can't be lowered further, but its slope isn't zero")
    raise ArithmeticError(f"the ranking's weights don't settle in {STEPS} steps")


def ordered(s: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the strengths."""
    return flipped((s + 0.0).view(np.int64)).view(U64) ^ U64(1 << 63)


def flipped(bits: np.ndarray) -> np.ndarray:
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def at_rank(total: Total, ranking: Ranking, rank: int) -> float:
    """The strength of this rank (from 0) among all rows, 16 bits in a pass."""
    found = 0
    for shift in (48, 32, 16, 0):

        def work(x, y, found=found, shift=shift):
            k = ordered(ranking.strengths(x))
            if shift < 48:
                k = k[k >> U64(shift + 16) == U64(found)]
            digit, n = np.unique((k >> U64(shift)) & U64(0xFFFF), return_counts=True)
            return digit.astype(np.int64), n[:, None].astype(np.float64)

        digits, n = total(work)
        below = np.cumsum(n[:, 0])
        k = int(np.searchsorted(below, rank, "right"))
        rank -= int(below[k] - n[k, 0])
        found = found << 16 | int(digits[k])
    return float(flipped((np.array([found], U64) ^ U64(1 << 63)).view(np.int64)).view(np.float64)[0])


def rank_all(total: Total, ridge: float = 1.0) -> Ranking:
    """Learn strengths from all rows and all pairs of a good and a bad one. With one label only, all strengths are equal."""
    labels, rows = total(lambda x, y: added([(y, np.concatenate([np.ones((len(y), 1)), x], 1))]))
    if not len(labels):
        return Ranking(np.zeros(len(NAMES)), np.ones(len(NAMES)), np.zeros(len(NAMES)), 0.0)
    n = rows[:, 0].sum()
    mean = rows[:, 1:].sum(0) / n
    _, squares = total(lambda x, y: (np.zeros(1, np.int64), ((x - mean) ** 2).sum(0)[None]))
    start = Ranking(mean, np.sqrt(squares[0] / n) + 1e-9, np.zeros(len(mean)), 0.0)
    if len(labels) < 2:
        return start
    n_bad, n_good = int(rows[0, 0]), int(rows[1, 0])
    ranking = Ranking(start.mean, start.scale, all_pairs(total, start, n_bad, n_good, ridge), 0.0)
    ranking.cut = at_rank(total, ranking, n_bad - 1)
    return ranking


def fit(x: np.ndarray, y: np.ndarray, share_bad: float | None = None, pairs: int | None = None, ridge: float = 1.0) -> Ranking:
    """Learn strengths from the good and bad rows of x: from all pairs, or from so many drawn ones where a caller asks for
    a number, which the query never does. share_bad: where good begins, if not at the share of bad rows. With one label
    only, all strengths are equal."""
    if pairs is None:
        ranking = rank_all(local(x, y), ridge)
        if share_bad is None or not 0 < y.sum() < len(y):
            return ranking
        mean, scale, w = ranking.mean, ranking.scale, ranking.weight
    else:
        mean, scale = x.mean(0), x.std(0) + 1e-9
        w = drawn_pairs(np.clip((x - mean) / scale, -8, 8), y, pairs, ridge)
    if not 0 < y.sum() < len(y):
        return Ranking(mean, scale, w, 0.0)
    s = Ranking(mean, scale, w, 0.0).strengths(x)
    # quantile of the strengths in the proportion of all labelled documents
    share = np.mean(y == 0) if share_bad is None else share_bad
    load = np.where(y == 1, (1 - share) / np.sum(y == 1), share / np.sum(y == 0))
    order = np.argsort(s, kind="stable")
    at = int(np.searchsorted(np.cumsum(load[order]), share))
    return Ranking(mean, scale, w, float(s[order[min(at, len(s) - 1)]]))


def drawn_pairs(z: np.ndarray, y: np.ndarray, pairs: int, ridge: float) -> np.ndarray:
    """The weights with the least loss over a drawn number of pairs."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(z.shape[1])
    if not len(good) or not len(bad):
        return w
    draw = np.random.default_rng(1)
    better, worse = good[draw.integers(0, len(good), pairs)], bad[draw.integers(0, len(bad), pairs)]
    for _ in range(30):  # Newton's method on the mean of log(1 + exp(-d w)), d the difference of a pair's features
        bend, slope = ridge / len(y) * np.eye(len(w)), -ridge / len(y) * w
        for k in range(0, pairs, BLOCK):
            d = z[better[k : k + BLOCK]] - z[worse[k : k + BLOCK]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            bend = bend + (d * (p * (1 - p))[:, None]).T @ d / pairs
            slope = slope + d.T @ p / pairs
        step = np.linalg.solve(bend, slope)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def featured(docs: DataFrame, labels: DataFrame, label_col: str, mod: int, remainder: int, id_col: str, text_col: str) -> DataFrame:
    """(id, x, label) of every row, x its features in single precision, label null where it may not be learned from.

    Labels of held-out ids, null ids and labels other than 0 and 1 are never used; of several labels of an id the
    largest counts. The table is stored, since learning reads it several times and scoring once more.
    """
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id IS NOT NULL AND label IN (0, 1)")
    usable = usable.filter(~held_out(F.col("id"), mod, remainder)).groupBy("id").agg(F.max("label").alias("label"))

    def run(batches):
        claim("quality")
        for batch in batches:
            x = [row.tobytes() for row in features(batch.column(1)).astype("<f4")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], names=["id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, x binary")
    return stored(rows.join(usable, "id", "left"), "features")


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", mod: int = 5, remainder: int = 0, id_col: str = "doc_id", text_col: str = "text") -> Ranking:
    """Train on every row whose label is not held out."""
    return rank_all(spread_out(featured(docs, labels, label_col, mod, remainder, id_col, text_col)))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", mod: int = 5, remainder: int = 0) -> DataFrame:
    """One row per document: id_col, held_out, score in (0, 1), predicted (1 if score >= threshold).

    A score depends on the whole text alone. Null counts as empty, and empty texts have a score like any other; ids
    may repeat or be null (a null id is not held out), other columns of docs aren't looked at. Without labels, or with
    labels of one kind, all documents get one score, THRESHOLD. Texts are read once; learning and scoring read their
    stored features.
    """
    rows = featured(docs, labels, label_col, mod, remainder, id_col, text_col)
    ranking = docs.sparkSession.sparkContext.broadcast(rank_all(spread_out(rows)))

    def run(batches):
        claim("quality")
        for batch in batches:
            x = matrix(batch.column(1)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranking.value.scores(x), pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.select("id", "x").mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id"), mod, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
