"""Toxicity: a support vector machine on a subsequence string kernel with Nystroem landmarks, over labelled sentences.

The kernel of two words sums, over all subsequences of three characters that span at most MAX_SPAN, the product of
decay^span in either word; words carry marks at both ends, and the kernel is divided by a norm for either length.
So "idxiot", "i-d-i-o-t" or "id_iot" stay close to "idiot". A long word is read in overlapping windows, so a word glued
to others is compared by itself, and no letter is left out. A sentence is as toxic as its most toxic word (the
word is latent, as in multiple-instance learning): sentences of clean documents are negative, and of a toxic
document those are positive that hold its most toxic words. Landmarks are words that labelled documents tell apart.
On landmarks the machine is linear, and since a landmark's side of the kernel is linear in its subsequences, the
trained machine folds into one weight for each subsequence. A document's score is a logistic function of its
sentences' margins.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.common import claim, held_out, labelled_sample

DECAY, MAX_SPAN = 0.6, 6
LANDMARKS_FOR, LANDMARKS_AGAINST = 112, 80
COST = 1000.0
#: Bounds of the sample of labelled documents that the machine is trained on, for each label.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1_000, 1_500
#: Words of the sample that are trained on: those with so much kernel to a landmark of toxic documents, and so many others.
ACTIVE, OTHERS = 0.4, 20_000
#: The bias before training, and the margin of no words at all.
FLOOR = -1.0
#: Margins below this are not told apart in a document.
HIGH = -0.25
#: Longer words are read in all windows of so many characters, marks included; to train, in windows STRIDE apart.
WINDOW, STRIDE = 10, 2
#: Characters of the words that are scored in one step (a longer word is a step).
STEP_CHARS = 20_000
#: Bytes of the words that a worker remembers in one of two generations; bounds memory only.
CACHE_BYTES = 24 << 20
#: Texts that are scored together.
BATCH = 512
#: Bytes that Python needs for an entry beside its text.
_ENTRY = 130
_SENTENCE = re.compile(r"[.!?]+\s|\n")
_SPACED = re.compile(r"(?<!\S)[^\W\d_](?:[ ]+[^\W\d_](?!\S)){2,}")
_NOT_LETTER = re.compile(r"[\W\d_]+")
#: Marks that often stand at a word's side; what is left of the word then needs no pattern.
_MARKS = ".,;:!?\"'()[]"
_LOW = (HIGH,)
_GAPS = [(a, b) for b in range(2, MAX_SPAN) for a in range(1, b)]
#: Bits of a table that tells most codes without a weight apart, before the exact search.
_SIEVE = 20


def letters(word: str) -> str:
    return word if word.isalpha() else _NOT_LETTER.sub("", word)


def tokens(text: str) -> list[str]:
    """What white space parts, lower case, and each row of three or more single letters as one word more."""
    found = text.lower().split()
    if sum(1 for w in set(found) if len(w) == 1) > 1:
        found += [m.replace(" ", "") for m in _SPACED.findall(" ".join(found))]
    return found


def parts(token: str) -> list[str]:
    """What non-letters part in a token, from three letters on, if that is not the token's letters as they are."""
    found = [] if token.isalpha() else [w for w in _NOT_LETTER.split(token) if w]
    return [w for w in found if len(w) > 2] if len(found) > 1 else []


def windows(word: str) -> list[str]:
    """The word with its marks, or a long one's overlapping pieces: together they have all its characters."""
    full = f"^{word}$"
    last = len(full) - WINDOW
    return [full] if last <= 0 else [full[k : k + WINDOW] for k in (*range(0, last, STRIDE), last)]


def sentences(text: str) -> list[list[str]]:
    """Windows of the words of each sentence, letters only: tokens read as one word and by their parts."""
    return [[x for t in tokens(part) for w in (letters(t), *parts(t)) for x in windows(w)] for part in _SENTENCE.split(text) if part.strip()]


def codes(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, weights) of the subsequences of each window, padded with code 0 and weight 0; weights are normed."""
    n = np.array([len(w) for w in pieces])
    width = int(n.max()) if len(n) else 0
    chars = np.array(pieces, dtype=f"<U{max(width, 1)}").view(np.uint32).reshape(len(pieces), -1).astype(np.uint64)
    all_codes, all_weights = [], []
    for a, b in _GAPS:
        if width <= b:
            continue
        x, y, z = chars[:, : width - b], chars[:, a : width - b + a], chars[:, b:]
        all_codes.append((x << np.uint64(42)) | (y << np.uint64(21)) | z)
        all_weights.append(np.where(np.arange(width - b) + b < n[:, None], DECAY ** (b + 1), 0.0))
    if not all_codes:
        return np.zeros((len(pieces), 0), np.uint64), np.zeros((len(pieces), 0))
    weight = np.concatenate(all_weights, 1)
    norm = np.sqrt((weight**2).sum(1, keepdims=True))
    return np.concatenate(all_codes, 1), weight / np.where(norm > 0, norm, 1)


@dataclass
class Machine:
    """Weights of subsequences (codes sorted), the threshold, and the logistic function of a document's margins."""

    code: np.ndarray
    weight: np.ndarray
    bias: float
    logistic: np.ndarray

    def __post_init__(self):
        self.now: dict[str, tuple[float, ...]] = {}
        self.before: dict[str, tuple[float, ...]] = {}
        self.bytes = 0
        self.sieve = None

    def weights(self, code: np.ndarray) -> np.ndarray:
        """The weight of each code, 0 for one that no landmark has."""
        if self.sieve is None:
            self.sieve = np.zeros(1 << _SIEVE, bool)
            self.sieve[_slot(self.code)] = True
        out = np.zeros(code.shape)
        maybe = self.sieve[_slot(code)]
        some = code[maybe]
        at = np.minimum(np.searchsorted(self.code, some), len(self.code) - 1)
        out[maybe] = np.where(self.code[at] == some, self.weight[at], 0.0)
        return out

    def margins(self, words: list[str]) -> np.ndarray:
        """Margins of words of letters; a long word has that of its most toxic window, of all its windows."""
        full = [f"^{w}$" for w in words]
        size = np.array([len(w) for w in full], np.int64)
        order = np.argsort(size, kind="stable")
        result = np.full(len(words), self.bias)
        at = 0
        while at < len(order):  # words of about one length, so that the arrays of a step stay small
            near = size[order[at : at + STEP_CHARS // 2]]
            stop = at + max(1, int(np.searchsorted(near * np.arange(1, len(near) + 1), STEP_CHARS, "right")))
            part = order[at:stop]
            result[part] += self._best([full[k] for k in part.tolist()], size[part])
            at = stop
        return result

    def _best(self, full: list[str], size: np.ndarray) -> np.ndarray:
        """The greatest normed sum over a window of each word: sums of weights by place and span, run over the places."""
        width = int(size.max())
        chars = np.array(full, dtype=f"<U{width}").view(np.uint32).reshape(len(full), -1).astype(np.uint64)
        sums = np.zeros((len(full), max(1, width - WINDOW + 1)))
        for b in range(2, min(MAX_SPAN, width)):
            ends = chars[:, : width - b] << np.uint64(42) | chars[:, b:]
            here = np.zeros(ends.shape)
            for a in range(1, b):
                here += self.weights(ends | chars[:, a : width - b + a] << np.uint64(21))
            here *= DECAY ** (b + 1) * (np.arange(width - b) + b < size[:, None])
            run = np.concatenate([np.zeros((len(full), 1)), np.cumsum(here, 1)], 1)
            first = np.arange(sums.shape[1])
            sums += run[:, np.minimum(first + WINDOW - b, width - b)] - run[:, first]
        sums[np.arange(sums.shape[1]) > np.maximum(size - WINDOW, 0)[:, None]] = -np.inf
        return sums.max(1) / _NORM[np.minimum(size, WINDOW)]

    def learn(self, words: set[str]) -> dict[str, tuple[float, ...]]:
        """Margins by word as it stands in a text; the words asked for are in it. What is no more than HIGH reads as HIGH.

        Of a word with parts there is a margin for each part, and that of all its letters as one word stands in the
        place of the greatest, if it is greater.
        """
        if self.bytes > CACHE_BYTES:  # between two batches, so that a batch finds all its words
            self.before, self.now, self.bytes = self.now, {}, 0
        now, new, split, asked = self.now, [], [], []
        for w in words.difference(now):
            known = self.before.get(w)
            if known is None:
                core = w.strip(_MARKS)
                some = [] if core.isalpha() else parts(w)
                new.append(w)
                split.append(len(some))
                asked.append(core if core.isalpha() else letters(w))
                asked += some
            else:
                now[w] = known
                self.bytes += _ENTRY + len(w)
        got = np.maximum(self.margins(asked), HIGH).tolist()
        at = 0
        for w, n in zip(new, split, strict=True):
            if n:
                whole, rest = got[at], got[at + 1 : at + 1 + n]
                worst = max(range(n), key=rest.__getitem__)
                rest[worst] = max(rest[worst], whole)
                now[w] = tuple(rest)
                self.bytes += 32 * n
            else:
                now[w] = _LOW if got[at] == HIGH else (got[at],)
            at += 1 + n
            self.bytes += _ENTRY + len(w)
        return now

    def features(self, texts: list[str]) -> np.ndarray:
        lists = [tokens(t) for t in texts]
        known = self.learn(set().union(*lists)).__getitem__
        return np.array([pooled(list(chain.from_iterable(map(known, x)))) for x in lists]).reshape(len(texts), N_FEATURES)

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(texts)), self.features(texts)] @ self.logistic, -30, 30)))


#: The norm of a window of so many characters: the root of the sum of squares of its subsequences' weights.
_NORM = np.array([np.sqrt(sum((b - 1) * max(0, n - b) * DECAY ** (2 * b + 2) for b in range(2, MAX_SPAN))) or 1.0 for n in range(WINDOW + 1)])


def _slot(code: np.ndarray) -> np.ndarray:
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SIEVE)).astype(np.int64)


N_FEATURES = 4


def pooled(margins: list[float]) -> tuple[float, ...]:
    """The margins of a document's words as the features of its logistic function.

    The worst word (so, of the worst sentence), the mean of the worst two, the toxic words as a share that saturates at
    one in 40, and their number.
    """
    high = sorted([x for x in margins if x > HIGH], reverse=True)
    top = [*high[:2], HIGH, HIGH][:2]
    over = sum(1 for x in high if x > 0)
    return (top[0], sum(top) / 2, min(1.0, 40 * over / max(1, len(margins))), float(np.log1p(over)))


def features_of(words: list[str], codes_sorted: np.ndarray, size: int = 500):
    """Blocks of dense rows: the weights of each word's subsequences among those in codes_sorted."""
    for k in range(0, len(words), size):
        c, x = codes(words[k : k + size])
        out = np.zeros((len(c), len(codes_sorted)))
        if c.shape[1]:
            at = np.minimum(np.searchsorted(codes_sorted, c), len(codes_sorted) - 1)
            i, j = np.nonzero((codes_sorted[at] == c) & (x > 0))
            out = np.bincount(i * len(codes_sorted) + at[i, j], weights=x[i, j], minlength=out.size).reshape(out.shape)
        yield out


def hinge(rows: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float) -> tuple[np.ndarray, float]:
    """A linear machine on x[rows] with squared hinge loss, in its primal form by Newton's method, and its bias."""
    n = x.shape[1] + 1
    ridge = np.diag(np.r_[np.full(n - 1, 1 / c), 1e-6 / c])
    w = np.zeros(n)
    for _ in range(30):
        left, right = ridge.copy(), np.zeros(n)
        for k in range(0, len(rows), 4096):  # normal equations by blocks, so memory stays small
            part = x[rows[k : k + 4096]].astype(np.float64)
            part = np.c_[part, np.ones(len(part))]
            on = 1 - y[k : k + 4096] * (part @ w) > 0
            heavy = part[on] * weight[k : k + 4096][on, None]
            left += heavy.T @ part[on]
            right += heavy.T @ y[k : k + 4096][on]
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, rtol=1e-5, atol=1e-7):
            break
        w = new
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, sweeps: int = 300) -> np.ndarray:
    """Logistic weights, none but the constant below 0, so more toxic words never lower a score: Newton steps by coordinate."""
    x = np.c_[np.ones(len(x)), x]
    w, z = np.zeros(x.shape[1]), np.zeros(len(x))
    for _ in range(sweeps):
        before = w.copy()
        for j in range(len(w)):
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            slope = x[:, j] @ (weight * (p - y)) + ridge * w[j]
            bend = (x[:, j] ** 2) @ (weight * np.maximum(p * (1 - p), 1e-4)) + ridge
            new = w[j] - slope / bend
            new = max(0.0, new) if j else new
            z += x[:, j] * (new - w[j])
            w[j] = new
        if np.abs(w - before).max() < 1e-6:
            break
    return w


def train(texts: list[str], labels: list[int], weights: list[float] | None = None, rounds: int = 3) -> Machine:
    """Train on labelled documents' sentences. With one label only, or no words, every margin is the floor."""
    y = np.array(labels, np.int64)
    weight = np.ones(len(y)) if weights is None else np.array(weights, float)
    same: dict[str, str] = {}  # one object for each word, for memory
    docs = [[[same.setdefault(w, w) for w in s] for s in sentences(t or "")] for t in texts]
    yes, no = Counter(), Counter()
    for d, label in zip(docs, y, strict=True):
        (yes if label else no).update({w for s in d for w in s if len(w) > 4})
    n_yes, n_no = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    prior = (float(weight @ y) + 1) / (weight.sum() + 2)
    nothing = Machine(np.zeros(1, np.uint64), np.zeros(1), FLOOR, np.r_[np.log(prior / (1 - prior)), np.zeros(N_FEATURES)])
    # how surely toxic documents have a word more often, in standard errors
    surprise = {w: (k / n_yes - no[w] / n_no) / np.sqrt((k + no[w] + 1) / (n_yes + n_no) * (1 / n_yes + 1 / n_no)) for w, k in yes.items() if k >= 2}
    chosen = [w for w in sorted(surprise, key=lambda w: (-surprise[w], w)) if surprise[w] > 3][:LANDMARKS_FOR]
    if not chosen or not no:
        return nothing

    def laid(marks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        c, x = codes(marks)
        known = np.unique(c[x > 0])
        return known, next(features_of(marks, known, len(marks))).T

    known, table = laid(chosen)
    most = table.max(1)  # bounds the kernel to the nearest landmark for
    every = sorted(set(yes) | set(no))
    near = np.concatenate([f @ most for f in features_of(every, known)])
    active = [w for w, k in zip(every, near.tolist(), strict=True) if k >= ACTIVE]
    others = sorted((w for w, k in zip(every, near.tolist(), strict=True) if k < ACTIVE), key=lambda w: (zlib.crc32(w.encode()), w))[:OTHERS]
    active += others  # so that the margin of a word far from all landmarks is learned too
    nearest = np.concatenate([(f @ table).max(1) for f in features_of(active, known)])
    # landmarks against: words of clean documents that come nearest to those for
    rank = {w: k * np.log1p(no[w]) for w, k in zip(active, nearest.tolist(), strict=True) if no[w] * n_yes > yes[w] * n_no}
    against = sorted(rank, key=lambda w: (-rank[w], w))[:LANDMARKS_AGAINST]
    marks = chosen + against
    known, table = laid(marks)
    value, vector = np.linalg.eigh(table.T @ table)
    value, vector = value[value > 1e-6], vector[:, value > 1e-6]
    root = vector / np.sqrt(value)  # Nystroem: features k(word, landmarks) @ root
    fold = table @ root
    phi, at = np.empty((len(active), fold.shape[1]), np.float32), 0
    for f in features_of(active, known):
        phi[at : at + len(f)] = f @ fold
        at += len(f)
    place = {w: k for k, w in enumerate(active)}
    # sentences as lists of active words; a positive sentence's word is the most surely toxic one at first
    bags = [[[place[w] for w in set(s) if w in place] for s in d] for d in docs]
    del docs, every, near, same
    margin = np.array([surprise.get(w, -1.0) for w in active])
    w, b = np.zeros(root.shape[1]), FLOOR
    for turn in range(rounds):
        rows, signs, loads = [], [], []
        for bag, label, load in zip(bags, y, weight, strict=True):
            full = [s for s in bag if s]
            if label and full:
                best = [max(s, key=lambda k: (margin[k], -k)) for s in full]
                top = max(margin[best])
                take = [k for k in best if margin[k] >= (0.5 * top if top > 0 else top)]
                label = 1
            elif full:
                # at first all words, then a sentence's most toxic one
                take = [k for s in full for k in s] if not turn else [max(s, key=lambda k: (margin[k], -k)) for s in full]
                label = -1
            else:
                continue
            rows.append(np.array(take))
            signs.append(np.full(len(take), label, np.int8))
            loads.append(np.full(len(take), load / len(take)))
        if not rows:
            return nothing
        row, sign, load = np.concatenate(rows), np.concatenate(signs), np.concatenate(loads)
        if not (sign > 0).any() or not (sign < 0).any():
            return nothing
        load[sign > 0] *= 0.5 / load[sign > 0].sum()
        load[sign < 0] *= 0.5 / load[sign < 0].sum()
        key, inverse = np.unique(row * 2 + (sign > 0), return_inverse=True)
        w, b = hinge(key // 2, phi, np.where(key % 2, 1.0, -1.0), np.bincount(inverse, weights=load), c=COST)
        margin = phi @ w.astype(np.float32) + b  # without a copy of phi in double precision
    out = Machine(known, table @ (root @ w), b, np.zeros(N_FEATURES + 1))
    x = np.concatenate([out.features([t or "" for t in texts[k : k + 200]]) for k in range(0, len(texts), 200)])
    out.logistic = logistic(x, y, weight)
    return out


#: Of a longer text, which is scored whole, so many bytes of sentences are learned from: those of the least hashes.
TRAIN_BYTES = 32 << 10
THRESHOLD = 0.7


def sampled_sentences(text: str) -> str:
    """The text, or at most TRAIN_BYTES of its sentences, spread over all of it, in their order."""
    if len(text) <= TRAIN_BYTES // 4 or len(text.encode()) <= TRAIN_BYTES:
        return text
    found, left, taken = [s for s in _SENTENCE.split(text) if s.strip()], TRAIN_BYTES, []
    for k in sorted(range(len(found)), key=lambda k: (zlib.crc32(f"{k} {found[k]}".encode()), k)):
        left -= len(found[k].encode()) + 1
        if left < 0:
            break
        taken.append(k)
    return "\n".join(found[k] for k in sorted(taken))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", mod: int = 3, remainder: int = 1, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Train on a bounded sample of the labels that are not held out, weighted to the proportion of all of them.

    The sample is small by its bounds, so one task trains on it; only the machine comes to the driver.
    """
    sample, counts = labelled_sample(docs, labels, label_col, mod, remainder, (SAMPLE_CLEAN, SAMPLE_TOXIC), sampled_sentences, "string", id_col, text_col)

    def fit(batches):
        claim("training")
        rows = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("id", "label", "value")), strict=True))
        got = Counter(r[1] for r in rows)
        scale = {k: counts[k] / got[k] for k in got}
        norm = len(rows) / sum(scale[r[1]] for r in rows) if rows else 1.0
        m = train([r[2] for r in rows], [r[1] for r in rows], [scale[r[1]] * norm for r in rows])
        m = Machine(m.code, m.weight, m.bias, m.logistic)  # without what it has remembered
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(m)], pa.binary())], names=["machine"])

    found = sample.repartition(1).mapInArrow(fit, "machine binary").collect()
    return pickle.loads(found[0].machine) if found else train([], [])


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", mod: int = 3, remainder: int = 1, carry: list[str] | None = None, prefix: str = "") -> DataFrame:
    """One row per document: id_col, held_out, score in (0, 1), predicted (1 if score >= threshold)[, carried columns].

    A score depends on the whole text alone. Null counts as empty, and empty texts have a score like any other; ids
    may repeat or be null (a null id is not held out), other columns of docs are not looked at unless carried; a prefix
    then keeps the new columns' names apart from theirs. Without labels, or with labels of one kind, all documents get one low score. Scoring is one pass without a shuffle.
    """
    machine = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, label_col, mod, remainder, id_col, text_col))
    kept = list(dict.fromkeys([id_col, *(carry or [])]))

    def run(batches):
        claim("toxicity")
        for batch in batches:
            text = batch.column(text_col)
            scores = [machine.value.scores([t.as_py() or "" for t in text.slice(k, BATCH)]) for k in range(0, len(text), BATCH)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(np.concatenate([np.zeros(0), *scores]), pa.float64())], names=[*kept, f"{prefix}score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema) + f", `{prefix}score` double"
    out = docs.select(*dict.fromkeys([*kept, text_col])).mapInArrow(run, schema)
    score = F.col(f"{prefix}score")
    return out.select(*kept, held_out(F.col(id_col), mod, remainder).alias(f"{prefix}held_out"), score, (score >= threshold).cast("int").alias(f"{prefix}predicted"))
