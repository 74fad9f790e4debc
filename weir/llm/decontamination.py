"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items, one scan of each text.

The automaton reads words: each word of the items has a number, which is written as two letters, so that no node has more
followers than the root of the number of words. Any other word of a text has letters that no window has. So a window of 13
words is 26 nodes, and a match ends at a word's place, from where it is mapped to the original text.
"""

from __future__ import annotations

import hashlib
import uuid
from itertools import chain, repeat
from math import isqrt

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.llm.common import claim, stored

#: Words of a window.
WINDOW = 13
#: Nodes that one automaton may have, under 100 bytes each. A larger benchmark is scanned for in blocks of items.
NODES = 4_000_000
#: Columns that carry what earlier blocks have found.
_HIT, _IDS = "hit_so_far", "ids_so_far"
#: Non-ASCII bytes and ASCII letters and digits make words; all else separates them.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def windows(words: tuple, width: int) -> list[tuple]:
    return [words[i : i + width] for i in range(max(1, len(words) - width + 1))] if words else []


#: The letters of a word that no item has.
_OTHER = (0, 0)


class Items:
    """The automaton over every item's windows, and what each window's items are."""

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            found = tuple(number.setdefault(w, len(number)) for w in normal_words(text))
            for w in windows(found, width):
                owners.setdefault(w, set()).add(item)
        base = isqrt(len(number)) + 1
        letters = [(n // base + 1, n % base + base + 1) for n in range(len(number))]
        self.letters = {w: letters[n] for w, n in number.items()}
        self.ids = [tuple(sorted(x)) for x in owners.values()]
        self.trie = None
        if owners:
            self.trie = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for k, w in enumerate(owners):
                self.trie.add_word(tuple(chain.from_iterable(letters[n] for n in w)), (k, len(w)))
            self.trie.make_automaton()

    def scan(self, text: str | None) -> tuple[int, np.ndarray, list[str]]:
        """(words, indexes of the words that are hit, ids of the items with windows in the text)."""
        words = normal_words(text)
        none = len(words), np.zeros(0, np.int64), []
        if self.trie is None or not words:
            return none
        found = list(self.trie.iter(tuple(chain.from_iterable(map(self.letters.get, words, repeat(_OTHER))))))
        if not found:
            return none
        end = np.array([x[0] for x in found]) // 2 + 1  # the place after the window's last word
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, end - [x[1][1] for x in found], 1)
        np.add.at(cover, end, -1)
        ids = {i for k in {x[1][0] for x in found} for i in self.ids[k]}
        return len(words), np.flatnonzero(np.cumsum(cover[:-1]) > 0), sorted(ids)


_built: dict[tuple, Items] = {}


def built(key: tuple, items: list[tuple[str, str | None]], width: int) -> Items:
    """The block's automaton, built once in a worker. The one before goes first, so there is one at a time."""
    claim("items", _built.clear)
    if key not in _built:
        _built.clear()
        _built[key] = Items(items, width)
    return _built[key]


def spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character ranges of the original text from the first to the last word of each run of hit words."""
    raw = text.encode()
    is_word = np.frombuffer(raw.translate(_TABLE), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], is_word.view(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cut = np.flatnonzero(np.diff(hit) > 1)
    first, last = hit[np.concatenate([[0], cut + 1])], hit[np.concatenate([cut, [len(hit) - 1]])]
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(int(chars[begin[f]]), int(chars[end[k]])) for f, k in zip(first, last, strict=True)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, with_spans: bool = True, carry: list[str] | None = None, share: tuple[int, int] = (1, 20), nodes: int = NODES, prefix: str = "") -> DataFrame:
    """One row per document: its id, n_words, n_hit, n_items, item_ids, contaminated[, spans][, carried columns].

    A document is contaminated when n_hit > 0 and n_hit / n_words is at least share. Null and empty texts have no
    words and no hits, an item without words matches nothing, repeated rows of either table are each scanned or
    count once; a null item id is read as the text "null". A prefix keeps new columns apart from carried ones of their name. Spans are character offsets into the original text.

    Very long texts are scanned whole.

    The benchmark is a stated query set: its nodes are counted first, and beyond `nodes` it is scanned for in
    blocks, one automaton each, whose hits are joined by word position, so what a task holds stays bounded.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"), F.col(item_text).alias("t"))
    n = F.regexp_count(F.coalesce("t", F.lit("")), F.lit(_WORD))
    total = items.agg(F.sum(F.when(n > 0, 2 * F.least(n, F.lit(window)) * F.greatest(F.lit(1), n - (window - 1))))).first()[0] or 0
    blocks = max(1, -(-total // nodes))
    kept = list(dict.fromkeys([id_col, *(carry or [])]))
    kinds = {f.name: f for f in docs.schema.fields}
    num, den = share
    so_far = [T.StructField(prefix + _HIT, T.ArrayType(T.LongType())), T.StructField(prefix + _IDS, T.ArrayType(T.StringType()))]
    result = T.StructType([
        *(kinds[c] for c in kept),
        T.StructField(prefix + "n_words", T.LongType()), T.StructField(prefix + "n_hit", T.LongType()), T.StructField(prefix + "n_items", T.LongType()),
        T.StructField(prefix + "item_ids", T.ArrayType(T.StringType())), T.StructField(prefix + "contaminated", T.BooleanType()), T.StructField(prefix + "items_sha256", T.StringType()),
        *([T.StructField(prefix + "spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])))] if with_spans else []),
    ])
    passed = list(dict.fromkeys([*kept, text_col]))

    def step(block: int):
        rows = [(r.i, r.t) for r in items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).collect()]
        sent, first, last = spark.sparkContext.broadcast(rows), block == 0, block == blocks - 1
        key = (uuid.uuid4().hex, block)

        def run(batches):
            found = built(key, sent.value, window)
            for batch in batches:
                out = []
                before = zip(batch.column(prefix + _HIT).to_pylist(), batch.column(prefix + _IDS).to_pylist(), strict=True) if not first else repeat(([], []))
                for text, (had, ids_had) in zip(batch.column(text_col), before, strict=False):
                    text = text.as_py()
                    n, hit, ids = found.scan(text)
                    if had:
                        hit = np.union1d(hit, np.array(had, np.int64))
                    ids = sorted({*ids, *ids_had})
                    out.append((n, hit, ids, spans(text, hit) if with_spans and last and len(hit) else []))
                if not last:
                    cols = [batch.column(c) for c in passed] + [pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(cols, names=[*passed, prefix + _HIT, prefix + _IDS])
                    continue
                cols = [batch.column(c) for c in kept]
                cols += [
                    pa.array([x[0] for x in out], pa.int64()), pa.array([len(x[1]) for x in out], pa.int64()), pa.array([len(x[2]) for x in out], pa.int64()),
                    pa.array([x[2] for x in out], pa.list_(pa.string())), pa.array([len(x[1]) > 0 and den * len(x[1]) >= num * x[0] for x in out], pa.bool_()),
                    pa.array([hashlib.sha256(",".join(x[2]).encode()).hexdigest() for x in out], pa.string()),
                ]
                if with_spans:
                    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                    cols.append(pa.array([[{"start": s, "stop": e} for s, e in x[3]] for x in out], kind))
                yield pa.RecordBatch.from_arrays(cols, names=result.names)

        return run, result if last else T.StructType([*(kinds[c] for c in passed), *so_far])

    now = docs.select(*passed)
    for k in range(blocks):
        now = now.mapInArrow(*step(k))
        if k < blocks - 1:
            now = stored(now, "decontamination")
    return now
