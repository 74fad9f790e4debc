import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import SF
from tests.llm.edges import RAW, docs, edge_docs, empty_docs, rows_of
from weir.llm import queries, suffix_dedup
from weir.llm.substring_dedup import lengths, substring_dedup


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def by_words(rows, width):
    seen, out = set(), []
    for i, t in in_order(rows):
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if key in seen:
                gone[k : k + width] = [True] * width
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def by_bytes(rows, length):
    seen, out = set(), []
    for i, t in in_order(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            key = hashlib.blake2b(raw[k : k + length], digest_size=16).digest()
            if key in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(key)
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


WORDS = ("doc_id", "n_words", "n_removed", "kept_sha256")
BYTES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("width, least", [(20, 8), (6, 2), (5, 1), (7, 2), (3, 8), (1, 1)])
def test_random_words(spark, width, least):
    rnd = random.Random(width)
    voc = ["a", "b", "c d", "é\t", "\n", "x" * 30, "\x00", "　"]
    rows = [(rnd.randint(0, 60), "".join(rnd.choice(voc) + rnd.choice([" ", "  ", ""]) for _ in range(rnd.choice([0, 1, 5, 40, 300])))) for _ in range(60)]
    rows += rows[:5] + [(None, rows[3][1]), (None, None), (70, None), (71, ""), (72, rows[4][1] + " " + rows[4][1])]
    out = substring_dedup(docs(spark, rows), width, least_words=least)
    assert rows_of(out, *WORDS) == by_words(rows, width)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in out.collect())


def test_lengths():
    assert lengths(20, 8) == [10, 20] and lengths(7, 2) == [2, 4, 7] and lengths(3, 8) == [3] and lengths(40, 8) == [10, 20, 40]


@pytest.mark.parametrize("length, voc", [(16, ["ab", "c", "é"]), (20, ["a", "b"]), (33, ["aaaaa", "b"]), (100, ["the ", "an ", "x"]), (17, ["a"])])
def test_random_bytes(spark, length, voc):
    rnd = random.Random(length)
    rows = [(rnd.randint(0, 60), "".join(rnd.choice(voc) for _ in range(rnd.choice([0, 1, 5, 40, 300])))) for _ in range(60)]
    rows += rows[:5] + [(None, rows[3][1]), (None, None), (70, None), (71, ""), (72, rows[4][1] * 2), (73, "a" * 500), (74, "ab" * 300), (75, "z" + "ab" * 200 + "q")]
    out = suffix_dedup.suffix_dedup(docs(spark, rows), length)
    assert rows_of(out, *BYTES) == by_bytes(rows, length)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out.collect())


def test_whole_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries.queries()["op6_substring_dedup"](spark, SF), *WORDS) == by_words(rows, 20)
    assert rows_of(queries.queries()["op10_suffix_array_dedup"](spark, SF), *BYTES) == by_bytes(rows, 100)


def test_edges(spark):
    rows = [r[:2] for r in RAW]
    assert rows_of(substring_dedup(edge_docs(spark)), *WORDS) == by_words(rows, 20)
    assert rows_of(suffix_dedup.suffix_dedup(edge_docs(spark)), *BYTES) == by_bytes(rows, 100)
    assert substring_dedup(empty_docs(spark)).count() == suffix_dedup.suffix_dedup(empty_docs(spark)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.suffix_dedup(edge_docs(spark), 15)


def test_chunks_too_large_for_a_worker_are_refused(spark, monkeypatch):
    from weir.llm import blobs

    table = spark.read.parquet(f"{SF}/documents.parquet")
    assert blobs.layout(table)[0] >= 1
    monkeypatch.setattr(blobs, "MOST_BYTES", 100)
    with pytest.raises(ValueError, match="shuffle partitions"):
        substring_dedup(table)
    assert blobs.layout(docs(spark, [(1, "x")]).repartition(2))[0] >= 1  # a source of unknown size


def test_texts_have_wide_offsets():
    from weir.llm.blobs import Chunk

    c = Chunk(pa.table({"chunk": pa.array([0, 0, 0], pa.int32()), "id": pa.array([2, 1, None]), "text": pa.chunked_array([["bb", "a"], [None]], pa.string())}))
    assert c.off.dtype == np.int64 and c.data.tobytes() == b"abb" and c.order.tolist() == [1, 2, blobs_null()]


def blobs_null():
    from weir.llm.blobs import NULL_ID

    return NULL_ID


def test_stretches_do_not_depend_on_blocks(monkeypatch):
    rnd = random.Random(2)
    text = "".join(rnd.choice(["ab", "c", "de "]) for _ in range(3000))
    rows = pa.table({"chunk": pa.array([0, 0], pa.int32()), "id": pa.array([1, 2]), "text": pa.array([text, text[500:]])})

    def places(c):
        at = suffix_dedup._places(c.begin, c.count)
        return dict(zip(at.tolist(), np.repeat(c.half, c.count).tolist(), strict=True))

    whole = suffix_dedup.Stretches(rows, 40)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    assert places(suffix_dedup.Stretches(rows, 40)) == places(whole)


@pytest.mark.parametrize("length", [5, 7, 16, 50])
def test_ranks_are_the_suffix_order(length):
    rnd = random.Random(length)
    raw = bytes(rnd.choice(b"ab") for _ in range(400))
    want = np.arange(len(raw) - length + 1)
    rank = suffix_dedup.ranks(np.frombuffer(raw, np.uint8), np.full(len(raw), len(raw)), length, want)
    cut = [raw[k : k + length] for k in want]
    order = {s: k for k, s in enumerate(sorted(set(cut)))}
    assert rank.tolist() == [order[s] for s in cut]
    found = suffix_dedup.longest_previous(np.frombuffer(raw, np.uint8), rank, want, length)
    assert [x == length for x in found] == [s in cut[:k] for k, s in enumerate(cut)]


def common(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("length, letters", [(5, b"ab"), (16, b"ab"), (30, b"abc"), (12, b"a"), (9, bytes(range(256)))])
def test_longest_previous_factors_are_those_of_all_pairs(length, letters):
    rnd = random.Random(length)
    raw = bytes(rnd.choice(letters) for _ in range(300))
    raw += raw[40:120] + b"\0\xff" + raw[:30]
    want = np.sort(np.array(rnd.sample(range(len(raw) - length + 1), 250)))
    text = np.frombuffer(raw, np.uint8)
    rank = suffix_dedup.ranks(text, np.full(len(raw), len(raw)), length, want)
    found = suffix_dedup.longest_previous(text, rank, want, length)
    cut = [raw[k : k + length] for k in want]
    assert found.tolist() == [max((common(cut[j], s) for j in range(k)), default=0) for k, s in enumerate(cut)]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 65, 300])
def test_previous_smaller(n):
    for x in (np.random.default_rng(n).permutation(n), np.arange(n), np.arange(n)[::-1].copy()):
        got = suffix_dedup.previous_smaller(x)
        assert got.tolist() == [max((j for j in range(k) if x[j] < x[k]), default=-1) for k in range(n)]
