import hashlib
import random
import re

import pytest

from tests.conftest import SF
from tests.llm.edges import docs, edge_docs, empty_docs, rows_of
from weir.llm import queries
from weir.llm.decontamination import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(texts, items, width):
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            grams.setdefault(tuple(w[k : k + width]), set()).add("null" if i is None else str(i))
    sizes = {len(g) for g in grams}
    for t in texts:
        w = words(t)
        hit, ids = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (owners := grams.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    ids |= owners
        yield w, sorted(hit), sorted(ids)


def test_whole_tables(spark):
    table = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = [(i, len(w), len(h), len(d), hashlib.sha256(",".join(d).encode()).hexdigest(), len(h) > 0 and 20 * len(h) >= len(w)) for i, (w, h, d) in zip(table, brute(table.values(), items, 13), strict=True)]
    got = queries.queries()["op4_benchmark_decontamination"](spark, SF)
    assert rows_of(got, *got.columns) == sorted(want, key=repr) and sum(x[5] for x in want) > 0


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_random_items_in_one_or_more_blocks(spark, block):
    rnd = random.Random(5)
    voc = ["a", "b", "C", "é", "1", "b.", "-"]
    text = lambda n: "".join(rnd.choice(voc) + rnd.choice([" ", ", ", "\n", ""]) for _ in range(n))
    texts = [text(rnd.choice([0, 3, 30, 90])) for _ in range(40)] + [None, "", "..."]
    items = [(k, text(rnd.choice([0, 2, 4, 9]))) for k in range(25)] + [(None, "b b b b"), (3, None), (4, "a b C a b"), (4, "a b C a b")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = {r.doc_id: r for r in decontaminate(docs(spark, enumerate(texts)), bench, window=4, nodes=block).collect()}
    for k, (w, hit, ids) in enumerate(brute(texts, items, 4)):
        r = got[k]
        assert (r.n_words, r.n_hit, r.item_ids, r.n_items) == (len(w), len(hit), ids, len(ids))
        covered = [x for s in r.spans for x in words(texts[k][s.start : s.stop])]
        assert covered == [w[j] for j in hit]


def test_edges(spark):
    bench = spark.createDataFrame([(1, "one"), (None, None), (2, "")], "item_id int, text string")
    out = decontaminate(edge_docs(spark), bench, carry=edge_docs(spark).columns, prefix="d_")
    assert [(r.doc_id, r.d_n_hit) for r in out.filter("d_contaminated").collect()] == [(4, 1)] and out.count() == edge_docs(spark).count()
    assert decontaminate(edge_docs(spark), bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate(empty_docs(spark), bench).count() == 0
    assert set(r.d_n_words for r in out.filter("text IS NULL OR text = ''").collect()) == {0}


def test_memory_of_a_node():
    """A block of NODES stays under 500 MB: what 200,000 nodes take, scaled. Word numbers beyond 16 bits are told apart."""
    import os

    from weir.llm.decontamination import NODES, Items

    def rss():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    rnd = random.Random(1)
    items = [(str(k), " ".join(f"w{rnd.randint(0, 200_000)}" for _ in range(100))) for k in range(1300)]
    before = rss()
    found = Items(items, 13)
    nodes = 1300 * 88 * 26
    assert (rss() - before) / nodes * NODES < 500 << 20
    assert len(found.letters) > 70_000 and found.scan("x " + items[7][1] + " x")[2] == ["7"] and found.scan(" ".join(items[7][1].split()[:12]))[2] == []
