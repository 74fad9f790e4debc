import random
import re

import pytest

from tests.conftest import SF
from tests.llm.edges import RAW, docs, edge_docs, empty_docs, rows_of
from weir.llm import queries
from weir.llm.components import components
from weir.llm.jaccard_join import jaccard_join, without_near_copies


def sets(texts, width):
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        yield {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def brute(rows, width, num, den):
    s = list(sets((t for _, t in rows), width))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (both := len(s[a] & s[b])) and den * both >= num * (len(s[a]) + len(s[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s[k]), least.get(find(k)) if s[k] else i) for k, (i, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("width, num, den", [(4, 85, 100), (2, 60, 100), (1, 1, 2)])
def test_random(spark, width, num, den):
    rnd = random.Random(width)
    base = [[rnd.choice("abcdefgh") + rnd.choice("XYzw") for _ in range(rnd.choice([3, 20, 60, 120]))] for _ in range(10)]
    rows = []
    for _ in range(200):
        b = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4, 9])):
            b[rnd.randrange(len(b))] = rnd.choice("pqrs") + str(rnd.randint(0, 9))
        rows.append((rnd.randint(0, 300), " ".join(b)))
    rows += rows[:5] + [(None, rows[3][1]), (None, None), (None, "solo one"), (470, None), (471, ""), (472, "a b"), (473, "A  b"), (474, "a b c"), (475, "A\nB c")]
    assert rows_of(jaccard_join(docs(spark, rows), width, (num, den)), "doc_id", "n_shingles", "component_id") == brute(rows, width, num, den)


def test_chain_of_near_copies_is_one_component(spark):
    words = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(40):  # neighbours link, the ends share little
        rows.append((k, " ".join(words)))
        words[(k * 5) % 200] = f"changed{k}"
    got = rows_of(jaccard_join(docs(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert got == brute(rows, 4, 85, 100) and {r[2] for r in got} == {0}


@pytest.mark.parametrize("block, levels, width, num, den", [(2, 1, 1, 85, 100), (2, 3, 1, 1, 2), (3, 2, 2, 80, 100)])
def test_long_lists_are_divided(spark, monkeypatch, block, levels, width, num, den):
    """One shingle, or a few, in many unlike documents, with near copies among them; blocks far smaller than lists."""
    from weir.llm import jaccard_join as module

    monkeypatch.setattr(module, "BLOCK", block)
    monkeypatch.setattr(module, "LEVELS", levels)
    monkeypatch.setattr(module, "SALT_ROWS", 3)
    monkeypatch.setattr(module, "ROW_COST", 0)
    monkeypatch.setattr(module, "PAIRED", 4)
    rnd = random.Random(block + levels + width)
    rows, common = [], [f"hot{k}" for k in range(6)]
    for k in range(120):
        own = [rnd.choice("abcdefghij") + str(rnd.randint(0, 3)) for _ in range(rnd.choice([0, 1, 2, 5, 9]))]
        rows.append((k, " ".join(common[: rnd.choice([1, 2, 6])] + own)))
        if k % 4 == 0:
            rows.append((1000 + k, rows[-1][1] + f" extra{k}"))
    assert rows_of(jaccard_join(docs(spark, rows), width, (num, den)), "doc_id", "n_shingles", "component_id") == brute(rows, width, num, den)


def test_a_hot_shingle_makes_no_square_of_pairs(spark, monkeypatch):
    """Thousands of unlike documents that share a line: the pairs that are compared stay near their number."""
    from weir.llm import jaccard_join as module

    compared = []
    real = module.verified

    def counted(pairs, *rest):
        pairs = module.stored(pairs)
        compared.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(module, "verified", counted)
    rnd = random.Random(4)
    line = "all of these documents have this one line of text".split()
    n = 3000
    rows = [(k, " ".join(line + [f"w{rnd.randint(0, 400)}" for _ in range(rnd.choice([2, 3, 4]))])) for k in range(n)]
    got = rows_of(jaccard_join(docs(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert len(got) == n and sum(compared) < 20 * n
    sample = rnd.sample(range(n), 400)
    near = brute([rows[k] for k in sample], 4, 85, 100)
    label = {r[0]: r[2] for r in got}
    assert all(label[i] == label[c] for i, _, c in near)


def test_rows_of_one_id_are_told_apart(spark):
    words = [f"w{k}" for k in range(40)]
    near = [*words[:-1], "other"]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (2, "quite another text that is like no other one"), (3, ""), (3, None), (None, " ".join(words)), (4, "of four words only"), (4, "of four words only")]
    kept = rows_of(without_near_copies(docs(spark, rows)), "doc_id", "text")
    assert kept == sorted([rows[0], rows[2], rows[3], rows[4], rows[6], rows[7]], key=repr)
    assert without_near_copies(edge_docs(spark)).columns == edge_docs(spark).columns


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = rows_of(queries.queries()["op5_jaccard_join"](spark, SF), "doc_id", "n_shingles", "component_id")
    want = brute(rows, 4, 85, 100)
    assert got == want and any(r[0] != r[2] for r in want)


def test_edges(spark):
    got = rows_of(jaccard_join(edge_docs(spark)), "doc_id", "n_shingles", "component_id")
    assert got == brute([r[:2] for r in RAW], 4, 85, 100)
    assert jaccard_join(empty_docs(spark)).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 100), (100, 100), (7, 7), (None, 3), (200, 205), (205, 203), (203, 201)] + [(300, 300 + k) for k in range(1, 20)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(31)} | {100: 100, 101: 100} | {k: 200 for k in (200, 201, 203, 205)} | {k: 300 for k in range(300, 320)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
