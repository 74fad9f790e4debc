"""op1 learns from every labelled row and every pair of a good and a bad one."""

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.edges import docs
from weir.llm import quality
from weir.llm.common import held_out


def plain_slope(ranking, x, y):
    """The slope of the mean loss over all pairs, one pair at a time."""
    z = np.clip((x - ranking.mean) / ranking.scale, -8, 8)
    good, bad = z[y == 1], z[y == 0]
    p = 1 / (1 + np.exp(good @ ranking.weight - (bad @ ranking.weight)[:, None]))
    return (p.sum(1) @ bad - p.sum(0) @ good) / p.size + ranking.weight / len(y)


def test_fit_takes_all_pairs():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(500, 6))
    y = (x @ [1, -2, 0, 0.5, 0, 3] + draw.normal(size=500) > 0.4).astype(np.int64)
    got = quality.fit(x, y, float(np.mean(y == 0)))
    assert np.abs(got.weight).max() > 1 and np.abs(plain_slope(got, x, y)).max() < 1e-9
    assert np.sum(got.strengths(x) <= got.cut) == np.sum(y == 0)
    split = quality.fit(x, (x[:, 0] > 0).astype(np.int64), 0.5)  # a feature that tells the labels apart by itself
    assert np.abs(plain_slope(split, x, (x[:, 0] > 0).astype(np.int64))).max() < 1e-9
    same = quality.fit(np.ones((9, 3)), np.arange(9) % 2, 0.5)
    assert not same.weight.any() and same.cut == 0


@pytest.fixture(scope="module")
def many(spark):
    """More bad documents to learn from than op1 once took, some far from the others, ids that repeat or have no label."""
    draw = np.random.default_rng(7)
    words = [f"word{k}" for k in range(40)]
    rows = [(k, " ".join(draw.choice(words[: 30 + 10 * (k % 9 == 0)], draw.integers(1, 12))) + (" GOOD." if k % 9 == 0 and k % 2 else "") + (" |!#" * (k % 500) if k % 1000 == 1 else "")) for k in range(9000)]
    rows += [(3, "a second row of an id"), (3, "a third"), (9500, "no label")]
    labels = spark.createDataFrame([(k, int(k % 9 == 0)) for k in range(9000)], "doc_id long, quality int")
    base = docs(spark, rows).repartition(7)
    used = base.join(labels, "doc_id").filter(~held_out(base["doc_id"], 5, 0)).select("text", "quality").collect()
    x = quality.features(pa.array([r.text for r in used])).astype("<f4").astype(np.float64)
    return base, labels, x, np.array([r.quality for r in used])


def test_learning_takes_every_labelled_row(many):
    base, labels, x, y = many
    got = quality.learn(base, labels)
    assert np.sum(y == 0) > 6000
    assert np.allclose(got.mean, x.mean(0), rtol=1e-12, atol=1e-12) and np.allclose(got.scale, x.std(0) + 1e-9, rtol=1e-9)
    assert np.abs(got.weight).max() > 0.1 and np.abs(plain_slope(got, x, y)).max() < 1e-9
    assert got.cut == np.sort(got.strengths(x))[np.sum(y == 0) - 1]


def test_sums_of_many_tasks_are_added_in_groups(many, monkeypatch):
    base, labels, x, y = many
    table = quality.featured(base, labels, "quality", 5, 0, "doc_id", "text").repartition(4).persist()
    a = quality.rank_all(quality.spread_out(table))
    monkeypatch.setattr(quality, "DIRECT", 1)
    b = quality.rank_all(quality.spread_out(table))
    table.unpersist()
    assert np.allclose(a.weight, b.weight, atol=1e-9) and np.isclose(a.cut, b.cut, atol=1e-9)
    assert np.allclose(a.mean, x.mean(0)) and np.allclose(b.mean, x.mean(0))


def test_strength_of_a_rank():
    s = np.array([-3.0, -1e-300, -0.0, 0.0, 2e-310, 1.5, 1.5, 1.5, 7, 1e300])
    one = quality.Ranking(np.zeros(1), np.ones(1), np.ones(1), 0.0)
    one.strengths = lambda x: x[:, 0]
    for rank in range(len(s)):
        assert quality.at_rank(quality.local(s[::-1, None], np.zeros(len(s))), one, rank) == s[rank]


def test_a_score_does_not_hang_on_the_rows_beside_it():
    x = np.random.default_rng(2).normal(size=(1000, len(quality.NAMES)))
    r = quality.Ranking(x.mean(0), x.std(0), np.random.default_rng(3).normal(size=len(quality.NAMES)), 0.0)
    assert (np.concatenate([r.strengths(x[k : k + 7]) for k in range(0, 1000, 7)]) == r.strengths(x)).all()
