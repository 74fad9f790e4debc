import zlib

import numpy as np
import pytest

from tests.llm.edges import docs, edge_docs, empty_docs
from weir.llm import quality, queries, toxicity

#: Large enough for held-out figures.
SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    return labels


def held(doc_id, mod, rest):
    return zlib.crc32(str(doc_id).encode()) % mod == rest


@pytest.mark.parametrize("name, label, mod, rest, threshold, least", [("op1_quality_ranking", "quality", 5, 0, 0.3, 0.99), ("op3_toxicity_kernel", "toxic", 3, 1, 0.7, 0.97)])
def test_held_out(spark, tables, name, label, mod, rest, threshold, least):
    got = {r.doc_id: r for r in queries.queries()[name](spark, SF).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) and r.held_out == held(i, mod, rest) for i, r in got.items())
    test = [(got[i].predicted, r[label], got[i].score) for i, r in tables.items() if got[i].held_out]
    right = np.mean([p == y for p, y, _ in test])
    wrong_yes = sum(p == 1 and y == 0 for p, y, _ in test)
    assert right >= least and wrong_yes <= 0.01 * len(test)
    s = np.array([x for _, _, x in test])
    y = np.array([x for _, x, _ in test])
    pairs = s[y == 1][:, None] - s[y == 0][None]
    assert (np.mean(pairs > 0) + 0.5 * np.mean(pairs == 0)) > 0.93


def test_held_out_labels_are_not_used(spark):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    flip = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    a, b = quality.learn(base, labels), quality.learn(base, flip)
    assert np.allclose(a.weight, b.weight) and a.cut == b.cut and np.abs(a.weight).max() > 0


def test_gapped_insults():
    clean = ["the weather in the north was fine today and the people walked", "a long list of names and places that nobody reads", "we had bread and soup for dinner in the old house"] * 12
    bad = ["you are a stupid idiot and everyone knows it", "what an idiot this stupid person is today", "such a stupid plan from an idiot again"] * 8
    m = toxicity.train(clean + bad, [0] * len(clean) + [1] * len(bad))
    s = m.scores(["what an i.d.i.o.t and so stu-pid", "the idxiot was so stupiid", "an i d i o t and s t u p i d too", "what a fine dinner in the north", ""])
    assert (s[:3] > 0.5).all() and (s[3:] < 0.5).all() and s[0] > s[3]
    words = ["idiot", "idxiot", "i" * 500, "", "é", "of"]
    assert m.margins(words).shape == (len(words),) and m.margins(words)[0] > 0
    glued = m.margins(["k" * 70 + "idiot", "k" * 20 + "idiot", "idiot" + "k" * 33, "weatheridiotnorth", "weatherpeoplenorth", "k" * 70])
    assert (glued[:4] > 0).all() and (glued[4:] < 0).all()


def test_all_letters_of_a_token_are_read():
    clean = ["the weather in the north was fine today and the people walked", "a long list of names and places that nobody reads", "we had bread and soup for dinner in the old house"] * 12
    bad = ["you are a stupid idiot and everyone knows it", "what an idiot this stupid person is today", "such a stupid plan from an idiot again"] * 8
    m = toxicity.train(clean + bad, [0] * len(clean) + [1] * len(bad))
    long = "weatherinthenorthpeoplewalked" * 3  # more letters than any window
    insults = "idiotstupid" * 20
    joined = [c.join(["bread", "soup", "weather", "people", "walked", "dinner", "house", "north", "names", "places", "nobody", "reads", "today", "idiot", "stupid"]) for c in ",/_-|"]
    s = m.scores([long + insults, long + insults + long, *joined, long, long + "," + long])
    assert (s[:-2] > 0.5).all() and (s[-2:] < 0.5).all()
    assert all(len(x) <= toxicity.WINDOW for w in (long, "ab" * 40, "x" * 33, "") for x in toxicity.windows(w))
    run = toxicity.WINDOW - toxicity.STRIDE + 1
    for n in (1, 7, 8, 9, 10, 11, 300):
        word = f"^{''.join(chr(200 + k) for k in range(n))}$"
        assert all(any(word[k : k + run] in x for x in toxicity.windows(word[1:-1])) for k in range(n + 2))


def test_kernel_is_the_sum_over_subsequences():
    def plain(a, b):
        def seqs(w):
            w = f"^{w}$"
            out = {}
            for i in range(len(w)):
                for j in range(i + 1, len(w)):
                    for k in range(j + 1, min(len(w), i + toxicity.MAX_SPAN)):
                        out.setdefault(w[i] + w[j] + w[k], []).append(toxicity.DECAY ** (k - i + 1))
            n = np.sqrt(sum(x * x for v in out.values() for x in v))
            return {s: sum(v) / n for s, v in out.items()}

        x, y = seqs(a), seqs(b)
        return sum(x[s] * y[s] for s in x.keys() & y.keys())

    c, w = toxicity.codes(["^idiot$", "^idioti$"])
    known = np.unique(c[w > 0])
    f = next(toxicity.features_of(["^idiot$", "^idioti$"], known))
    assert np.isclose(f[0] @ f[1], plain("idiot", "idioti")) and np.isclose(f[0] @ f[0], plain("idiot", "idiot"))


def plain_score(m, text):
    """A document's score by its definition: all subsequences of all windows of all words, one by one."""
    weight = {int(c): float(w) for c, w in zip(m.code, m.weight, strict=True)}

    def margin(word):
        full, best = f"^{word}$", -np.inf
        last = max(0, len(full) - toxicity.WINDOW)
        for at in range(last + 1):
            w, total, norm = full[at : at + toxicity.WINDOW], 0.0, 0.0
            for i in range(len(w)):
                for k in range(i + 2, min(len(w), i + toxicity.MAX_SPAN)):
                    for j in range(i + 1, k):
                        x = toxicity.DECAY ** (k - i + 1)
                        norm += x * x
                        total += x * weight.get(ord(w[i]) << 42 | ord(w[j]) << 21 | ord(w[k]), 0.0)
            best = max(best, m.bias + (total / norm**0.5 if norm else 0.0))
        return best

    found = []
    for token in toxicity.tokens(text or ""):
        whole = margin("".join(c for c in token if c.isalpha()))
        pieces = [margin(p) for p in toxicity.parts(token)]
        if pieces:
            pieces[pieces.index(max(pieces))] = max(*pieces, whole)
        found += pieces or [whole]
    top = sorted([max(x, toxicity.HIGH) for x in [*found, -9, -9]])[:-3:-1]
    over = sum(x > 0 for x in found)
    z = m.logistic @ [1, top[0], sum(top) / 2, min(1, 40 * over / max(1, len(found))), np.log1p(over)]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def test_query_equals_plain_scores(spark):
    from tests.conftest import SF as SMALL

    base, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.learn(base, labels)
    assert np.abs(m.weight).max() > 0 and (np.diff(m.code.astype(object)) > 0).all()
    got = {r.doc_id: r.score for r in queries.queries()["op3_toxicity_kernel"](spark, SMALL).collect()}
    texts = {r.doc_id: r.text for r in base.collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        assert np.isclose(got[i], plain_score(m, text), atol=1e-9), i


def test_more_clean_words_never_raise_a_score():
    m = toxicity.Machine(np.array([1], np.uint64), np.zeros(1), -0.5, np.r_[-1.0, 1, 2, 3, 4])
    for n in range(2, 200):
        a, b = toxicity.pooled([0.7, 0.3] + [-0.5] * n), toxicity.pooled([0.7, 0.3] + [-0.5] * (n + 1))
        assert all(x >= y for x, y in zip(a, b, strict=True)) and a[:2] == b[:2] and a[3] == b[3]
    assert m.margins([]).shape == (0,)


def test_long_texts_are_learned_from():
    text = ". ".join(f"sentence {k} of many" for k in range(20_000))
    found = toxicity.sampled_sentences(text)
    assert 0.9 * toxicity.TRAIN_BYTES < len(found) <= toxicity.TRAIN_BYTES and toxicity.sampled_sentences(text[:9000]) == text[:9000]
    at = [int(x.split()[1]) for x in found.split("\n")]
    assert at == sorted(at) and at[0] < 1000 and at[-1] > 19_000


def plain_ranking(z, y, pairs, ridge):
    """Bradley-Terry by plain gradient steps on the same pairs."""
    w = np.zeros(z.shape[1])
    d = np.array([z[a] - z[b] for a, b in pairs])
    for _ in range(20_000):
        slope = (d * (1 / (1 + np.exp(d @ w)))[:, None]).mean(0) - ridge / len(y) * w
        w += 0.5 * slope
        if np.abs(slope).max() < 1e-7:
            break
    return w


def test_ranking_is_the_minimum_of_the_logistic_loss_on_pairs():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(60, 4))
    y = (x @ [1.0, -2, 0, 0.5] + draw.normal(size=60) > 0).astype(np.int64)
    n = quality.BLOCK + 100
    got = quality.fit(x, y, 0.4, pairs=n)
    same = np.random.default_rng(1)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    a, b = good[same.integers(0, len(good), n)], bad[same.integers(0, len(bad), n)]
    z = (x - got.mean) / got.scale
    assert np.allclose(got.weight, plain_ranking(z, y, list(zip(a, b, strict=True)), 1.0), atol=1e-3)
    s = got.strengths(x)
    load = np.where(y == 1, 0.6 / len(good), 0.4 / len(bad))
    assert load[s < got.cut].sum() < 0.4 <= load[s <= got.cut].sum() + 1e-9  # the quantile at the share of bad documents
    assert np.isclose(got.scores(x)[np.argmin(np.abs(s - got.cut))], quality.THRESHOLD)


def test_features_by_hand():
    import pyarrow as pa

    texts = ["Good words here.\nGood words!", "", None, "a b a B"]
    x = quality.features(pa.array(texts))
    assert x.shape == (4, len(quality.NAMES)) and np.isfinite(x).all() and not x[1].any() is None
    h = quality.hashed(pa.array(texts))
    assert np.allclose((h**2).sum(1), [1, 0, 0, 1]) and np.isclose(np.sort(h[3])[-1] ** 2, 0.5)
    assert np.allclose(quality.features(pa.array(texts[3:])), x[3:])


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_edges(spark, score):
    label = "quality" if score is quality.score_quality else "toxic"
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, 1), (None, 1), (7, None), (8, 0), (99, 1), (4, 0)], f"doc_id long, {label} int")
    for given in (labels, labels.limit(0), labels.filter(f"{label} = 1")):
        out = score(edge_docs(spark), given)
        assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == edge_docs(spark).count()
        assert out.filter("score IS NULL OR score < 0 OR score > 1 OR held_out IS NULL").count() == 0
        assert score(empty_docs(spark), given).count() == 0


def test_equal_texts_have_equal_scores(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    rows = [(k, f"Some words, {'GOOD' if k % 2 else 'bad!!! | | |'} and {k % 3}.") for k in range(20)]
    out = {r.doc_id: r.score for r in quality.score_quality(docs(spark, [*rows, (100, rows[0][1])]), labels).collect()}
    assert out[100] == out[0]
