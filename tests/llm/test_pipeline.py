import pytest

import __spark_entry__
import corpus_pipeline
from tests.conftest import SF
from tests.llm.edges import edge_docs, empty_docs
from tests.llm.test_decontamination import brute as benchmark_hits
from tests.llm.test_exact_dedup import lower
from tests.llm.test_jaccard_join import brute as near
from tests.llm.test_sentencepiece_bpe import digests
from weir.llm.toxicity import score_toxicity


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    toxic = {r.doc_id for r in score_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1").collect()}
    rows = {i: r for i, r in rows.items() if i not in toxic}
    last = {lower(r.text): i for i, r in sorted(rows.items())}
    rows = {i: r for i, r in rows.items() if last[lower(r.text)] == i}
    parts = {i: c for i, _, c in near([(i, r.text) for i, r in rows.items()], 5, 80, 100)}
    rows = {i: r for i, r in rows.items() if parts[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {i for i, (w, h, _) in zip(rows, benchmark_hits([r.text for r in rows.values()], items, 13), strict=True) if h}
    rows = {i: r for i, r in rows.items() if i not in dirty}
    assert dirty and toxic
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        now = stage(spark, now, SF)
        assert now.columns == columns, k
    assert sorted(r.doc_id for r in now.collect()) == sorted(rows)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted((i, *digests(r.text)) for i, r in rows.items())


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_take_edges(spark, k):
    stage = corpus_pipeline.STAGES[k][1]
    assert stage(spark, empty_docs(spark), SF).count() == 0
    out = stage(spark, edge_docs(spark), SF)
    # 13 rows: three are empty and three are one text but for case; two are near copies, and two of those three have one id
    assert out.count() == [13, 9, 10, 13, 13][k]


def test_copies_keep_one_row(spark):
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_copies(spark, edge_docs(spark), SF).collect()]
    texts = [lower(t) for _, t in kept]
    assert len(texts) == len(set(texts)) and (6, "same TEXT here for a copy") in kept and (5, "Same text here for a copy") not in kept


def test_registered():
    assert "pipeline" in __spark_entry__.queries() and [n for n in __spark_entry__.queries() if n.startswith("op")] == sorted((n for n in __spark_entry__.queries() if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert sum(n.startswith("op") for n in __spark_entry__.queries()) == 10
