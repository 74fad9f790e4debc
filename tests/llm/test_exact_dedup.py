import hashlib
import re
from collections import defaultdict

import pytest

from tests.conftest import SF
from tests.llm.edges import RAW, docs, edge_docs, empty_docs, rows_of
from tests.oracle import connect, same
from weir.llm import queries
from weir.llm.exact_dedup import exact_dedup


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def test_equals_sql(spark):
    same(queries.queries()["op8_exact_dedup"](spark, SF), connect(SF), queries.oracle_sql()["op8_exact_dedup"])


@pytest.mark.parametrize("digest", [True, False])
def test_edges(spark, digest):
    got = rows_of(exact_dedup(edge_docs(spark), digest=digest), "doc_id", "keep_id", "group_size", "kept", *(["text_sha256"] if digest else []))
    groups = defaultdict(list)
    for i, t, *_ in RAW:
        groups[lower(t)].append(i)
    want = []
    for t, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)):
            want.append((i, top, len(ids), k == 0, *([hashlib.sha256(t.encode()).hexdigest()] if digest else [])))
    assert got == sorted(want, key=repr)
    assert exact_dedup(empty_docs(spark), digest=digest).count() == 0


def test_levels_tell_texts_apart(spark):
    items = [(k, "p" * 300 + x) for k, x in enumerate(["a", "b", "a", "bb", "A"])] + [(9, "É"), (10, "é")]
    for digest in (True, False):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs(spark, items), digest=digest).collect()}
        assert got == {0: (4, 3, False), 1: (1, 1, True), 2: (4, 3, False), 3: (3, 1, True), 4: (4, 3, True), 9: (9, 1, True), 10: (10, 1, True)}
