import hashlib
import random
import sys

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF
from tests.llm.edges import edge_docs, empty_docs, rows_of
from weir.llm import queries
from weir.llm.sentencepiece_bpe import Encoder, Memory, encode_documents, groups

PATH = queries.tokenizer_path()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ENCODER = Encoder(PATH)


@pytest.mark.parametrize("text", ["", " ", "  a", "a  b", "\n", "x▁y", "a\x00b", "é", "ａ①", "\t a", "a ", "<s>hello</s>", "<0x0A>", "　x", "<unk>", "▁", "▁▁ ▁", "a" * 300, "🙂" * 9])
def test_like_the_library(text):
    ids = LIBRARY.encode(text)
    assert ENCODER.encode(text) == ids and ENCODER.decode(ids) == LIBRARY.decode(ids)
    assert ENCODER.digest(text) == (len(ids), ",".join(map(str, ids)), LIBRARY.decode(ids))


@given(st.text(st.sampled_from("abtheing AE▁ .,-\n\té漢字кия🙂0_#<>"), max_size=40) | st.text(max_size=20).filter(lambda t: not any(0xD800 <= ord(c) < 0xE000 for c in t)))
@settings(max_examples=600, deadline=None)
def test_random_like_the_library(text):
    test_like_the_library.__wrapped__(text) if hasattr(test_like_the_library, "__wrapped__") else test_like_the_library(text)


def test_backtracking_is_merging():
    for word in ("unbelievably", "ononononon", "aaaaaaaaa", "internationalisation", "thththth"):
        assert list(ENCODER.part(word)) == ENCODER.merged(word)


def new_words(n, seed):
    """Words that seldom come twice, some with marks, line ends and characters that are no pieces."""
    rng = random.Random(seed)
    syllables = ["the", "ing", "and", "ción", "aux", "lich", "en", "or", "qu", "ä", "▁", "кия", "🙂", ".\n", "&&&", ",", "E"]
    weights = [8] * 10 + [0.05, 0.2, 0.05, 1, 0.5, 1, 1]
    return ["".join(rng.choices(syllables, weights, k=rng.randint(3, 6))) for _ in range(n)]


def test_calls_of_new_words():
    """A word that comes for the first time costs few calls, of Python's functions and of built-in ones."""
    encoder, calls = Encoder(PATH), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    encoder.digest(" ".join(new_words(3000, 1)))  # pairs of pieces are learned
    text = " ".join(new_words(3000, 2))
    sys.setprofile(count)
    try:
        got = encoder.digest(text)
    finally:
        sys.setprofile(None)
    ids = LIBRARY.encode(text)
    assert got == (len(ids), ",".join(map(str, ids)), LIBRARY.decode(ids))
    assert calls / len(set(text.split(" "))) < 60


@pytest.mark.parametrize("limit", [1, 3000, 1 << 20])
def test_groups_of_texts(limit):
    """Texts encoded together, with generations that are left in the middle of a group, and known units among new ones."""
    encoder = Encoder(PATH)
    encoder.words, encoder.parts = Memory(limit), Memory(limit)
    words = new_words(400, 3)
    rng = random.Random(4)
    texts = ["", " ", "▁", "🙂.\n", *(rng.choice(["", " ", "  "]) + " ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)), ""]
    expected = [(len(ids), ",".join(map(str, ids)), LIBRARY.decode(ids) if ids else "") for ids in map(LIBRARY.encode, texts)]
    for k in (1, 7, len(texts)):
        assert [d for i in range(0, len(texts), k) for d in encoder.digests(texts[i : i + k])] == expected


def test_groups_hold_every_text():
    texts = ["a" * (1 << 19), "b", "", "c" * (1 << 20), "d"]
    assert [[t[:1] for t in g] for g in groups(texts)] == [["a"], ["b", ""], ["c"], ["d"]]


def digests(text):
    ids = LIBRARY.encode(text or "")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids) if ids else "")


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.queries()["op7_sentencepiece"](spark, SF)
    assert rows_of(got, *got.columns) == sorted(((r.doc_id, *digests(r.text)) for r in table), key=repr)


def test_edges(spark):
    out = encode_documents(edge_docs(spark), PATH)
    assert rows_of(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(((r.doc_id, *digests(r.text)) for r in edge_docs(spark).collect()), key=repr)
    assert {r.decoded for r in out.collect()} == {r.text or "" for r in edge_docs(spark).collect()}
    assert all(r.ids == LIBRARY.encode(r.decoded) for r in out.collect())
    assert encode_documents(empty_docs(spark), PATH).count() == 0
