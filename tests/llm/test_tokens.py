import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pocketlens.llm import tokens

from ..conftest import SF_SMALL
from .cases import awkward_docs, empty_docs, ordered

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  \n\n x  ", "<|endoftext|>", "a<|endoftext|> b <|endoftext|><|endoftext|>", "it's I'll we've o'clock 'S",
    "日本語 テキスト 😀😀", "x" * 5000, "ab" * 3000, " " * 1000, "\x1c\x1f a\u200bb", "١٢٣ abc ½ ²", "ɏ\u0558 ꟎ new",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_are_the_librarys(library):
    counter = tokens.TokenCounter(*tokens.load_merges(PATH))
    assert [counter.count(t) for t in ODD] == [len(library.encode(t, add_special_tokens=False).ids) for t in ODD]


def test_small_cache_gives_the_same_counts(library):
    ranks, _ = tokens.load_merges(PATH)
    counts = tokens.WordCounts(ranks, limit=2)
    words = ["alpha", "beta", "gamma", "delta"] * 3
    assert [counts[w] for w in words] == [len(library.encode(w, add_special_tokens=False).ids) for w in words]


def test_table(spark, library):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(docs, PATH).collect()}
    for r in docs.collect():
        n = len(library.encode(r.text, add_special_tokens=False).ids)
        assert got[r.doc_id] == (len(r.text.encode()), n, n > 512)


def test_awkward_rows(spark, library):
    docs, rows = awkward_docs(spark)
    got = [tuple(r) for r in tokens.count_tokens(docs, PATH).collect()]
    want = []
    for doc_id, text, *_ in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((doc_id, len((text or "").encode()), n, n > 512))
    assert ordered(got) == ordered(want)
    assert tokens.count_tokens(empty_docs(spark), PATH).count() == 0
