import random
import re
import zlib
from collections import Counter

import pytest

from pocketlens.llm import spelling
from pocketlens.llm.automata import Acceptor, OneEdit

from .cases import DOCS, awkward_docs, empty_docs


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def words_of(rows, damage):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def brute(words, ratio=10):
    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] is not None else None))
    return out


def grouped(spark, words, **options):
    df = spark.createDataFrame([(w, n, "clash") for w, n in words.items()], "word string, n bigint, low string").repartition(3)
    out = spelling.group_spellings(df, **options)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def close_words(seed, n=250):
    rng = random.Random(seed)
    words = set()
    while len(words) < n:
        word = rng.choice(["abababab", "aaaaaaa", "receive", "separate", "éàéàéàé", "x" * 30])
        for _ in range(rng.randrange(4)):
            at, letter = rng.randrange(len(word) + 1), rng.choice("abeé")
            word = rng.choice([word[:at] + letter + word[at:], word[:at] + word[at + 1 :], word[:at] + letter + word[at + 1 :]])
        if len(word) >= 7:
            words.add(word)
    return {w: rng.choice([2, 3, 25, 40, 300, 4000]) for w in sorted(words)}


@pytest.mark.parametrize("group_words", [20_000, 12])
def test_against_brute_force(spark, group_words):
    words = close_words(1)
    assert grouped(spark, words, group_words=group_words) == brute(words)


def test_long_words_empty_and_null_rows(spark):
    words = {"x" * 30_000: 2, "x" * 30_001: 50, "x" * 15_000 + "y" + "x" * 15_000: 3, "loneword": 4, "y" + "x" * 30_000: 2}
    assert grouped(spark, words) == brute(words)
    assert spelling.group_spellings(spark.createDataFrame([(None, 3), ("seventy", None)], "word string, n bigint")).collect() == []
    assert spelling.group_spellings(spark.createDataFrame([], "word string, n bigint")).collect() == []
    with pytest.raises(ValueError):
        spelling.group_spellings(spark.createDataFrame([], "word string, n bigint"), ratio=1)


def test_vocabulary_of_awkward_documents(spark):
    extra = [(50 + i, "Grossartig grossartig GROSSARTIG été÷×straßenÿ Ǆstraßen Straßenİstraßen " * 3, "de", "a", 1) for i in range(40)]
    df, rows = awkward_docs(spark, extra)
    for damage in (None, 31, 2):
        got = {r.word: r.n for r in spelling.vocabulary(df, damage=damage).collect()}
        assert got == words_of([r[:2] for r in rows], damage)
    assert spelling.vocabulary(empty_docs(spark)).collect() == []


def test_query_against_brute_force_on_the_small_tables(spark):
    from pocketlens.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    words = words_of([tuple(r) for r in docs], 31)
    assert {tuple(r) for r in QUERIES["op12_spelling"](spark, "/root/testdata/sf0.001").collect()} == brute_by_deletion(words)


def brute_by_deletion(words, ratio=10):
    """As :func:`brute`, comparing only words that share a text with one letter left out (all one edit apart do)."""
    by_text = {}
    for w in words:
        for text in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            by_text.setdefault(text, set()).add(w)
    near = {w: set() for w in words}
    for members in by_text.values():
        for a in members:
            near[a] |= {b for b in members if b != a and one_edit(a, b)}
    small = {w: n for w, n in words.items() if near[w]}
    out = {(w, None, w, n, 0, None) for w, n in words.items() if not near[w]}
    form = {}
    for w, n in small.items():
        best = min(near[w], key=lambda v: (-words[v], v))
        form[w] = best if words[best] >= ratio * n else None
    for w, n in small.items():
        root = w
        while form.get(root) is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] is not None else None))
    return out


def test_acceptor_is_minimal_and_numbers_words():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(7))) for _ in range(150)})
    a = Acceptor(words)
    endings = [{w for w in words} if p == a.start else None for p in range(len(a.final))]
    for number, word in enumerate(words):
        p, at = a.start, 0
        for letter in word:
            at += a.before[p][letter]
            p = a.edges[p][letter]
        assert a.final[p] and at == number

    def language(p):
        return frozenset(([""] if a.final[p] else []) + [x + z for x, q in a.edges[p].items() for z in language(q)])

    assert len({language(p) for p in range(len(a.final))}) == len(a.final) and endings[a.start] == set(language(a.start))
    expected = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if one_edit(words[i], words[j])}
    pairs = OneEdit(a).pairs(99)
    assert len(pairs) == len(set(pairs)) and {(min(x), max(x)) for x in pairs} == expected
