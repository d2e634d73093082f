import random

import numpy as np
import pytest

from pocketlens.llm import decontaminate
from pocketlens.llm.word_hashes import BLOCK, word_hashes

from .cases import awkward_docs, empty_docs


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_common_length_against_the_table():
    rng = random.Random(0)
    for _ in range(200):
        a = [rng.randrange(6) for _ in range(rng.randint(0, 20))]
        b = [rng.randrange(6) for _ in range(rng.randint(0, 30))]
        assert decontaminate.common_length(a, b) == lcs(a, b)


def test_word_hashes():
    hashes, counts = word_hashes([b"The cat", "thé CAT, Thé!".encode(), b"", "THÉ".encode()])
    the, cat, accented, cat2, accented2, upper = hashes.tolist()
    assert counts.tolist() == [2, 3, 0, 1] and cat == cat2 and accented == accented2 == upper != the
    words = [b"w%d" % i for i in range(90_000)]
    long, count = word_hashes([b" ".join(words)])  # more than a block
    assert len(b" ".join(words)) > BLOCK and count.tolist() == [90_000]
    assert long.tolist() == word_hashes(words)[0].tolist()


def test_places_of_hashes():
    rng = np.random.default_rng(5)
    known = np.unique(rng.integers(0, 2**64, 3000, np.uint64))
    known = np.unique(np.r_[known, known[:200] + np.uint64(1), np.uint64(0), np.uint64(2**64 - 1)])  # neighbours, too
    hashes = np.r_[known, known + np.uint64(1), rng.integers(0, 2**64, 5000, np.uint64)]
    want = {h: i for i, h in enumerate(known.tolist())}
    for some in (known, known[:1], known[:0]):
        got = decontaminate.Places(some).of(hashes)
        assert got.tolist() == [min(want.get(h, len(some)), len(some)) for h in hashes.tolist()]


def test_sums_of_steps_and_of_words():
    rng = np.random.default_rng(6)
    words = np.array([0, 1, 16, 17, 700, 0, 33, 5])
    n, rows = int(words.sum()), 600
    columns = np.minimum(rng.zipf(1.3, n), rows) - 1  # one comes hundreds of times, many once
    table = np.vstack([rng.integers(-9, 9, (rows, 3)), np.zeros((1, 3))]).astype(np.float32)
    p = decontaminate.Passages.of(words)
    step = np.concatenate([np.arange(w) // decontaminate.STEP for w in words])
    step += np.repeat(np.cumsum(-(-words // decontaminate.STEP)) - -(-words // decontaminate.STEP), words)
    assert p.step.tolist() == step.tolist() and p.step[p.first_word].tolist() == list(range(step[-1] + 1))
    sums = np.zeros((step[-1] + 1, 3), np.float32)
    np.add.at(sums, step, table[columns])
    assert (p.step_sums(table, columns) == sums).all()
    want, got = np.ones((rows, 3), np.float32), np.ones((rows, 3), np.float32)
    np.add.at(want, columns, sums[step])
    decontaminate.add_steps(got, columns, step, sums)
    times = np.bincount(columns)
    assert times.max() > decontaminate.MANY and ((times > decontaminate.FEW) & (times <= decontaminate.MANY)).any()
    assert (got == want).all()  # whole numbers, so in any order


@pytest.mark.parametrize("counted, often, sizes", [(4096, 64, [5, 12, 30, 30, 70, 130]), (3, 2, [5, 12, 30, 30, 70, 130]), (4096, 64, [27, 28, 29, 30, 30, 30])])
def test_bound_before_the_common_subsequence(monkeypatch, counted, often, sizes):
    """No pair is lost whose window holds enough of the item's words, and few windows are looked at word by word."""
    monkeypatch.setattr(decontaminate, "COUNTED", counted)
    monkeypatch.setattr(decontaminate, "OFTEN", often)
    rng = np.random.default_rng(7)
    known = np.arange(4000, dtype=np.uint64)
    items = [np.where(rng.random(n) < 0.4, rng.integers(0, 8, n), rng.integers(0, 4000, n)) for n in sizes]
    words = np.array([40, 3, 1, 300, 0, 90, 16, 500])
    n = int(words.sum())
    places = np.where(rng.random(n) < 0.4, rng.integers(0, 8, n), rng.integers(8, 401, n))  # 4000: in no item
    begin = np.cumsum(words) - words
    for i, at in ((0, 0), (1, 44), (2, begin[3] + 77), (3, begin[5] + 60), (4, begin[7]), (5, begin[7] + 200)):
        some = items[i].copy()
        some[1:-4:4] = 4000
        places[at : at + len(some)] = some
    p = decontaminate.Passages.of(words)
    bounds = p.first_word[p.left], begin[p.text], (begin + words)[p.text]
    block = decontaminate._Block([known[t] for t in items], known)
    checked = []
    possible = block.possible
    block.possible = lambda local, item, low, high: checked.append(len(item)) or possible(local, item, low, high)
    passage, item = block.candidates(places, p, bounds, np.ones((len(items), len(p.left)), bool))
    want = set()
    for q, (b, start, stop) in enumerate(zip(*(x.tolist() for x in bounds))):
        for i, words_of in enumerate(x.tolist() for x in items):
            size, reach = len(words_of), max(0, len(words_of) - decontaminate.STEP)
            low = max(start, b - reach)
            window = set(places[low : min(stop, max(b + 2 * decontaminate.STEP + reach, low + -(-3 * size // 2)))].tolist())
            found = sum(w in window for w in words_of)
            answer = words_of[size - decontaminate.answer_length(size) :]
            if decontaminate.leak_kind(found / size, sum(w in window for w in answer) / len(answer)):
                want.add((q, i))
    assert set(zip(passage.tolist(), item.tolist())) == want and {i for _, i in want} == set(range(6))
    if min(sizes) > 5:  # blocks hold items of similar length
        assert sum(checked) < 0.2 * len(items) * len(p.left)


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    common = ["the", "of", "and", "to", "in"]

    def words(n):
        return [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n)]

    items = {i: words(rng.randint(15, 60)) for i in range(30)}
    docs, verbatim, paraphrased = [], set(), set()
    for i in range(600):
        text = words(rng.randint(30, 600))
        if i % 10 == 0:
            item = rng.randrange(30)
            at = rng.randrange(len(text))
            text[at:at] = [w.upper() for w in items[item]]
            verbatim.add((i, item))
        elif i % 10 == 5:  # every fourth word before the answer is another one
            item = rng.randrange(30)
            own = items[item]
            at = rng.randrange(len(text))
            text[at:at] = [rng.choice(vocabulary) if k % 4 == 1 and k < 0.7 * len(own) else w for k, w in enumerate(own)]
            paraphrased.add((i, item))
        docs.append((i, ", ".join(text)))
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5),
        spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id bigint, text string"),
        verbatim,
        paraphrased,
    )


def test_planted_items_are_found(spark, planted):
    docs, items, verbatim, paraphrased = planted
    found = decontaminate.find_leaks(docs, items).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert got >= verbatim and len(got & paraphrased) >= 0.9 * len(paraphrased)
    assert got <= verbatim | paraphrased
    again = decontaminate.find_leaks(docs, items).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))
    kept = {r.doc_id for r in decontaminate.drop_leaks(docs, items).collect()}
    assert kept == set(range(600)) - {i for i, _ in got}


def test_blocks_of_items_give_the_same_rows(spark, planted, monkeypatch):
    docs, items, _, _ = planted
    want = sorted(map(tuple, decontaminate.find_leaks(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK_BYTES", 2000)
    got = sorted(map(tuple, decontaminate.find_leaks(docs, items).collect()))
    assert [r[:5] for r in got] == [r[:5] for r in want]


def test_awkward_rows(spark):
    docs, rows = awkward_docs(spark)
    items = [(1, "MIT license the same text here"), (1, "MIT license the same text here"), (2, None), (3, ""), (4, "one"), (None, "日本語 a b c d e")]
    items = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS kind")
    got = sorted((r.doc_id, r.item_id, r.kind) for r in decontaminate.find_leaks(docs, items).collect())
    assert got == [(1, 1, "verbatim")] + [(2, 1, "verbatim")] * 2
    kept = decontaminate.drop_leaks(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.find_leaks(empty_docs(spark), items).count() == 0


def test_an_item_in_a_third_of_the_rows(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(4000)]
    item = " ".join(rng.sample(vocabulary, 20))
    other = " ".join(rng.sample(vocabulary, 20))
    docs = []
    for i in range(300):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
        at = rng.randrange(len(words))
        docs.append((i, " ".join(words[:at] + [item] * (i % 3 == 0) + words[at:])))
    docs = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    items = spark.createDataFrame([(1, item), (2, other)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.kind) for r in decontaminate.find_leaks(docs, items).collect()}
    assert got == {(i, 1, "verbatim") for i in range(0, 300, 3)}


def test_long_documents(spark):
    rng = random.Random(3)
    docs = [[f"{rng.randrange(10**6)}" for _ in range(6000)] for _ in range(60)]  # every bucket is in most documents
    items = {i: [f"{rng.randrange(10**6)}" for _ in range(20)] for i in range(3)}
    for i in items:
        docs[5 * i][100 * i : 100 * i] = items[i]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id bigint, text string")
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()}
    assert got == {(0, 0), (5, 1), (10, 2)}
    own = decontaminate.benchmark_words(items)
    assert own.tolist() == sorted(set(word_hashes([r.text.encode() for r in items.collect()])[0].tolist()))
    idf, _ = decontaminate.inverse_frequencies(docs, own)
    once = np.log1p(60 / 2)  # the items' words are in one document or two, whatever their buckets hold
    assert (idf > 0.6).all() and np.median(idf[decontaminate.BUCKETS :]) == pytest.approx(once, rel=1e-5)


def test_paraphrases_without_the_rare_words(spark):
    """Recall against the longest common subsequence of every document and item."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 8))) for _ in range(4000)]
    common = [a + b for a in "klmno" for b in "pqrstu"]

    def words(n):
        return [rng.choice(common) if rng.random() < 0.45 else rng.choice(vocabulary) for _ in range(n)]

    items = {i: words(rng.randint(20, 50)) for i in range(40)}
    docs = {}
    for i in range(400):
        text = words(rng.randint(20, 120))
        if i % 2:
            own = list(items[rng.randrange(40)])
            rare = [k for k, w in enumerate(own[: int(0.75 * len(own))]) if w not in common]
            for k in rng.sample(rare, min(len(rare), int(0.45 * len(own)))):
                own[k] = rng.choice(vocabulary)
            at = rng.randrange(len(text))
            text[at:at] = own
        docs[i] = text
    want = set()
    for d, text in docs.items():
        for i, item in items.items():
            if lcs(item, text) >= decontaminate.PARAPHRASE * len(item):  # else no part of the text holds enough either
                places = (decontaminate.check_passage(item, text, at) for at in range(0, len(text), decontaminate.STEP))
                if any(decontaminate.leak_kind(found, answer) for found, answer, _ in places):
                    want.add((d, i))
    rows = [(i, " ".join(w)) for i, w in docs.items()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()}
    assert len(want) >= 200 and got <= want and len(got) >= 0.97 * len(want)
