import random
import zlib

import numpy as np
import pytest

from pocketlens.llm import gru, toxicity

from .cases import awkward_docs, empty_docs, ordered

CLEAN = [a + b for a in ("lor", "ip", "dol", "sit", "am") for b in ("em", "um", "or", "et", "is", "an")]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(0)
    rows = []
    for i in range(900):
        words = [rng.choice(CLEAN) for _ in range(rng.randint(5, 300))]
        toxic = int(rng.random() < 0.3)
        if toxic:  # one known word and one of a known stem, anywhere in the text
            words[rng.randrange(len(words))] = "vile"
            words[rng.randrange(len(words))] = "zork" + rng.choice(CLEAN)
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    return docs, labels, {r[0]: r[2] for r in rows}


def test_gradients():
    model = gru.Model.fresh({"a": 1, "b": 2}, np.zeros(2, np.float32), np.zeros(gru.BUCKETS, np.float32), 0)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rows, mask = np.array([[0, 1, 2, 0], [2, 1, 0, 0]]), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], float)

    def total():
        x, _ = model.inputs(["a", "b", "zz"])
        return model.forward(rows, mask, model.products(x)).sum()

    x, _ = model.inputs(["a", "b", "zz"])
    products = model.products(x)
    _, saved = model.forward(rows, mask, products, keep=True)
    grads, _ = model.gradients(rows, mask, x, products, saved, np.ones(2))
    rng = np.random.default_rng(1)
    for name, grad in grads.items():
        value = model.p[name]
        at = tuple(rng.integers(0, s) for s in value.shape)
        old = value[at]
        value[at] = old + 1e-3
        up = total()
        value[at] = old - 1e-3
        down = total()
        value[at] = old
        assert (up - down) / 2e-3 == pytest.approx(grad.reshape(value.shape)[at], rel=1e-2, abs=1e-6)


def test_windows_cover_every_word():
    for n in (1, 31, 32, 33, 56, 57, 1000):
        starts = gru.window_starts(n)
        covered = {i for s in starts for i in range(s, min(n, s + gru.WINDOW))}
        assert covered == set(range(n)) and starts == sorted(set(starts))


def test_held_out_accuracy(spark, corpus):
    docs, labels, truth = corpus
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


def test_labels_of_held_out_rows_do_not_matter(spark, corpus):
    docs, labels, _ = corpus
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    sample = ordered(map(tuple, toxicity.labelled_sample(docs, labels).collect()))
    assert sample and sample == ordered(map(tuple, toxicity.labelled_sample(docs, turned).collect()))


def test_repeated_ids_give_one_text_to_the_sample(spark, corpus):
    docs, labels, _ = corpus
    other = docs.selectExpr("doc_id", "concat('zz ', text) AS text")
    sample = ordered(map(tuple, toxicity.labelled_sample(docs.select("doc_id", "text"), labels).collect()))
    for order in (1, 2):
        both = docs.select("doc_id", "text").unionByName(other).unionByName(docs.select("doc_id", "text")).repartition(order + 2)
        got = ordered(map(tuple, toxicity.labelled_sample(both, labels.unionByName(labels)).collect()))
        assert [(i, y) for i, y, _ in got] == [(i, y) for i, y, _ in sample] and all(t <= "zz " + t for _, _, t in got)
        assert got == ordered((i, y, min(t, "zz " + t)) for i, y, t in sample)


def test_scores_do_not_depend_on_the_batch(corpus):
    model = gru.Model.fresh({"vile": 1}, np.ones(1, np.float32), np.zeros(gru.BUCKETS, np.float32), 3)
    texts = ["", "one", "vile words " * 40, " ".join(CLEAN) * 3, "é 日本"]
    together, windows = gru.Scorer(model).best_logits(texts)
    alone = [gru.Scorer(model).best_logits([t]) for t in texts]
    assert np.allclose(together, [a[0] for a, _ in alone], atol=1e-5)
    assert windows.tolist() == [n[0] for _, n in alone]


def test_awkward_rows(spark, corpus):
    docs, rows = awkward_docs(spark)
    labels = corpus[1].selectExpr("doc_id", "toxic", "'x' AS score")
    got = toxicity.score_documents(docs, labels).collect()
    assert ordered((r.doc_id,) for r in got) == ordered((r[0],) for r in rows)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.first().score == "clash"
    none = toxicity.score_documents(docs, labels.filter("toxic = 1")).collect()
    assert {r.score for r in none} == {0.0}  # nothing to learn from
    assert toxicity.score_documents(empty_docs(spark), labels).count() == 0


def test_every_short_run_is_whole_in_a_window():
    for n in (33, 56, 116, 1000):
        starts = gru.window_starts(n)
        for run in (9, 13, 24, 29):
            assert all(any(s <= a and a + run <= s + gru.WINDOW for s in starts) for a in range(n - run + 1)), (n, run)


def plain_logit(p, inputs):
    """One window, word by word, from the formulas of a gated recurrent unit and attention pooling."""
    h, size = gru.HIDDEN, len(inputs)

    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    states = np.zeros((size, 2 * h))
    for d, way in enumerate("fb"):
        w, u, b = (p[k + way].astype(np.float64) for k in "WUB")
        state = np.zeros(h)
        for t in range(size) if way == "f" else reversed(range(size)):
            x, g = inputs[t] @ w + b, state @ u
            z, r = sigmoid(x[:h] + g[:h]), sigmoid(x[h : 2 * h] + g[h : 2 * h])
            state = z * state + (1 - z) * np.tanh(x[2 * h :] + r * g[2 * h :])
            states[t, d * h : (d + 1) * h] = state
    e = (np.tanh(states @ p["A"] + p["a"]) @ p["v"])[:, 0]
    weight = np.exp(e) / np.exp(e).sum()
    return float((weight @ states @ p["o"])[0] + p["c"][0])


def test_scores_against_a_plain_pass_over_each_window():
    rng = np.random.default_rng(4)
    vocabulary = ["vile", "words", "été", "日本", "a", "longerword", "x1"]
    model = gru.Model.fresh({w: i + 1 for i, w in enumerate(vocabulary[:4])}, rng.normal(size=4).astype(np.float32), rng.normal(size=gru.BUCKETS).astype(np.float32), 3)
    for k, v in model.p.items():
        model.p[k] = (v + rng.normal(size=v.shape) * 0.3).astype(np.float32)
    texts = [" ".join(rng.choice(vocabulary, n)) for n in (1, 2, 31, 32, 33, 40, 75, 200)] + [""]
    got, windows = gru.Scorer(model).best_logits(texts)
    for text, logit, n in zip(texts, got, windows):
        words = gru.words_of(text)
        inputs = model.inputs(words)[0].astype(np.float64)
        starts = gru.window_starts(len(words))
        assert n == len(starts)
        assert logit == pytest.approx(max(plain_logit(model.p, inputs[s : s + gru.WINDOW]) for s in starts), abs=1e-4)
