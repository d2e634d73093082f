import pickle
from collections import Counter

import numpy as np

import corpus_pipeline
from pocketlens.llm import byte_dedup, decontaminate, gru, simhash, toxicity
from pocketlens.llm.common import materialise
from pocketlens.llm.queries import TOXIC_THRESHOLD
from pocketlens.llm.word_hashes import word_hashes

from ..conftest import SF_SMALL
from .test_simhash import expected


def plain_score(model, text):
    """The score of the worst window, all windows stepped word by word from the formulas."""
    words = gru.words_of(text)
    inputs, p, h = model.inputs(words)[0].astype(np.float64), model.p, gru.HIDDEN
    starts = range(1) if len(words) <= gru.WINDOW else [*range(0, len(words) - gru.WINDOW, gru.STRIDE), len(words) - gru.WINDOW]
    x = np.stack([inputs[s : s + gru.WINDOW] for s in starts])
    both = []
    for way in "fb":
        state, states = np.zeros((len(x), h)), np.zeros((*x.shape[:2], h))
        for t in range(x.shape[1]) if way == "f" else reversed(range(x.shape[1])):
            new, old = x[:, t] @ p["W" + way] + p["B" + way], state @ p["U" + way]
            update, reset = (1 / (1 + np.exp(-(new[:, k : k + h] + old[:, k : k + h]))) for k in (0, h))
            state = update * state + (1 - update) * np.tanh(new[:, 2 * h :] + reset * old[:, 2 * h :])
            states[:, t] = state
        both.append(states)
    both = np.concatenate(both, axis=2)
    weight = np.exp((np.tanh(both @ p["A"] + p["a"]) @ p["v"])[:, :, 0])
    pooled = (weight[:, :, None] * both).sum(axis=1) / weight.sum(axis=1)[:, None]
    return float((1 / (1 + np.exp(-(pooled @ p["o"] + p["c"])))).max())


def plain_cuts(texts, match):
    """What is left of each text without the strings of ``match`` bytes that start twice, whole characters only."""
    data = {i: (t or "").encode() for i, t in texts.items()}
    starts = Counter(b[k : k + match] for b in data.values() for k in range(len(b) - match + 1))
    out = {}
    for i, b in data.items():
        gone = set()
        for k in range(len(b) - match + 1):
            if starts[b[k : k + match]] > 1:
                gone.update(range(k, k + match))
        kept, at = "", 0
        for char in texts[i] or "":
            size = len(char.encode())
            kept += "" if any(at + k in gone for k in range(size)) else char
            at += size
        if kept or not gone:
            out[i] = kept
    return out


def plain_leaks(texts, items):
    """(doc_id, item_id) of leaks by the common subsequence at every place of every text, whatever the cosine."""
    tokens = {i: word_hashes([t.encode()])[0].tolist() for i, t in items.items()}
    out = set()
    for d, text in texts.items():
        words = word_hashes([(text or "").encode()])[0].tolist()
        for i, item in tokens.items():
            if len(item) < decontaminate.MIN_ITEM_WORDS or decontaminate.common_length(item, words) < decontaminate.PARAPHRASE * len(item):
                continue
            places = (decontaminate.check_passage(item, words, at) for at in range(0, len(words), decontaminate.STEP))
            if any(decontaminate.leak_kind(found, answer) for found, answer, _ in places):
                out.add((d, i))
    return out


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "mix_sources"]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialise(stage(spark, kept[-1], SF_SMALL), f"test-{name}"))
    assert all(k.columns == columns for k in kept[:-1])
    texts = [{r.doc_id: r.text for r in k.collect()} for k in kept]
    # documents whose worst window is toxic by a plain pass of the same network are gone, and no others
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    model = pickle.loads(toxicity.fit(docs, labels))
    scores = {i: plain_score(model, t or "") for i, t in texts[0].items()}
    assert texts[1] == {i: t for i, t in texts[0].items() if scores[i] < TOXIC_THRESHOLD}
    # so few labels teach little: the same at a threshold in the middle of the scores
    ranked = sorted(scores.values())
    middle = max(range(len(ranked) // 4, len(ranked) * 3 // 4), key=lambda k: ranked[k + 1] - ranked[k])
    threshold = (ranked[middle] + ranked[middle + 1]) / 2
    kept_below = {r.doc_id for r in toxicity.drop_toxic(docs, labels, threshold).collect()}
    assert kept_below == {i for i in texts[0] if scores[i] < threshold}
    # one document of each group, by brute force
    assert set(texts[2]) == {least for _, _, least in expected(list(texts[1].items()))}
    assert texts[3] == plain_cuts(texts[2], byte_dedup.MATCH)
    # documents with a leak by the subsequence alone are gone, and no others
    benchmark = {r.item_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()}
    leaks = plain_leaks(texts[3], benchmark)
    assert set(texts[4]) == set(texts[3]) - {d for d, _ in leaks} != set(texts[3])
    assert not any(item in text for item in benchmark.values() for text in texts[4].values())
    assert set(texts[5]) <= set(texts[4])
    mixed = kept[5].groupBy("source").agg({"taken": "sum", "target": "max", "source_size": "max"}).collect()
    assert all(r["sum(taken)"] <= 3 * r["max(source_size)"] for r in mixed)
    assert simhash.near_duplicates(kept[2]).filter("doc_id <> component_id").count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.columns[-5:] == ["size", "source_size", "target", "copies", "taken"] and out.count() > 0
