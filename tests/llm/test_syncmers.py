import hashlib
import time
from collections import Counter

import numpy as np

from pocketlens.llm import syncmers
from pocketlens.llm.common import rolling_hashes

from ..conftest import SF_SMALL
from .cases import awkward_docs, empty_docs, ordered


def test_rolling_hashes_depend_on_the_run_alone():
    codes = np.array([3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 3, 1, 4, 1, 5, 9, 2, 6], np.uint32)
    for size in (1, 2, 5, 7):
        h = rolling_hashes(codes, [size])[size]
        for i in range(len(h)):
            assert h[i] == rolling_hashes(codes[i : i + size], [size])[size][0]


def test_a_choice_depends_on_the_kmer_alone():
    rng = np.random.default_rng(0)
    codes = rng.integers(97, 123, 3000).astype(np.uint32)
    at, h = syncmers.chosen_kmers(codes)
    chosen = dict(zip(at.tolist(), h.tolist()))
    for i in range(0, 2900, 7):
        alone, value = syncmers.chosen_kmers(codes[i : i + syncmers.K])
        assert (len(alone) == 1) == (i in chosen)
        if i in chosen:
            assert value[0] == chosen[i]


def test_blocks_do_not_matter(monkeypatch):
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(97, 105, n))) for n in (0, 1, 19, 20, 500, 3000, 5)]
    whole = syncmers.fingerprints_of(texts)
    monkeypatch.setattr(syncmers, "BLOCK", 64)
    assert syncmers.fingerprints_of(texts) == whole
    assert [syncmers.fingerprints_of([t])[0] for t in texts] == whole


def test_likeness():
    a = syncmers.fingerprints_of(["the quick brown fox jumps over the lazy dog " * 9 + "and goes home again some day"])[0]
    assert syncmers.likeness(a, a) == 1 and syncmers.likeness([], []) == 1 and syncmers.likeness(a, []) == 0
    assert syncmers.likeness([(1, 5), (2, 9)], [(1, 9), (2, 5)]) == 0.5  # the same anchors in another order
    assert syncmers.read_fingerprint(syncmers.write_fingerprint(a)) == a


def plain_hash(run):
    """Polynomial hash of a run of code points, scrambled; whole numbers modulo 2^64."""
    h = 0
    for c in run:
        h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) % 2**64
    for _ in range(2):
        h = (h ^ (h >> 32)) * 0xD6E8FEB86659FD93 % 2**64
    return h ^ (h >> 32)


def plain_fingerprint(text):
    """Closed syncmers by their definition: the smallest inner hash stands first or last."""
    if 0 < len(text) < syncmers.K:
        return [(plain_hash(text) >> 32, 0)]
    inner = [plain_hash(text[i : i + syncmers.S]) for i in range(len(text) - syncmers.S + 1)]
    out = []
    for i in range(len(text) - syncmers.K + 1):
        own = inner[i : i + syncmers.K - syncmers.S + 1]
        if min(own) in (own[0], own[-1]):
            out.append((plain_hash(text[i : i + syncmers.K]) >> 32, i))
    return out


def plain_common(x, y):
    """Longest common subsequence by its table, a row at a time."""
    y = np.array(y, np.int64)
    row = np.zeros(len(y) + 1, np.int64)
    for v in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == v)))
    return int(row[-1])


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    x, y = [h for h, _ in a], [h for h, _ in b]
    in_x, in_y = Counter(x), Counter(y)
    return plain_common(x, y) / sum((in_x | in_y).values())


def brute(rows):
    ordered_rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    prints = {}
    out = []
    for i, (doc_id, text, *_) in enumerate(ordered_rows):
        text, after = text or "", ordered_rows[(i + 1) % len(ordered_rows)][1] or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        for t in (text, edited, after):
            if t not in prints:
                prints[t] = plain_fingerprint(t)
        own, of_edited, of_next = (prints[t] for t in (text, edited, after))
        out.append((
            doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), ",".join(f"{h:08x}@{at:x}" for h, at in own),
            ",".join(f"{h:08x}@{at:x}" for h, at in of_edited), plain_likeness(own, of_edited), plain_likeness(own, of_next),
        ))
    return out


def test_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = [tuple(r) for r in syncmers.fingerprint_documents(docs).collect()]
    assert ordered(got) == ordered(brute([tuple(r)[:2] for r in docs.select("doc_id", "text").collect()]))


def test_awkward_rows(spark):
    docs, rows = awkward_docs(spark)
    got = [tuple(r) for r in syncmers.fingerprint_documents(docs).collect()]
    assert ordered(got) == ordered(brute(rows))
    single = spark.createDataFrame([(1, "a single document follows itself")], "doc_id bigint, text string")
    assert syncmers.fingerprint_documents(single).first().near_next == 1
    assert syncmers.fingerprint_documents(empty_docs(spark)).count() == 0
    assert syncmers.fingerprint_texts(docs).count() == len(rows)


def test_anchors_grow_with_the_text():
    rng = np.random.default_rng(2)
    short, long = ("".join(map(chr, rng.integers(97, 123, n))) for n in (2000, 100_000))
    a, b = syncmers.fingerprints_of([short, long])
    codes = np.frombuffer(long.encode("utf-32-le"), np.uint32)
    at, h = syncmers.chosen_kmers(codes)
    assert b == list(zip(h.tolist(), at.tolist())) and len(b) > 40 * len(a)
    twice = syncmers.fingerprints_of([short + short])[0]
    assert twice[-len(a) :] == [(h, at + len(short)) for h, at in a]  # every position of an anchor
    # a passage of 300 characters in two long texts, and one changed character
    other = "".join(map(chr, rng.integers(97, 123, 100_000)))
    shared, changed = other[:5000] + long[700:1000] + other[5000:], long[:50_000] + "!" + long[50_001:]
    near, equal = (syncmers.likeness(b, p) for p in syncmers.fingerprints_of([shared, changed]))
    assert 30 / (2 * len(b)) < near < 0.01 and 0.99 < equal < 1


def test_likeness_against_the_table():
    rng = np.random.default_rng(3)
    for _ in range(100):
        x, y = (rng.integers(0, 8, rng.integers(1, 30)).tolist() for _ in range(2))
        row = [0] * (len(y) + 1)
        for v in x:
            last = 0
            for j, w in enumerate(y):
                last, row[j + 1] = row[j + 1], last + 1 if v == w else max(row[j], row[j + 1])
        union = sum(max(x.count(v), y.count(v)) for v in range(8))
        a, b = ([(v, 3 * i) for i, v in enumerate(s)] for s in (x, y))
        assert syncmers.likeness(a, b) == row[-1] / union


def test_chained_matches_and_the_table_agree(monkeypatch):
    rng = np.random.default_rng(5)
    for word in (1, 2048, 1 << 30):
        monkeypatch.setattr(syncmers, "TABLE_WORD", word)
        for values in (2, 8, 100):
            for _ in range(30):
                x, y = (rng.integers(0, values, rng.integers(0, 60)).tolist() for _ in range(2))
                assert syncmers.matched_in_order(x, y) == plain_common(x, y)


def test_long_texts_with_parts_in_another_order():
    """Half a million anchors in two swapped halves, and a passage repeated throughout."""
    n = 500_000
    rng = np.random.default_rng(6)
    x = rng.integers(0, 1 << 32, n).tolist()
    began = time.perf_counter()
    turned = x[n // 2 :] + x[: n // 2 - 1]
    assert syncmers.matched_in_order(x, turned) == n // 2
    assert time.perf_counter() - began < 30
    assert syncmers.matched_in_order(x[:3000], (x[:50] * 60)[::-1]) == plain_common(x[:3000], (x[:50] * 60)[::-1])
    again = x[:50] * 60
    assert syncmers.matched_in_order(again, again[7:] + again[:7]) == plain_common(again, again[7:] + again[:7])
