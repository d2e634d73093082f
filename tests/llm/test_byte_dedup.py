import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pocketlens.llm import byte_dedup, suffixes

from ..conftest import SF_SMALL
from .cases import awkward_docs, empty_docs, ordered


def brute(rows, match):
    data = [((i, (t or "").encode())) for i, t in rows]
    count = Counter(b[k : k + match] for _, b in data for k in range(len(b) - match + 1))
    out = []
    for doc_id, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - match + 1):
            if count[b[k : k + match]] > 1:
                gone[k : k + match] = b"\1" * match
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc_id, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def digests(df, *args):
    return [tuple(r) for r in byte_dedup.digest_kept(byte_dedup.remove_repeats(df, *args)).collect()]


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(0)
    for _ in range(60):
        match = int(rng.choice([8, 9, 20, 50, 128, 200]))
        base = bytes(rng.integers(97, 97 + rng.integers(1, 4), 400, dtype=np.uint8))
        pieces = []
        for _ in range(rng.integers(1, 12)):
            at = int(rng.integers(0, 300))
            piece = bytearray(base[at : at + int(rng.integers(match, match + 150))])
            for _ in range(rng.integers(0, 3)):
                piece[rng.integers(len(piece))] = 97
            pieces.append(bytes(piece))
        sizes = [len(p) for p in pieces]
        data, ends = np.frombuffer(b"".join(pieces), np.uint8), np.repeat(np.cumsum(sizes), sizes)
        windows, repeated = suffixes.repeated_windows(data, ends, match)
        raw = data.tobytes()
        count = Counter(raw[i : i + match] for i in range(len(raw)) if i + match <= ends[i])
        assert sorted(windows.tolist()) == [i for i in range(len(raw)) if i + match <= ends[i]]
        found = [raw[i : i + match] for i in windows.tolist()]
        assert found == sorted(found)
        assert [count[w] > 1 for w in found] == repeated.tolist()
        prefixes = suffixes.common_prefixes(data, ends, windows)
        for a, b, n in zip(windows[:-1].tolist(), windows[1:].tolist(), prefixes[1:].tolist()):
            x, y = raw[a : ends[a]], raw[b : ends[b]]
            assert x[:n] == y[:n] and (n in (len(x), len(y)) or x[n] != y[n])


@pytest.mark.parametrize("match,anchor,shard_variants", [(30, 8, 3000), (30, 8, 2), (24, 24, 2)])
def test_against_brute_force(spark, match, anchor, shard_variants):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdé ") for _ in range(400)) for _ in range(4)]
    rows = []
    for i in range(250):
        text = "".join(rng.choice("abcdefgé ") for _ in range(rng.randint(0, 200)))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, 380)
            part = list(rng.choice(base)[at : at + rng.randint(10, 120)])
            if part and rng.random() < 0.5:
                part[rng.randrange(len(part))] = "Z"
            text += "".join(part) + str(rng.random())[: rng.randint(0, 9)]
        rows.append((i, text))
    rows += [(7, None), (8, ""), (None, "abc" * 60), (None, None), (5, rows[5][1]), (9, "ab" * 300), (10, "q" * 500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert ordered(digests(df, match, anchor, shard_variants)) == ordered(brute(rows, match))


def test_documents_and_awkward_rows(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert ordered(digests(docs)) == ordered(brute([tuple(r) for r in docs.select("doc_id", "text").collect()], 200))
    docs, rows = awkward_docs(spark)
    assert ordered(digests(docs)) == ordered(brute([r[:2] for r in rows], 200))
    assert digests(empty_docs(spark)) == []


def test_dropped_repeats_leave_whole_characters(spark):
    passage = "é" * 150
    rows = [(1, "aaa" + passage, 153), (2, "©" + passage + " end", 155), (3, passage, 150), (4, "", 0), (5, "clean", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    got = {r.doc_id: (r.text, r.n_chars) for r in byte_dedup.drop_repeats(docs).collect()}
    assert got == {1: ("aaa", 3), 2: (" end", 4), 4: ("", 0), 5: ("clean", 5)}  # the last byte of © is also é's


def test_rows_without_doc_id_are_told_apart_by_their_whole_text(spark):
    """Two texts of equal 32-bit hash, both without a doc_id, and a document that holds one of them."""
    many = spark.range(200_000).selectExpr("repeat(sha2(cast(id AS string), 256), 4) AS text").selectExpr("text", "hash(text) AS h")
    pair = many.groupBy("h").agg(F.collect_list("text").alias("t")).filter("size(t) > 1").orderBy("h").first().t
    rows = [(None, pair[0]), (None, pair[1]), (1, pair[0]), (-(1 << 63), pair[1][:250]), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert ordered(digests(df)) == ordered(brute(rows, 200))
    rows = rows[:2] + [(1, pair[0])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert ordered(digests(df)) == ordered(brute(rows, 200))
