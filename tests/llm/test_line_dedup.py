import random

import numpy as np
from pyspark.sql import functions as F

from pocketlens.llm import line_dedup
from pocketlens.llm.cuckoo import CuckooFilter, classes_of

from .cases import DOCS, awkward_docs, empty_docs, ordered


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows):
    """(doc_id, n_lines, n_dropped, text) of each row, from the definition."""
    owners = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= 10:
                owners.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc_id is None or len(key(x)) < 10 or doc_id == min(owners[key(x)])]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return ordered(out)


def corpus(seed, n=300):
    rng = random.Random(seed)
    lines = [f"line number {i} of the Common pool" for i in range(60)]
    rows = []
    for i in range(n):
        own = [rng.choice(lines) for _ in range(rng.randrange(5))] + [f"  Own line {i} {rng.random()}\r"] * rng.randrange(3)
        if i % 3 == 0:
            own.append("\tA line that a third of all documents hold ")
        own += [rng.choice(["", "short", "ÉÀ été là", "xxxxxxxxxÉ", "XXXXXXXXXé"])]
        rng.shuffle(own)
        rows.append((i * 7 % n, "\n".join(own)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).repartition(4)


def cleaned(df, index):
    out = line_dedup.clean(df, index)
    return ordered([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()])


def test_against_brute_force(spark):
    rows = corpus(1)
    for shard_keys in (100_000, 40):
        df = frame(spark, rows)
        assert cleaned(df, line_dedup.insert(df, shard_keys=shard_keys)) == brute(rows)


def test_awkward_rows_keep_their_columns(spark):
    twice = "the same long line\nThe Same Long Line \nother"
    extra = [(30, twice, "en", "a", 1), (31, twice, "en", "a", 1), (31, twice, None, "a", 1), (None, twice, "en", "a", 1), (-4, "日本語の長い行です。はい\nend", "ja", "a", 1), (40, "日本語の長い行です。はい", "ja", "a", 1)]
    df, rows = awkward_docs(spark, extra)
    df = df.withColumn("hi", F.lit("clash")).withColumn("n_lines", F.lit("clash")).withColumn("gone.x", F.lit("clash"))
    out = line_dedup.dedup_lines(df)
    assert set(out.columns) == set(df.columns) | {"n_dropped"}
    got = out.collect()
    assert ordered([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got]) == brute([r[:2] for r in rows])
    assert all(r.hi == "clash" and r["gone.x"] == "clash" for r in got)
    assert line_dedup.dedup_lines(empty_docs(spark)).collect() == []


def test_insertions_and_deletions_equal_an_index_built_at_once(spark):
    rows = corpus(2)
    first, second, third = rows[:120], rows[120:200], rows[200:]
    index = line_dedup.insert(frame(spark, first), shard_keys=50)
    index = line_dedup.insert(frame(spark, second), index)
    assert cleaned(frame(spark, first + second), index) == brute(first + second)
    index = line_dedup.insert(frame(spark, third), index)
    gone = {i for i, _ in rows if i % 4 == 1 or i < 20}
    ids = spark.createDataFrame([(i,) for i in gone] + [(None,), (10_000,)], "doc_id bigint")
    index = line_dedup.delete(index, ids)
    left = [r for r in rows if r[0] not in gone]
    assert cleaned(frame(spark, left), index) == brute(left)
    fresh = line_dedup.insert(frame(spark, left))
    assert ordered(index.repeated.collect()) == ordered(fresh.repeated.collect())
    # filters hold exactly the classes of the keys left
    held = {r.shard: CuckooFilter(data=bytes(r.filter)) for r in index.filters.collect()}
    keys = index.references.select("hi", "class").distinct().collect()
    assert sum(len(f) for f in held.values()) == len({(k.hi % index.shards, k["class"]) for k in keys})
    assert all(held[k.hi % index.shards].holds(np.array([k["class"]])).all() for k in keys)
    # and back again: the documents return
    index = line_dedup.insert(frame(spark, [r for r in rows if r[0] in gone]), index)
    assert cleaned(frame(spark, rows), index) == brute(rows)
    index = line_dedup.delete(index, spark.createDataFrame([(i,) for i, _ in rows], "doc_id bigint"))
    assert index.repeated.count() == 0 and sum(len(CuckooFilter(data=bytes(r.filter))) for r in index.filters.collect()) == 0


def test_filter_tells_new_keys_from_known_ones_before_the_exact_tables(spark):
    rows = [(i, f"a line of its own number {i}\na line of all documents") for i in range(2000)]
    index = line_dedup.insert(frame(spark, rows))
    assert [(r.n, r.first, r.last) for r in index.repeated.collect()] == [(2000, 0, 1999)]


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys = rng.integers(-(1 << 63), 1 << 63, 30_000, dtype=np.int64)
    classes = classes_of(keys, 1 << 10)
    f = CuckooFilter(1 << 10)
    for at in range(0, len(classes), 1700):
        f.insert(classes[at : at + 1700])
    f.insert(classes)
    assert len(f) == len(np.unique(classes)) and len(f.layers) > 6 and f.holds(classes).all()
    assert f.holds(classes_of(rng.integers(0, 1 << 63, 50_000, dtype=np.int64), 1 << 10)).mean() < 0.01
    f = CuckooFilter(1 << 10, f.to_bytes())
    gone, left = np.unique(classes)[::2], np.unique(classes)[1::2]
    f.delete(gone)
    assert not f.holds(gone).any() and f.holds(left).all() and len(f) == len(left)
