import re

import numpy as np
import pytest
import xxhash

from pocketlens.llm import simhash
from pocketlens.llm.components import connected_components

from .cases import awkward_docs, empty_docs, ordered


def fingerprint(text, k=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, distance):
    """Connected sets of values linked at ``distance`` or fewer bits, by brute force."""
    values = sorted(set(values))
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                parent[root(a)] = root(b)
    out = {}
    for v in values:
        out.setdefault(root(v), set()).add(v)
    return list(out.values())


def test_anchors_cover_every_pair_within_the_threshold():
    rng = np.random.default_rng(0)
    for distance in range(4):
        fps = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
        near = fps.copy()
        for i in range(len(near)):
            for bit in rng.choice(64, distance, replace=False):
                near[i] ^= np.uint64(1) << np.uint64(bit)
        row, anchor, home = simhash.anchors_of(fps, distance)
        assert np.bincount(row[home], minlength=40).tolist() == [1] * 40  # the code is perfect
        homes = dict(zip(row[home].tolist(), anchor[home].tolist()))
        other_row, other_anchor, _ = simhash.anchors_of(near, distance)
        met = set(zip(other_row.tolist(), other_anchor.tolist()))
        assert all((i, homes[i]) in met for i in range(40))


@pytest.mark.parametrize("distance,hot_group", [(0, 1024), (1, 5), (2, 1024), (2, 5), (3, 5)])
def test_links_against_brute_force(spark, distance, hot_group):
    rng = np.random.default_rng(distance)
    values = set()
    for center in rng.integers(0, 1 << 63, 12, dtype=np.uint64).tolist():
        for _ in range(60):
            v = center
            for bit in rng.integers(0, 64, rng.integers(0, 6)).tolist():
                v ^= 1 << bit
            values.add(v)
    signed = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    fps = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    found = {}
    for r in connected_components(simhash.fingerprint_links(fps, distance, hot_group)).collect():
        found.setdefault(r.root, set()).add(r.node % (1 << 64))
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in groups(values, distance) if len(g) > 1)


def test_components_of_a_chain_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(5, 5), (3, 2), (100, 101), (None, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def expected(rows):
    fps = [(i, fingerprint(t)) for i, t, *_ in rows]
    out = []
    for group in groups([f for _, f in fps], 2):
        ids = [i for i, f in fps if f in group]
        least = min((i for i in ids if i is not None), default=None)
        out += [(i, f, least) for i, f in fps if f in group]
    return out


def test_awkward_rows(spark):
    docs, rows = awkward_docs(spark)
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert ordered(got) == ordered(expected(rows))
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0


def test_one_document_of_each_group_stays(spark):
    docs, rows = awkward_docs(spark)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    want = sorted({least for i, _, least in expected(rows) if i is not None and least == i})
    assert sorted(i for i in ids if i is not None) == want
    assert ids.count(None) == 2  # rows without an id cannot be named
