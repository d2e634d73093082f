import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pocketlens.llm.cover_tree import CoverTree
from pocketlens.llm.hard_negatives import mine_hard_negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, every, positives=5, negatives=5):
    """Straight from the definition, row by row."""
    held = {}
    for vec_id, x, label in rows:
        if vec_id is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        row = (label, tuple(math.floor(256 * float(np.float32(c))) for c in x))
        # repeated ids: the smaller label stays (the fixtures repeat whole rows or labels only)
        held[vec_id] = min(held.get(vec_id, row), row)
    out = set()
    for anchor, (label, v) in held.items():
        if anchor % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i, other) for i, (other, w) in held.items() if i != anchor)
        for p, pos, _ in [s for s in scored if s[2] == label][:positives]:
            inside = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:negatives]
            out |= {(anchor, pos, rank + 1, neg, -p, -n) for rank, (n, neg, _) in enumerate(inside)}
    return out


def fixture(seed, n=400, dims=6):
    rng = np.random.default_rng(seed)
    hot = rng.normal(size=dims)
    rows = []
    for i in range(n):
        kind = i % 4
        x = hot + rng.normal(size=dims) * 0.02 if kind == 0 else hot if kind == 1 and i % 8 == 1 else rng.normal(size=dims) * rng.uniform(0.1, 2)
        rows.append((i, [float(c) for c in x], int(rng.integers(0, 3)) if kind else 0))
    return rows


def mined(spark, rows, every=5, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")).withColumn("rank", F.lit("clash"))
    out = mine_hard_negatives(df.repartition(3), F.col("vec_id") % every == 0, **options)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("tree_rows,leaf", [(8192, None), (60, 4), (150, 1)])
def test_against_brute_force_with_a_hot_vector(spark, tree_rows, leaf):
    rows = fixture(1)
    assert mined(spark, rows, tree_rows=tree_rows, leaf=leaf) == brute(rows, 5)


def test_awkward_rows(spark):
    rows = fixture(2, 60)
    rows += rows[:10]  # repeated rows
    rows += [(7, rows[7][1], 0)]  # another label under a known id
    rows += [(None, [1.0] * 6, 1), (200, None, 1), (205, [1.0] * 6, None), (210, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1)]
    rows += [(215, [float("nan")] * 6, 1), (220, [float("inf")] + [0.0] * 5, 1), (225, [], 1), (230, [1.0, 1.0], 2), (235, [0.0] * 6, 2)]
    rows += [(-5, [0.5] * 6, 1), (240, [-9.0] * 6, 0)]
    assert mined(spark, rows, tree_rows=20, leaf=2) == brute(rows, 5)


def test_too_large_vectors_and_empty_tables_give_nothing(spark):
    assert mined(spark, [(0, [1e30, 0.0], 1), (5, [1.0, 0.0], 1)]) == set()
    assert mined(spark, []) == set()
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == set()  # no anchors


def test_tree_covers_its_points_and_skips_nodes():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 12)) * 300
    vectors = np.floor(np.repeat(centres, 50, axis=0) + rng.normal(size=(2000, 12)) * 5)
    tree = CoverTree.from_bytes(CoverTree.build(np.arange(2000), np.zeros(2000, np.int64), vectors, leaf=8).to_bytes())
    assert sorted(tree.ids.tolist()) == list(range(2000))
    covered = np.zeros(2000, int)
    for start, stop in zip(tree.start, tree.stop):
        covered[start:stop] += 1
    assert (covered == 1).all()

    def points(node):
        own = list(range(tree.start[node], tree.stop[node]))
        for child in range(tree.first[node], tree.first[node] + tree.count[node]):
            own += points(child)
        return own

    query = np.floor(rng.normal(size=12) * 300)
    least, most = tree._bounds(slice(0, len(tree.centre)), query, float(np.sqrt(query @ query)))
    for node in range(len(tree.centre)):
        inside = tree.vectors[points(node)] @ query
        assert least[node] <= inside.min() and inside.max() <= most[node]


    seen = []
    whole = tree.vectors
    tree.vectors = type("Rows", (), {"shape": whole.shape, "__getitem__": lambda self, s: (seen.append(s.stop - s.start), whole[s])[1]})()
    (scores, ids), = tree.search(query, 0, True, -1, np.array([-np.inf]), np.array([np.inf]), 5)
    expected = sorted((-(v @ query), i) for v, i in zip(whole, tree.ids))[:5]
    assert [(-s, i) for s, i in zip(scores, ids)] == expected
    assert sum(seen) < 1000  # most points were never compared
