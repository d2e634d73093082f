import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from pocketlens.llm import mixing
from pocketlens.llm.queries import QUERIES

from ..conftest import SF_SMALL
from .cases import awkward_docs, empty_docs, ordered


def test_targets():
    assert mixing.share_out({"a": 100, "b": 100, None: 100}, (5, 2, 1)) == {"a": 187.5, "b": 75, None: 37.5}
    capped = mixing.share_out({"a": 10, "b": 100, "c": 100}, (5, 2, 1))
    assert capped == {"a": 30, "b": 120, "c": 60}  # 210 - 30 again by 2 to 1
    assert mixing.share_out({}, (1,)) == {} and mixing.share_out({"a": 0}, (1,)) == {"a": 0}
    rng = random.Random(0)
    for _ in range(50):
        sizes = {f"s{i}": rng.randrange(0, 1000) ** 2 for i in range(rng.randrange(1, 9))}
        targets = mixing.share_out(sizes, (5, 2, 1))
        assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
        assert all(targets[s] <= 3 * sizes[s] + 1e-6 for s in sizes)


def test_nearest_sum_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        lengths = np.array(sorted(rng.sample(range(1, 30), rng.randint(1, 4))))
        counts = np.array([rng.randint(1, 3) for _ in lengths])
        budget = rng.randint(0, 60)
        sums = {int(np.dot(lengths, c)) for c in itertools.product(*[range(n + 1) for n in counts])}
        taken = mixing.nearest_sum(lengths, counts, budget)
        assert (taken <= counts).all()
        assert abs(int(np.dot(lengths, taken)) - budget) == min(abs(s - budget) for s in sums)


def test_large_budgets_are_met_exactly():
    rng = np.random.default_rng(2)
    lengths = np.unique(rng.integers(1, 5000, 800))
    counts = rng.integers(1, 50, len(lengths))
    total = int((lengths * counts).sum())
    for share in (0.01, 0.3, 0.77, 0.999, 1):
        budget = int(total * share)
        taken = mixing.fit_lengths(lengths, counts, budget, 0)
        assert (taken >= 0).all() and (taken <= counts).all() and int((taken * lengths).sum()) == budget


def test_plan(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANK_ROWS", 10)  # many parts of a frequent length
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.choice([3, 5, 7, 40])), rng.choice(["a", "a", "a", "b", None])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    plan = mixing.mix_plan(docs, (5, 2, 1), seed=4).collect()
    assert len(plan) == len(rows)
    for source in ("a", "b", None):
        own = [r for r in plan if r.source == source]
        assert sum(r["size"] for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
        assert max(r.copies for r in own) - min(r.copies for r in own) <= 1
        assert all(r.taken == r["size"] * r.copies and r.copies <= 3 for r in own)
    again = mixing.mix_plan(docs.repartition(7), (5, 2, 1), seed=4).collect()
    assert ordered(map(tuple, plan)) == ordered(map(tuple, again))
    other = mixing.mix_plan(docs, (5, 2, 1), seed=5).collect()
    assert ordered(map(tuple, plan)) != ordered(map(tuple, other))


def test_awkward_rows(spark):
    docs, rows = awkward_docs(spark)
    plan = mixing.mix_plan(docs, (5, 2, 1)).collect()
    assert ordered((r.doc_id, r.source, r["size"]) for r in plan) == ordered((i, s, len((t or "").split())) for i, t, _, s, _ in rows)
    assert mixing.mix_plan(empty_docs(spark), (5, 2, 1)).count() == 0
    mixed = mixing.mix_documents(docs, (5, 2, 1))
    added = ["size", "source_size", "target", "copies", "taken"]
    assert mixed.columns == [c for c in docs.columns if c not in added] + added
    key = ("doc_id", "source", "size", "source_size", "target", "copies", "taken")
    assert ordered(tuple(r[k] for k in key) for r in mixed.collect()) == ordered(tuple(r[k] for k in key) for r in plan if r.copies)
    assert mixing.mix_documents(empty_docs(spark), (5, 2, 1)).count() == 0


def test_every_row_has_its_own_row_of_the_plan(spark):
    """Repeated ids with other texts and sources, whole repeated rows, rows without an id."""
    rng = random.Random(6)
    rows = [(rng.choice([None, 1, 2, 3, i]), " ".join(["w"] * rng.choice([3, 5, 40])), rng.choice(["a", "b", None]), i % 3) for i in range(300)]
    rows += rows[:40] + [(1, None, "a", 0), (1, "", "b", 1), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars int").repartition(4)
    for seed in (0, 4):
        plan = mixing.mix_plan(docs, (5, 2, 1), seed=seed).collect()
        mixed = mixing.mix_documents(docs, (5, 2, 1), seed=seed).collect()
        key = ("doc_id", "source", "size", "source_size", "target", "copies", "taken")
        assert ordered(tuple(r[k] for k in key) for r in mixed) == ordered(tuple(r[k] for k in key) for r in plan if r.copies)
        assert not Counter((r.doc_id, r.text, r.source, r.n_chars) for r in mixed) - Counter(rows)
        assert all(len((r.text or "").split()) == r["size"] for r in mixed)
        for source in ("a", "b", None):
            own = [r for r in mixed if r.source == source]
            assert abs(sum(r.taken for r in own) - own[0].target) <= 1
        again = mixing.mix_documents(docs.repartition(7), (5, 2, 1), seed=seed).collect()
        assert ordered(map(tuple, mixed)) == ordered(map(tuple, again))


def plain_targets(sizes, weights):
    """All sizes by weight, the largest overshoot settled first, one source at a time."""
    open_, total, out = dict(zip(sizes, weights)), sum(sizes.values()), {}
    while open_:
        over = [s for s in open_ if total * open_[s] > 3 * sizes[s] * sum(open_.values())]
        if not over:
            return out | {s: total * w / sum(open_.values()) for s, w in open_.items()}
        worst = max(over, key=lambda s: total * open_[s] / sum(open_.values()) / max(sizes[s], 1e-9))
        out[worst] = 3 * sizes[worst]
        total -= out[worst]
        del open_[worst]
    return out


def test_the_query_against_plain_sums(spark):
    """Whole documents table: targets by hand; after the whole copies that all of a source get, no choice of documents comes nearer."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = QUERIES["op4_mix"](spark, SF_SMALL).collect()
    texts = {r.doc_id: r for r in docs.select("doc_id", "text", "source").collect()}
    assert sorted(r.doc_id for r in got) == sorted(texts)
    own = {}
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id].text or ""))
        own.setdefault(texts[r.doc_id].source, []).append(r)
    names = sorted(own, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(r["size"] for r in own[s]) for s in names}
    targets = plain_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    for s, rows in own.items():
        assert {r.source_size for r in rows} == {sizes[s]}
        assert all(r.target == pytest.approx(targets[s]) for r in rows)
        assert all(r.taken in {k * r["size"] for k in range(4)} for r in rows)
        whole = min(3, int(targets[s] + 0.5) // sizes[s])
        assert {r.taken // r["size"] for r in rows if r["size"]} <= {whole, whole + 1}
        reached = 1 << whole * sizes[s]
        for r in rows:
            reached |= reached << r["size"]
        sums = [n for n in range(max(0, int(targets[s]) - 500), int(targets[s]) + 500) if reached >> n & 1]
        goal = int(targets[s] + 0.5)  # whole words are fitted to the rounded target
        assert abs(sum(r.taken for r in rows) - goal) == min(abs(n - goal) for n in sums)
