"""Document fingerprints from closed syncmers.

A k-mer of code points is chosen when the smallest hash among its inner s-mers is at
its first or its last place.  That depends on the k-mer alone, so an edit changes only
the choices that overlap it.  A fingerprint has all chosen k-mers with their positions, in
the order of the text, written ``hash@position`` and joined by commas.
Two fingerprints are compared by position: shared anchors count as far as they come in
the same order in both.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, rolling_hashes, slices, texts_of
from .decontaminate import common_length

K, S = 20, 9
#: k-mers that are hashed at a time, and code points that are gathered for it.
BLOCK = 1 << 17
#: Anchors that one step over the bits of a table covers in the time of a pair of places.
TABLE_WORD = 2048
#: Ranges of doc_id for each shuffle partition when documents meet their successors.
RANGES_PER_PARTITION = 4
MAX_RANGES = 4096

Anchors = list[tuple[int, int]]  # (hash, position), by position


def chosen_kmers(codes: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(positions, 32-bit hashes) of the closed syncmers of one run of code points."""
    if len(codes) < k:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    runs = rolling_hashes(codes, [s, k])
    inner = mix64(runs[s])
    width = k - s + 1
    least, size = inner, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = width - size
    least = np.minimum(least[: len(codes) - k + 1], least[rest : rest + len(codes) - k + 1])
    n = len(least)
    at = np.flatnonzero((inner[:n] == least) | (inner[width - 1 : width - 1 + n] == least))
    return at, mix64(runs[k][at]) >> np.uint64(32)


def fingerprints_of(texts: list[str], k: int = K, s: int = S) -> list[Anchors]:
    """The fingerprint of each text; a text under k code points is one anchor, an empty one has none."""
    codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
    ends = np.cumsum([len(c) for c in codes])
    starts = ends - [len(c) for c in codes]
    joined = np.concatenate(codes) if codes else np.empty(0, np.uint32)
    positions, hashes = [], []
    for a in range(0, max(0, len(joined) - k + 1), BLOCK):
        at, h = chosen_kmers(joined[a : a + BLOCK + k - 1], k, s)
        positions.append(at + a)
        hashes.append(h)
    at = np.concatenate(positions) if positions else np.empty(0, np.int64)
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    doc = np.searchsorted(ends, at, "right")
    inside = at + k <= ends[doc]
    at, h, doc = at[inside], h[inside], doc[inside]
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    out: list[Anchors] = []
    for i, c in enumerate(codes):
        own_h, own_at = h[first[i] : first[i + 1]], at[first[i] : first[i + 1]] - starts[i]
        if 0 < len(c) < k:
            with np.errstate(over="ignore"):
                whole = rolling_hashes(c, [len(c)])[len(c)]
            own_h, own_at = mix64(whole) >> np.uint64(32), np.zeros(1, np.int64)
        out.append(list(zip(own_h.tolist(), own_at.tolist())))
    return out


def write_fingerprint(anchors: Anchors) -> str:
    return ",".join(["%08x@%x"] * len(anchors)) % tuple(chain.from_iterable(anchors))


def read_fingerprint(fingerprint: str) -> Anchors:
    return [(int(h, 16), int(at, 16)) for h, _, at in (x.partition("@") for x in fingerprint.split(",") if x)]


def matched_in_order(x: list[int], y: list[int]) -> int:
    """Length of the longest common subsequence of two lists of hashes.

    Matching places are chained: each place of ``x`` in turn, its places in ``y`` from the last to the first, and the
    longest rising sequence of the latter (n log n for n matching pairs of places).  Hashes that repeat often in both
    make more pairs than a table held in bits has words; then, and for short lists, the table is used, with the same result.
    """
    in_y = Counter(y)
    if len(x) < TABLE_WORD or sum(in_y[h] for h in x) > len(y) * (1 + len(x) // TABLE_WORD):
        return common_length(x, y)
    places: dict[int, list[int]] = {}
    for j in range(len(y) - 1, -1, -1):
        places.setdefault(y[j], []).append(j)
    ends: list[int] = []  # the smallest last place of a chain of each length
    for h in x:
        for j in places.get(h, ()):
            if not ends or j > ends[-1]:
                ends.append(j)
            else:
                ends[bisect.bisect_left(ends, j)] = j
    return len(ends)


def likeness(a: Anchors, b: Anchors) -> float:
    """Share (0 to 1) of the anchors of both, at all their positions, that both have in the same order."""
    if not a or not b:
        return float(not a and not b)
    x, y = ([h for h, _ in sorted(anchors, key=itemgetter(1))] for anchors in (a, b))
    total = len(x) + len(y)
    # an equal beginning and end, and what only one has, are not compared any further
    x, y, ends = _trimmed(x, y)
    in_x, in_y = Counter(x), Counter(y)
    both = in_x.keys() & in_y.keys()
    union = total - ends - sum(min(in_x[h], in_y[h]) for h in both)
    x, y, more = _trimmed([h for h in x if h in both], [h for h in y if h in both])
    return (ends + more + matched_in_order(x, y)) / union


def _trimmed(x: list[int], y: list[int]) -> tuple[list[int], list[int], int]:
    """Both lists without their equal beginning and end, and the length of these."""
    least = min(len(x), len(y))
    begin = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), least)
    x, y, least = x[begin:], y[begin:], least - begin
    end = next((i for i, (p, q) in enumerate(zip(reversed(x), reversed(y))) if p != q), least)
    return x[: len(x) - end], y[: len(y) - end], begin + end


def _slots(docs: DataFrame, partitions: int) -> DataFrame:
    """``docs`` (doc_id, text) dealt to ranges of doc_id; the first of a range comes again at the end of the one before."""
    spark = docs.sparkSession
    ranges = min(MAX_RANGES, partitions * RANGES_PER_PARTITION)
    fractions = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", fractions)).first()[0] or []))

    def range_of(doc_id):
        return 0 if doc_id is None else bisect.bisect_right(cuts, doc_id)

    own_range = F.udf(range_of, "int", useArrow=True)
    ids = docs.select("doc_id", own_range("doc_id").alias("range"))
    first = ids.groupBy("range").agg(F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    firsts = {r["range"]: None if r["nulls"] else r["least"] for r in first.collect()}  # a row for each range
    used = sorted(firsts)
    before = {r: used[i - 1] for i, r in enumerate(used)}  # before the first range: the last

    @F.udf("array<int>", useArrow=True)
    def slots(doc_id):
        r = range_of(doc_id)
        return [2 * r] + ([2 * before[r] + 1] if firsts.get(r, doc_id) == doc_id else [])

    dealt = docs.select(F.explode(slots("doc_id")).alias("slot"), "doc_id", "text")
    dealt = dealt.withColumn("range", F.shiftright("slot", 1))
    return dealt.repartition(partitions, "range").sortWithinPartitions("range", "slot", "doc_id", "text")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
    """(doc_id, text, next text) of the documents of whole ranges; the extra rows only serve as next."""
    held = None
    for batch in slices(batches):
        texts = texts_of(batch)
        for slot, doc_id, text in zip(batch.column("slot").to_pylist(), batch.column("doc_id").to_pylist(), texts):
            if held is not None:
                yield (*held, text)
            held = None if slot & 1 else (doc_id, text)


def edited_text(text: str, after: str) -> str:
    """The last quarter (rounded down) replaced by the first as many code points of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


OUT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def _rows(pairs: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    edited = [edited_text(text, after) for _, text, after in pairs]
    texts = [text for _, text, _ in pairs]
    # the next text is mostly the following pair's text
    other = [i for i, (_, _, after) in enumerate(pairs) if i + 1 == len(pairs) or pairs[i + 1][1] is not after]
    prints = fingerprints_of(texts + edited + [pairs[i][2] for i in other])
    own, of_edited, of_next = prints[: len(pairs)], prints[len(pairs) : 2 * len(pairs)], prints[1 : len(pairs)] + [[]]
    for i, p in zip(other, prints[2 * len(pairs) :]):
        of_next[i] = p
    columns = [
        pa.array([doc_id for doc_id, _, _ in pairs], pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        pa.array([write_fingerprint(p) for p in own], pa.string()),
        pa.array([write_fingerprint(p) for p in of_edited], pa.string()),
        pa.array([likeness(p, q) for p, q in zip(own, of_edited)], pa.float64()),
        pa.array([likeness(p, q) for p, q in zip(own, of_next)], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in OUT.split(", ")])


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint and how alike it is to an edited copy and to the next document.

    The next document follows in ascending doc_id (after the last: the first; a single
    document follows itself; a null doc_id comes first, rows of the same doc_id by text).
    Returns doc_id, n_chars (code points), edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, one row for each input row, repeated rows
    included.  A null text is empty; two empty fingerprints are fully alike.

    Only doc_id and text are read.  Texts are shuffled once, by range of doc_id; the
    driver gets the range bounds and the first doc_id of each range.
    """
    docs = docs.select("doc_id", "text")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = [], 0
        for pair in _pairs(batches):
            held.append(pair)
            chars += len(pair[1])
            if chars >= BLOCK:
                yield _rows(held)
                held, chars = [], 0
        if held:
            yield _rows(held)

    return _slots(docs, partitions).select("slot", "doc_id", "text").mapInArrow(run, OUT)


def fingerprint_texts(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row of ``docs`` alone (null text: empty); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = pa.array([write_fingerprint(p) for p in fingerprints_of(texts_of(batch))], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), prints], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fingerprint string")
