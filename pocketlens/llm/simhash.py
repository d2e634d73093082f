"""SimHash near-duplicates by anchor-point covering.

Anchors are the codewords of two binary Golay codes [23,12] on the fingerprint's
bits 0-22 and 23-45.  The code is perfect with radius 3, so each fingerprint has one
home anchor within 3 bits in each block.  For a threshold t, a fingerprint is
replicated to every anchor within radius plus threshold: at distance 3 + x in one
block and 3 + y in the other with x + y <= t.  Two fingerprints that differ in t or
fewer bits therefore meet at each other's home anchor; there all 64 bits are compared.

There are 2**24 anchors, so groups stay small however large the table is, except in
dense clusters of different fingerprints.  An anchor with more than HOT_GROUP
members passes them on to an exact second step that needs no comparison: each
fingerprint goes to all points within ceil(t/2) bits.  Members within floor(t/2) and
ceil(t/2) of a point are within t of each other, any two linked fingerprints share
such a point, and a point has a bounded number of different members.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, materialise, slices, utf8_of
from .components import connected_components

# The generator polynomial of the binary Golay code, its length, redundancy and covering radius.
GOLAY_POLYNOMIAL = 0b110001110101
GOLAY_BITS, GOLAY_CHECKS, GOLAY_RADIUS = 23, 11, 3

#: Members of an anchor that are compared with its home members in memory.
HOT_GROUP = 1024
#: Fingerprints that are replicated at a time.
REPLICATE_ROWS = 4096
#: Largest threshold: members of an anchor grow steeply with it.
MAX_DISTANCE = 3


def shingle_hashes(text: bytes, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, A-Z lower-cased; all words if there are fewer."""
    words = text.lower().split()  # on bytes: A-Z only, and the six ASCII white-space bytes
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    ends = ends.tolist()
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :])]
    return np.array(hashes, np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """Each bit that more than half of the hashes have; zero without hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.ascontiguousarray(hashes[at : at + 65536]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each row, repeated rows included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bits = [majority_bits(shingle_hashes(t, shingle, seed)) for t in utf8_of(batch)]
            fp = pa.array(np.array(bits, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fp], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fp bigint")


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits of a block."""
    unit = []
    for k in range(GOLAY_BITS):
        v = 1 << k
        for high in range(k, GOLAY_CHECKS - 1, -1):
            if v >> high & 1:
                v ^= GOLAY_POLYNOMIAL << (high - GOLAY_CHECKS)
        unit.append(v)

    def table(units: list[int]) -> np.ndarray:
        out = np.zeros(1 << len(units), np.int64)
        for k, u in enumerate(units):
            out[1 << k : 2 << k] = out[: 1 << k] ^ u
        return out

    return table(unit[:12]), table(unit[12:])


def golay_syndrome(block: np.ndarray) -> np.ndarray:
    low, high = golay_tables()
    return low[block & 0xFFF] ^ high[block >> 12]


@cache
def golay_offsets(weight: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, first place of each syndrome): words of a weight by syndrome; xor with one gives a codeword."""
    words = np.array([sum(1 << b for b in c) for c in combinations(range(GOLAY_BITS), weight)], np.int64)
    syndrome = golay_syndrome(words)
    order = np.argsort(syndrome, kind="stable")
    return words[order], np.searchsorted(syndrome[order], np.arange((1 << GOLAY_CHECKS) + 1))


def block_anchors(block: np.ndarray, excess: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword) of all codewords at distance radius + ``excess`` (0: up to the radius)."""
    syndrome = golay_syndrome(block)
    rows, words = [], []
    for weight in range(GOLAY_RADIUS + 1) if excess == 0 else [GOLAY_RADIUS + excess]:
        offsets, first = golay_offsets(weight)
        n = first[syndrome + 1] - first[syndrome]
        row = np.repeat(np.arange(len(block)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[syndrome][row]
        rows.append(row)
        words.append(block[row] ^ offsets[at])
    return np.concatenate(rows), np.concatenate(words)


def anchors_of(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, whether it is the home anchor) of all anchors that a fingerprint goes to."""
    mask = np.uint64((1 << GOLAY_BITS) - 1)
    blocks = [(fp & mask).astype(np.int64), ((fp >> np.uint64(GOLAY_BITS)) & mask).astype(np.int64)]
    found = []
    for x in range(distance + 1):
        row_a, word_a = block_anchors(blocks[0], x)
        for y in range(distance + 1 - x):
            row_b, word_b = block_anchors(blocks[1], y)
            # all pairs of the two blocks' anchors of a row; both lists are put in row order
            oa, ob = np.argsort(row_a, kind="stable"), np.argsort(row_b, kind="stable")
            ra, wa, rb, wb = row_a[oa], word_a[oa], row_b[ob], word_b[ob]
            first = np.searchsorted(rb, np.arange(len(fp) + 1))
            n = (first[1:] - first[:-1])[ra]
            pair = np.repeat(np.arange(len(ra)), n)
            at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + first[ra][pair]
            anchor = wa[pair] | (wb[at] << GOLAY_BITS)
            found.append((ra[pair], anchor, np.full(len(pair), x + y == 0)))
    return tuple(np.concatenate(c) for c in zip(*found))


def _local_roots(n: int, i: np.ndarray, j: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Smallest fingerprint that each of n rows reaches over the links i-j."""
    root = fp.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        if np.array_equal(before, root):
            return root


def _links_in(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links among whole anchor groups (rows in anchor order): home members against all."""
    start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    size = np.diff(np.r_[start, len(anchor)])
    group = np.repeat(np.arange(len(start)), size)
    homes = np.flatnonzero(home & (size[group] > 1))
    found_i, found_j = [], []
    todo = np.cumsum(size[group[homes]])
    for part in np.split(homes, np.searchsorted(todo, np.arange(1 << 20, todo[-1], 1 << 20))) if len(homes) else []:
        n = size[group[part]]
        i = np.repeat(part, n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + start[group[i]]
        near = (np.bitwise_count(fp[i] ^ fp[j]) <= distance) & (fp[i] != fp[j])
        found_i.append(i[near])
        found_j.append(j[near])
    if not found_i:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    # links stay inside a group, as a group's rows carry its own copies of the fingerprints
    rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    root = _local_roots(len(rows), at[: len(i)], at[len(i) :], fp[rows])
    keep = root != fp[rows]
    return fp[rows][keep], root[keep]


LINKS = "a bigint, b bigint, hot boolean"


def _links_batch(a: np.ndarray, b: np.ndarray, hot: bool) -> pa.RecordBatch:
    columns = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (a, b)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(a), hot))], names=["a", "b", "hot"])


def _compare(distance: int, hot_group: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)]
        hot_anchor = None
        for batch in batches:
            new = (
                batch.column("anchor").to_numpy(),
                batch.column("fp").to_numpy().view(np.uint64),
                batch.column("home").to_numpy(zero_copy_only=False),
            )
            anchor, fp, home = (np.concatenate(x) for x in zip(held, new))
            if not len(anchor):
                continue
            whole = np.searchsorted(anchor, anchor[-1])  # the last group may go on in the next batch
            passed = np.searchsorted(anchor, hot_anchor, "right") if hot_anchor is not None else 0
            if passed:
                yield _links_batch(fp[:passed], fp[:passed], True)
            anchor, fp, home, whole = anchor[passed:], fp[passed:], home[passed:], max(0, whole - passed)
            start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.empty(0, int)
            size = np.diff(np.r_[start, len(anchor)])
            hot = np.repeat(size > hot_group, size)
            if hot.any():
                yield _links_batch(fp[hot], fp[hot], True)
                if hot[-1]:
                    hot_anchor, whole = anchor[-1], len(anchor)
            ready = ~hot & (np.arange(len(anchor)) < whole)
            yield _links_batch(*_links_in(anchor[ready], fp[ready], home[ready], distance), False)
            held = [x[whole:] for x in (anchor, fp, home)]
        if len(held[0]):
            yield _links_batch(*_links_in(*held, distance), False)

    return run


def _points_of(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, point) of all points at exactly ``radius`` bits."""
    flips = [sum(1 << b for b in c) for c in combinations(range(64), radius)]
    points = fp[:, None] ^ np.array(flips, np.uint64)[None, :]
    return np.repeat(np.arange(len(fp)), len(flips)), points.ravel()


def _links_of_dense(fps: DataFrame, distance: int) -> DataFrame:
    """Exact star links among different fingerprints of dense clusters, without comparisons."""
    near, far = distance // 2, (distance + 1) // 2

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for radius in range(far + 1):
                row, point = _points_of(fp, radius)
                columns = [pa.array(x.view(np.int64)) for x in (point, fp[row])]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(np.full(len(row), radius <= near))], names=["point", "fp", "near"]
                )

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        point, root = None, None  # rows come with the near members of a point first
        for batch in batches:
            points, fps_, nears = (batch.column(c).to_pylist() for c in ("point", "fp", "near"))
            a, b = [], []
            for p, fp, is_near in zip(points, fps_, nears):
                if p != point:
                    point, root = p, fp if is_near else None
                elif root is not None:
                    a.append(fp)
                    b.append(root)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = fps.mapInArrow(spread, "point bigint, fp bigint, near boolean").repartition("point")
    return dealt.sortWithinPartitions("point", F.desc("near"), "fp").mapInArrow(star, "a bigint, b bigint")


def fingerprint_links(fps: DataFrame, distance: int = 2, hot_group: int = HOT_GROUP) -> DataFrame:
    """Links (a, b) that connect all pairs of different ``fp`` differing in ``distance`` or fewer bits.

    Not all pairs are returned: each anchor gives a star for each cluster of its members.
    """
    if not 0 <= distance <= MAX_DISTANCE:
        raise ValueError(f"distance must be 0 to {MAX_DISTANCE}")

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, REPLICATE_ROWS):
            fp = batch.column("fp").to_numpy().view(np.uint64)
            row, anchor, home = anchors_of(fp, distance)
            columns = [pa.array(anchor), pa.array(fp[row].view(np.int64)), pa.array(home)]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "fp", "home"])

    members = fps.mapInArrow(replicate, "anchor bigint, fp bigint, home boolean")
    dealt = members.repartition("anchor").sortWithinPartitions("anchor")
    links = materialise(dealt.mapInArrow(_compare(distance, hot_group), LINKS), "simhash-links")
    dense = links.filter("hot").select(F.col("a").alias("fp")).distinct()
    return links.filter("not hot").select("a", "b").unionByName(_links_of_dense(dense, distance))


def near_duplicates(
    docs: DataFrame, shingle: int = 3, distance: int = 2, seed: int = 42, hot_group: int = HOT_GROUP
) -> DataFrame:
    """Fingerprint and near-duplicate component of every document.

    Words are runs without ASCII white space, A-Z lower-cased; shingles of ``shingle``
    words count with repeats; a text of fewer words is one shingle; a null or empty
    text has fingerprint zero and links like any other.  Returns doc_id, fp (signed
    long) and component_id, the smallest doc_id reachable over links of ``distance`` or
    fewer bits, one row for each input row, repeated rows included.  A null doc_id
    belongs to a component but is never its smallest (null if there is no other).
    Equal fingerprints are linked by their value alone and never paired.
    """
    marked = materialise(fingerprints(docs, shingle, seed), "simhash-fps")
    fps = marked.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = connected_components(fingerprint_links(fps.select("fp"), distance, hot_group))
    rooted = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, seed: int = 42) -> DataFrame:
    """The document of the smallest doc_id of each component, with all its columns.

    Of repeated doc_ids one row stays; rows without a doc_id cannot be named and stay.
    """
    marks = near_duplicates(docs, shingle, distance, seed).filter("doc_id = component_id")
    kept = marks.select(F.col("doc_id").alias("kept_doc_id")).distinct()
    return keep_rows(docs, kept, "kept_doc_id")
