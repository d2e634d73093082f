"""Benchmark decontamination by latent semantic retrieval.

Passages are overlapping windows of words over every whole text, as TF-IDF vectors: a
column for each word of the benchmark, and hashed columns for all other words.  A
randomised SVD of the passage matrix runs over all documents: each task adds up its part of
(A^T A) times a random matrix, and the singular vectors follow from the sum (Nystroem form,
one pass).  Passages and benchmark items are compared by cosine in the space of the leading
singular vectors, each scaled to the same variance.  The cosine alone chooses candidates;
they are checked by the longest common subsequence of words: near-verbatim ones are leaks,
looser ones (paraphrases) only if the item's answer, its last words, is there as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8_of
from .word_hashes import word_hashes

#: Words of half a passage: passages of two steps overlap by one.
STEP = 16
#: Hashed columns, and words of the benchmark with columns of their own (the rest are hashed, too).
BUCKET_BITS = 14
MAX_OWN = 1 << 16
#: Columns of the random matrix, and singular vectors that are kept.
SKETCH, RANK = 136, 128
SEED = 11
#: Least cosine of a candidate, and least share of common words in order of a leak: outright, and with the answer.
MIN_COSINE = 0.33
VERBATIM, PARAPHRASE, MIN_ANSWER = 0.8, 0.5, 0.6
#: The answer is this share of an item's words, from its end; shorter items are not sought.
ANSWER_SHARE, MIN_ITEM_WORDS = 0.25, 5
#: Items that are compared with a chunk's passages at a time, and candidates that are checked at a time.
ITEM_COLUMNS = 64
CHECKED = 1024
#: Words of a block of items that are counted once in a window, and passages whose windows are counted at a time.
OFTEN = 64
COUNTED = 4096
#: Items are broadcast in blocks of at most so many bytes of text.
ITEM_BLOCK_BYTES = 8 << 20
#: Bytes of text hashed together, rows that are gathered and added at a time, and columns of one row of a sum.
CHUNK_BYTES = 1 << 17
GATHERED = 1 << 12
ADDED = 512
#: Repeats of a word in a chunk that are added to its row one after the other, and that are summed beside other words'.
FEW, MANY = 8, 64
SLOT = 1024

BUCKETS = 1 << BUCKET_BITS
SUMS = "slot int, part int, payload binary"
LEAKS = "doc_id bigint, item_id bigint, kind string, lcs double, answer double, cosine double, first_word bigint"


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


class Places:
    """Places of hashes among ``known`` (ascending, each once)."""

    def __init__(self, known: np.ndarray):
        bits = min(len(known).bit_length() + 3, 20)
        self.known, self.shift = np.append(known, np.uint64(2**64 - 1)), np.uint64(64 - bits)
        # the first place of a hash that begins with these bits, or of a larger one
        self.first = np.searchsorted(known, np.arange(1 << bits, dtype=np.uint64) << self.shift)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash; ``len(known)`` if it is not there."""
        at = self.first.take((hashes >> self.shift).view(np.int64))
        there = self.known.take(at)
        later = np.flatnonzero(there < hashes)  # a known hash with the same first bits comes before
        at[later] = np.searchsorted(self.known[:-1], hashes[later])
        there[later] = self.known[at[later]]
        return np.where(there == hashes, at, len(self.known) - 1)


def columns_of(hashes: np.ndarray, own: Places) -> np.ndarray:
    """Column of each word: the words ``own`` have one each after the hashed ones."""
    at = own.of(hashes)
    return np.where(at < len(own.known) - 1, BUCKETS + at, buckets_of(hashes))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """(doc_ids, texts) of up to CHUNK_BYTES of text, or a longer text alone."""
    ids, texts, size = [], [], 0
    for batch in slices(batches):
        own = batch.column("doc_id").to_pylist() if "doc_id" in batch.schema.names else [None] * batch.num_rows
        for doc_id, text in zip(own, utf8_of(batch)):
            if texts and size + len(text) > CHUNK_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
    if texts:
        yield ids, texts


@dataclass
class Passages:
    """Steps of STEP words of some texts, and the passages of two neighbouring steps."""

    step: np.ndarray  # step of each word
    first_word: np.ndarray  # first word of each step
    text: np.ndarray  # text of each passage
    left: np.ndarray  # first step of each passage
    right: np.ndarray  # its second step; the same as the first in a text of one step

    @staticmethod
    def of(words: np.ndarray) -> Passages:
        """``words``: the number of words of each text."""
        steps = -(-words // STEP)
        begin = np.cumsum(words) - words
        first_step = np.cumsum(steps) - steps
        owner = np.repeat(np.arange(len(words)), steps)
        first_word = begin[owner] + STEP * (np.arange(len(owner)) - first_step[owner])
        step = np.repeat(np.arange(len(owner)), np.diff(np.r_[first_word, int(words.sum())]))
        count = np.where(steps > 1, steps - 1, steps)
        text = np.repeat(np.arange(len(words)), count)
        left = first_step[text] + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        return Passages(step, first_word, text, left, np.where(steps[text] > 1, left + 1, left))

    def step_sums(self, table: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Sum of the words' rows of ``table`` in each step; ``columns``: the row of each word.

        The last row of ``table`` is all zero; it fills up the steps of fewer words.
        """
        steps, k = len(self.first_word), np.arange(STEP)[:, None]
        size = np.diff(np.r_[self.first_word, len(self.step)])
        grid = np.append(columns, len(table) - 1).take(np.where(k < size, self.first_word + k, len(columns)))
        out = np.empty((steps, table.shape[1]), table.dtype)
        rows = np.empty((min(ADDED, steps), table.shape[1]), table.dtype)
        for a in range(0, steps, ADDED):
            part = out[a : a + ADDED]
            table.take(grid[0, a : a + ADDED], 0, part, "clip")
            for row in grid[1:, a : a + ADDED]:
                part += table.take(row, 0, rows[: len(row)], "clip")
        return out


def add_steps(table: np.ndarray, columns: np.ndarray, step: np.ndarray, sums: np.ndarray) -> None:
    """Add to the row of each word in ``table`` the row of its step in ``sums``; in the order of the words, so reruns agree."""
    if not len(columns):
        return
    order = np.sort(columns << 32 | np.arange(len(columns)))  # by column, then as they come
    columns, step = order >> 32, step[order & 0xFFFFFFFF]
    first = np.flatnonzero(np.r_[True, columns[1:] != columns[:-1]])
    times = np.diff(np.r_[first, len(columns)])
    by_times = np.argsort(-times, kind="stable")  # the columns with a k-th word stand before the others
    first, times = first[by_times], times[by_times]
    columns = columns[first]
    above = len(times) - np.cumsum(np.bincount(np.minimum(times, MANY + 1), minlength=MANY + 1))  # columns of over k words
    many, few = int(above[MANY]), int(above[FEW])
    rows = np.empty((ADDED, table.shape[1]), table.dtype)

    def add(into: np.ndarray, a: int, begin: int) -> np.ndarray:
        for k in range(begin, int(times[a])):
            n = min(int(above[k]) - a, len(into))
            into[:n] += sums.take(step.take(first[a : a + n] + k), 0, rows[:n], "clip")
        return into

    for c, a, n in zip(columns[:many].tolist(), first[:many].tolist(), times[:many].tolist()):
        for b in range(a, a + n, GATHERED):
            table[c] += sums.take(step[b : min(b + GATHERED, a + n)], 0).sum(axis=0)
    for a in range(many, few, ADDED):  # summed before they are added
        at = slice(a, min(a + ADDED, few))
        table[columns[at]] += add(sums.take(step[first[at]], 0), a, 1)
    for a in range(few, len(first), ADDED):
        at = columns[a : a + ADDED]
        table[at] = add(table.take(at, 0), a, 0)


def _emit(table: np.ndarray) -> pa.RecordBatch:
    slots = range(0, len(table), SLOT)
    part = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays(
        [
            pa.array([a // SLOT for a in slots], pa.int32()),
            pa.array([part] * len(slots), pa.int32()),
            pa.array([table[a : a + SLOT].tobytes() for a in slots], pa.binary()),
        ],
        names=["slot", "part", "payload"],
    )


def _total(parts: DataFrame, dtype: type, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of the tasks' tables; added by slot in the order of the tasks, so reruns agree."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in slices(batches, 64):
            for slot, payload in zip(batch.column("slot").to_pylist(), batch.column("payload").to_pylist()):
                value = np.frombuffer(payload, dtype)
                total[slot] = total[slot] + value if slot in total else value
        if total:
            columns = [list(total), [0] * len(total), [v.tobytes() for v in total.values()]]
            kinds = (pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["slot", "part", "payload"])

    summed = parts.repartition("slot").sortWithinPartitions("slot", "part").mapInArrow(add, SUMS)
    out = np.zeros(shape, dtype)
    for row in summed.collect():  # one row for each slot of the hashed vocabulary
        rows = np.frombuffer(row["payload"], dtype).reshape(-1, *shape[1:])
        out[row["slot"] * SLOT : row["slot"] * SLOT + len(rows)] = rows
    return out


def benchmark_words(measured: DataFrame) -> np.ndarray:
    """Hashes (ascending) of the benchmark's words, the smallest MAX_OWN."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.unique(word_hashes(utf8_of(batch))[0])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["word"])

    words = measured.select("text").mapInArrow(distinct, "word bigint").distinct()
    # flipping the sign bit orders signed numbers as unsigned ones
    words = words.orderBy(F.col("word").bitwiseXOR(F.lit(-(1 << 63)))).limit(MAX_OWN)
    return np.sort(np.array([r["word"] for r in words.collect()], np.int64).view(np.uint64))


def inverse_frequencies(docs: DataFrame, own: np.ndarray) -> tuple[np.ndarray, int]:
    """(log(1 + documents / (1 + documents with the word)) of each column, bytes of text), over all documents.

    The words ``own`` are counted one by one, all others by bucket.  No word of a document weighs nothing.
    """
    columns = BUCKETS + len(own)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, seen = Places(own), np.zeros(columns + 2, np.int64)  # the last places count documents and bytes
        for _, texts in _chunks(batches):
            hashes, words = word_hashes(texts)
            owner = np.repeat(np.arange(len(words)), words)
            pairs = np.sort(owner * columns + columns_of(hashes, places))
            pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]][: len(pairs)]]
            seen[:columns] += np.bincount(pairs % columns, minlength=columns)
            seen[columns:] += len(texts), sum(map(len, texts))
        yield _emit(seen)

    seen = _total(docs.select("text").mapInArrow(count, SUMS), np.int64, (columns + 2,))
    documents, of_word = seen[columns], seen[:columns]
    return np.log1p(documents / (1 + of_word)).astype(np.float32), int(seen[columns + 1])


def singular_map(docs: DataFrame, own: np.ndarray, idf: np.ndarray, size: int) -> np.ndarray:
    """(columns, RANK) map from word counts to coordinates of equal variance, by randomised SVD over all documents.

    The matrix has a row for each step, so every word counts once.  Each task sends a table
    of columns x SKETCH, so there are no more tasks than keep the tables under ``size``, the
    bytes of text (or than run at once).
    """
    columns = len(idf)

    def random_matrix() -> np.ndarray:
        return np.random.default_rng(SEED).standard_normal((columns, SKETCH), np.float32)

    context = docs.sparkSession.sparkContext
    shared = context.broadcast((own, idf))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, idf = shared.value
        places = Places(own)
        weighted = np.zeros((columns + 1, SKETCH), np.float32)  # a row of zeros at the end
        np.multiply(random_matrix(), idf[:, None], out=weighted[:columns])
        table = np.zeros((columns, SKETCH), np.float32)
        for _, texts in _chunks(batches):
            hashes, words = word_hashes(texts)
            p, ids = Passages.of(words), columns_of(hashes, places)
            add_steps(table, ids, p.step, p.step_sums(weighted, ids))
        yield _emit(table)

    random = random_matrix()
    tasks = max(context.defaultParallelism, size // (columns * SKETCH * 4))
    product = _total(docs.select("text").coalesce(tasks).mapInArrow(multiply, SUMS), np.float32, (columns, SKETCH))
    product = product.astype(np.float64) * idf[:, None]  # (A^T A) times the random matrix
    core = random.T.astype(np.float64) @ product
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values.max(initial=0), 1e-12) * 1e-9
    factor = product @ (vectors[:, good] / np.sqrt(values[good]))
    left, singular, _ = np.linalg.svd(factor, full_matrices=False)
    keep = min(RANK, int((singular > 1e-9 * max(singular.max(initial=0), 1e-12)).sum()))
    out = np.zeros((columns, RANK), np.float32)
    out[:, :keep] = idf[:, None] * left[:, :keep] / singular[:keep]
    return out


def common_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a row of the table held in the bits of one number."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for at in filter(None, map(places.get, b)):
        match = row & at
        if match:
            row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def answer_length(n: int) -> int:
    return max(3, math.ceil(ANSWER_SHARE * n))


def check_passage(item: list[int], words: list[int], start: int) -> tuple[float, float, int]:
    """(share of the item found in order, share of its answer, first word) around a passage; the best place counts."""
    n = len(item)
    reach, span = max(0, n - STEP), math.ceil(1.5 * n)
    answer = item[n - answer_length(n) :]
    low, high = max(0, start - reach), min(len(words), start + 2 * STEP + reach)
    best = (0.0, 0.0, low)
    if leak_kind(common_length(item, words[low : max(high, low + span)]) / n, 1.0) is None:
        return best  # no part of it holds more
    for a in range(low, max(low + 1, high - min(n, span) + 1), max(1, n // 4)):
        region = words[a : a + span]
        found = common_length(item, region) / n
        if found >= PARAPHRASE:
            at = (found, common_length(answer, region) / len(answer), a)
            best = max(best, at, key=lambda x: x[:2])
    return best


def leak_kind(found: float, answer: float) -> str | None:
    if found >= VERBATIM:
        return "verbatim"
    return "paraphrase" if found >= PARAPHRASE and answer >= MIN_ANSWER else None


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


class _Block:
    """Some items next to each other, with the places of their words as bits."""

    def __init__(self, tokens: list[np.ndarray], known: np.ndarray):
        """``known``: hashes (ascending) of the words of all items."""
        self.sizes = np.array([len(t) for t in tokens])
        places = [np.searchsorted(known, t) for t in tokens]
        self.words, word = np.unique(np.concatenate(places), return_inverse=True)
        self.known, self.limbs = len(known), -(-int(self.sizes.max()) // 64)
        at = np.concatenate([np.arange(n) for n in self.sizes])
        item = np.repeat(np.arange(len(tokens)), self.sizes)
        self.cell = item, at // 64, word
        self.bit = np.uint64(1) << (at % 64).astype(np.uint64)
        self.answers = np.zeros((len(tokens), self.limbs), np.uint64)
        answer = at >= np.repeat(self.sizes - [answer_length(n) for n in self.sizes.tolist()], self.sizes)
        np.bitwise_or.at(self.answers, (self.cell[0][answer], self.cell[1][answer]), self.bit[answer])
        # a word's columns in the counts of a step: the items that hold it, or one of its own
        often = np.argsort(-np.bincount(word), kind="stable")[:OFTEN]
        own = np.full(len(self.words), -1)
        own[often] = np.arange(len(often))
        pair, times = np.unique(word * len(tokens) + item, return_counts=True)
        of_word, column = np.divmod(pair, len(tokens))
        rare = own[of_word] < 0
        #: times that each word with a column of its own is in each item
        self.times = np.zeros((len(tokens), len(often)), np.float32)
        self.times[column[~rare], own[of_word[~rare]]] = times[~rare]
        of_word = np.r_[of_word[rare], often]
        order = np.argsort(of_word, kind="stable")
        self.columns = np.r_[column[rare], len(tokens) + np.arange(len(often))][order]
        self.weights = np.r_[times[rare], np.ones(len(often))][order]
        # the last is that of words that no item holds
        self.n_columns = np.bincount(of_word, minlength=len(self.words) + 1)
        self.first_column = np.cumsum(self.n_columns) - self.n_columns

    def local(self, words: np.ndarray) -> np.ndarray:
        """Place of each word among the block's; ``len(self.words)`` if it is not there."""
        local = np.full(self.known + 1, len(self.words), np.int32)
        local[self.words] = np.arange(len(self.words))
        return local.take(words)

    def windows(self, begin: np.ndarray, text_begin: np.ndarray, text_end: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, high): the words around passages that begin at ``begin`` where items of ``n`` words are sought."""
        reach = np.maximum(0, n - STEP)
        low = np.maximum(text_begin, begin - reach)
        high = np.maximum(begin + 2 * STEP + reach, low + np.ceil(1.5 * n).astype(np.int64))
        return low, np.minimum(text_end, high)

    def most(self, local: np.ndarray, p: Passages, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """A bound of the words that each item (row) has in common with words[low:high], for ascending low and high.

        The words of all steps that are touched are counted: those with a column of their own once, others every time.
        """
        left, right = p.step[low], p.step[high - 1] + 1
        begin, steps = int(left[0]), int(right[-1] - left[0])
        here = slice(int(p.first_word[begin]), int(high[-1]) if begin + steps == len(p.first_word) else int(p.first_word[begin + steps]))
        words, step = local[here], p.step[here] - begin
        there = np.flatnonzero(words < len(self.words))
        words, step = words[there], step[there]
        n, items = self.n_columns[words], len(self.sizes)
        at = np.arange(int(n.sum())) + np.repeat(self.first_column[words] - (np.cumsum(n) - n), n)
        rows = items + self.times.shape[1]
        cells = self.columns[at] * (steps + 1) + np.repeat(step + 1, n)  # place 0 of a row is the sum before the first step
        sums = np.bincount(cells, self.weights[at], rows * (steps + 1)).astype(np.int32).reshape(rows, steps + 1)
        np.cumsum(sums, axis=1, out=sums)
        counts = sums.take(right - begin, 1) - sums.take(left - begin, 1)
        return self.times @ (counts[items:] > 0).astype(np.float32) + counts[:items]

    def possible(self, local: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether enough of the item's words are in words[low:high] at all, in any order, for a leak.

        No leak is lost: common words in order are never more than common words.
        """
        if not len(item):
            return np.zeros(0, bool)
        masks = np.zeros((len(self.sizes), self.limbs, len(self.words) + 1), np.uint64)
        np.bitwise_or.at(masks, self.cell, self.bit)
        masks = masks.ravel()
        out = np.zeros(len(item), bool)
        order = np.argsort(high - low, kind="stable")  # candidates of one length side by side
        for a in range(0, len(order), CHECKED):
            part = order[a : a + CHECKED]
            wide = np.arange(int((high - low)[part].max()))
            at = np.minimum(low[part] + wide[:, None], high[part] - 1)  # the last word again
            place = local.take(at)
            found = np.zeros(len(part), np.int64)
            of_answer = np.zeros(len(part), np.int64)
            for limb in range(self.limbs):
                row = ((item[part] * self.limbs + limb) * (len(self.words) + 1)).astype(np.int32)
                bits = np.bitwise_or.reduce(masks.take(place + row), axis=0)
                found += np.bitwise_count(bits)
                of_answer += np.bitwise_count(bits & self.answers[item[part], limb])
            n = self.sizes[item[part]]
            answer = np.bitwise_count(self.answers[item[part]]).sum(axis=1)
            out[part] = (found >= VERBATIM * n) | ((found >= PARAPHRASE * n) & (of_answer >= MIN_ANSWER * answer))
        return out

    def candidates(self, words: np.ndarray, p: Passages, bounds: tuple[np.ndarray, ...], near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, item) of the pairs ``near`` (items, passages) in whose windows enough of the item's words are for a leak.

        ``bounds``: where each passage, its text and the next text begin.
        """
        if not near.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        local = self.local(words)
        for a in range(0, near.shape[1], COUNTED):
            part = slice(a, a + COUNTED)
            # the window of the longest item holds those of the others
            most = self.most(local, p, *self.windows(*(b[part] for b in bounds), self.sizes.max()))
            near[:, part] &= most >= PARAPHRASE * self.sizes[:, None]
        item, passage = np.divmod(np.flatnonzero(near), near.shape[1])
        low, high = self.windows(*(b[passage] for b in bounds), self.sizes[item])
        likely = self.possible(local, item, low, high)
        return passage[likely], item[likely]


def _search(docs: DataFrame, items: list[tuple[int, bytes]], own: np.ndarray, space: np.ndarray) -> DataFrame:
    """Leaks of one block of items in all documents."""
    hashes, words = word_hashes([t for _, t in items])
    ends = np.cumsum(words)
    tokens = [hashes[e - n : e] for e, n in zip(ends, words)]
    kept = sorted((i for i, t in enumerate(tokens) if len(t) >= MIN_ITEM_WORDS), key=lambda i: len(tokens[i]))
    ids = [items[i][0] for i in kept]
    tokens = [tokens[i] for i in kept]
    shared = docs.sparkSession.sparkContext.broadcast((ids, tokens, own, space))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tokens, own, space = shared.value
        if not tokens:
            return
        known = np.unique(np.concatenate(tokens))
        # one search for both: place among the items' words, and column of the space
        both_known = np.union1d(known, own)
        places_of, place_of = Places(both_known), np.append(Places(known).of(both_known), len(known))
        own_places = Places(own)
        column_of = columns_of(both_known, own_places)
        space = np.vstack([space, np.zeros_like(space[:1])])  # a row of zeros at the end
        queries = _unit(np.array([space[columns_of(t, own_places)].sum(axis=0) for t in tokens], np.float32))
        blocks = [_Block(tokens[a : a + ITEM_COLUMNS], known) for a in range(0, len(tokens), ITEM_COLUMNS)]
        lists = [t.tolist() for t in tokens]
        for doc_ids, texts in _chunks(batches):
            hashes, words = word_hashes(texts)
            if not len(hashes):
                continue
            at = places_of.of(hashes)
            columns, places = buckets_of(hashes), place_of[at]
            there = np.flatnonzero(at < len(both_known))
            columns[there] = column_of[at[there]]
            p = Passages.of(words)
            of_step = p.step_sums(space, columns)
            one = np.flatnonzero(p.right == p.left)
            size_both = of_step.take(p.right, 0)
            size_both[one] = 0
            size_both += of_step.take(p.left, 0)
            size_both = np.maximum(np.linalg.norm(size_both, axis=1), 1e-12)[:, None]
            size_step = np.maximum(np.linalg.norm(of_step, axis=1), 1e-12)[:, None]
            begin = np.cumsum(words) - words
            begin_at = p.first_word[p.left]
            bounds = begin_at, begin[p.text], (begin + words)[p.text]
            leaks: dict[tuple[int, int], tuple] = {}
            of_text: dict[int, list[int]] = {}
            for k, block in enumerate(blocks):
                a = k * ITEM_COLUMNS
                step = of_step @ queries[a : a + ITEM_COLUMNS].T
                both = step.take(p.right, 0)
                both[one] = 0
                both += step.take(p.left, 0)
                both /= size_both
                step /= size_step  # short items fill one step
                near = step >= MIN_COSINE
                near = (both >= MIN_COSINE) | near.take(p.left, 0) | near.take(p.right, 0)
                for q, j in zip(*(x.tolist() for x in block.candidates(places, p, bounds, np.ascontiguousarray(near.T)))):
                    text, i = int(p.text[q]), a + j
                    cosine = max(both[q, j], step[p.left[q], j], step[p.right[q], j])
                    leak = leaks.get((text, i))
                    if leak and leak[0] == 1.0:
                        continue
                    if text not in of_text:
                        of_text[text] = hashes[begin[text] : begin[text] + words[text]].tolist()
                    found, answer, first = check_passage(lists[i], of_text[text], int(begin_at[q] - begin[text]))
                    kind = leak_kind(found, answer)
                    row = (found, answer, float(cosine), first, kind)
                    if kind and (leak is None or row[:3] > leak[:3]):
                        leaks[text, i] = row
            out = [(doc_ids[t], ids[i], r[4], r[0], r[1], r[2], r[3]) for (t, i), r in sorted(leaks.items())]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            names = [f.split()[0] for f in LEAKS.split(", ")]
            fields = list(zip(*out)) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(fields, kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, LEAKS)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Benchmark items that documents hold, verbatim or paraphrased.

    ``docs``: doc_id, text.  ``benchmark``: item_id, text.  Returns a row for each row of
    ``docs`` and item that leaked: doc_id, item_id, kind (verbatim or paraphrase), lcs
    (share of the item's words found in order), answer (the same for its last words),
    cosine, and first_word of the place.  Null or empty texts hold no words and leak
    nothing; a null doc_id is returned as null; items of fewer than MIN_ITEM_WORDS words,
    null ones included, are not sought; rows without an item_id are.  Repeated rows give
    repeated results; repeated items count once.  Empty tables give no rows.

    Document frequencies and the SVD cover all documents.  The driver gets the sums over
    the columns (at most (BUCKETS + MAX_OWN) x SKETCH numbers) and the benchmark in blocks of
    ITEM_BLOCK_BYTES; each block is one more pass over the documents.
    """
    # an item is sent as long as it is, so the blocks are cut by its bytes
    measured = benchmark.select("item_id", "text").filter("text is not null").distinct()
    total = measured.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / ITEM_BLOCK_BYTES))
    own = benchmark_words(measured)
    idf, size = inverse_frequencies(docs, own)
    space = singular_map(docs, own, idf, size)
    out = None
    for b in range(blocks):
        rows = measured.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        items = [(r["item_id"], r["text"].encode()) for r in rows]
        found = _search(docs, sorted(items, key=lambda x: (x[0] is None, x)), own, space)
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs``, with the same columns, that hold no benchmark item; rows without a doc_id stay."""
    leaked = find_leaks(docs, benchmark).filter("doc_id is not null").select(F.col("doc_id").alias("leaked_id")).distinct()
    return docs.join(leaked, docs["doc_id"] == leaked["leaked_id"], "left_anti")
