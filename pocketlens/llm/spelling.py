"""Spelling variants: words one edit apart, found by composing acceptors with a one-edit transducer.

The vocabulary's machine is cut by initial state.  Two words one edit apart share the
letters before the edit and those after it, so a partition is a range of edit positions
together with the letters that all pairs edited there share: for words of a length, either
the first half (edits behind it) or the last half (edits before it).  Each partition gets its
own minimal acceptor, composed with the transducer and itself.  A partition of too many
words is cut at the middle of its range, which makes the shared part longer; at a single position it
holds words that differ in two letters at most, so every partition is bounded.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automata import Acceptor, OneEdit
from .common import materialise, slices, texts_of

LETTERS = "a-zÀ-ÿ"
MIN_CHARS = 7
MIN_COUNT = 2
#: A form is this many times as frequent as its variant.
RATIO = 10
#: One in so many (document, run) loses a letter in the query's table of words.
DAMAGE = 31
#: Different words that a task counts before it hands them on.
HELD_WORDS = 200_000
#: Words of a partition beyond which it is cut.
GROUP_WORDS = 20_000

GROUP = ["chars", "low", "high", "head", "tail"]


def damaged(doc_id: int | None, run: str, damage: int = DAMAGE) -> str:
    """The run, less one letter where ``damage`` divides the crc32 of ``<doc_id>:<run>`` (null doc_id: empty)."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    at = h % len(run)
    return run if h % damage else run[:at] + run[at + 1 :]


def _counted(min_chars: int, damage: int | None):
    runs = re.compile(f"[{LETTERS}]{{{min_chars},}}")  # shorter runs never give a word

    def batch_of(counts: Counter) -> pa.RecordBatch:
        columns = [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                found = Counter(runs.findall(text.encode().lower().decode()))  # bytes: A-Z alone
                for word, n in found.items():
                    if damage:
                        word = damaged(doc_id, word, damage)
                    if len(word) >= min_chars:
                        counts[word] += n
                if len(counts) >= HELD_WORDS:
                    yield batch_of(counts)
                    counts = Counter()
        yield batch_of(counts)

    return run


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, damage: int | None = None) -> DataFrame:
    """(word, n): runs of letters A-Z, a-z, U+00C0 to U+00FF of the texts, A-Z lower-cased, with their counts.

    Words of fewer than ``min_chars`` code points or ``min_count`` occurrences over all documents are left out; a null
    text has none.  Repeated rows count each time.  With ``damage``, runs first lose letters as :func:`damaged` says.
    """
    words = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_counted(min_chars, damage), "word string, n bigint")
    return words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows with the letters that pairs of their range share: ``low`` before, and those behind ``high``."""
    return rows.withColumns({"head": F.expr("substring(word, 1, low)"), "tail": F.expr("right(word, greatest(0, chars - 1 - high))")})


def partitions(words: DataFrame, min_chars: int = MIN_CHARS, group_words: int = GROUP_WORDS) -> DataFrame:
    """Each word with the partitions (GROUP columns) in which its pairs are found.

    ``chars`` is the length of a pair's shorter word, so a word goes to its own length and to
    the one below; ``low`` to ``high`` is the range of the pair's common first letters.
    """
    ranges = F.expr(
        f"""filter(flatten(transform(filter(array(length(word), length(word) - 1), c -> c >= {min_chars}),
            c -> array(struct(c AS chars, c div 2 AS low, bigint(c) AS high), struct(c AS chars, bigint(0) AS low, c div 2 - 1 AS high)))),
            r -> r.low <= r.high)"""
    )
    rows = words.select("word", "n", F.explode(ranges).alias("r")).select("word", "n", "r.*")
    rows = _dealt(rows.withColumns({c: F.col(c).cast("int") for c in ("low", "high")}))
    done = None
    while True:
        rows = materialise(rows, "spelling-partitions")
        large = rows.groupBy(*GROUP).count().filter((F.col("count") > group_words) & F.expr("low < high"))
        large = materialise(large.select(*GROUP), "spelling-large")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, GROUP, "left_anti").select(*rows.columns)
        done = small if done is None else done.unionByName(small)
        halves = F.expr(
            """explode(array(struct(low AS low, (low + high + 1) div 2 - 1 AS high), struct((low + high + 1) div 2 AS low, high AS high)))"""
        )
        rows = rows.join(large, GROUP, "left_semi").select("word", "n", "chars", halves.alias("r"))
        rows = _dealt(rows.select("word", "n", "chars", F.col("r.low").cast("int").alias("low"), F.col("r.high").cast("int").alias("high")))


def near_pairs(words: list[str], chars: int, high: int) -> list[tuple[int, int]]:
    """Pairs (places in ``words``) one edit apart, the shorter of ``chars`` letters, with ``high`` common first letters at most."""
    head = len(os.path.commonprefix(words))
    tail = len(os.path.commonprefix([word[:head - 1 if head else None : -1] for word in words]))
    tail = min(tail, min(map(len, words)) - head)
    rests = sorted((word[head : len(word) - tail], i) for i, word in enumerate(words))
    pairs = OneEdit(Acceptor([rest for rest, _ in rests])).pairs(high - head)
    out = []
    for i, j in pairs:
        a, b = words[rests[i][1]], words[rests[j][1]]
        # letters of the tail may lengthen what the words share in front
        if min(len(a), len(b)) == chars and len(os.path.commonprefix([a, b])) <= high:
            out.append((rests[i][1], rests[j][1]))
    return out


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by partition; out come both directions of each pair."""

    def pairs(group: tuple, words: list[str], counts: list[int], out: tuple) -> None:
        for i, j in near_pairs(words, group[0], group[2]) if len(words) > 1 else ():
            for a, b in ((i, j), (j, i)):
                out[0].append(words[a])
                out[1].append(words[b])
                out[2].append(counts[b])

    def batch_of(out: tuple) -> pa.RecordBatch:
        columns = [pa.array(x, t) for x, t in zip(out, (pa.string(), pa.string(), pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["word", "near", "near_n"])

    now, words, counts, out = None, [], [], ([], [], [])
    for batch in slices(batches, 8192):
        groups = zip(*(batch.column(c).to_pylist() for c in GROUP))
        for group, word, n in zip(groups, batch.column("word").to_pylist(), batch.column("n").to_pylist()):
            if group != now:
                pairs(now, words, counts, out)
                now, words, counts = group, [], []
            words.append(word)
            counts.append(n)
        if len(out[0]) > 8192:
            yield batch_of(out)
            out = ([], [], [])
    pairs(now, words, counts, out)
    yield batch_of(out)


def near_words(words: DataFrame, min_chars: int = MIN_CHARS, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, near, near_n) for each ordered pair of ``words`` (word, n; different) one inserted, deleted or replaced code point apart."""
    rows = partitions(words, min_chars, group_words).repartition(*GROUP).sortWithinPartitions(*GROUP)
    return rows.select(*GROUP, "word", "n").mapInArrow(_compose, "word string, near string, near_n bigint")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last.  Counts grow with every step, so paths are short and end; they double each round."""
    links = materialise(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while not links.filter("moved").isEmpty():
        ahead = links.select(F.col("word").alias("at"), F.col("root").alias("ahead"))
        links = links.join(ahead, links["root"] == ahead["at"], "left")
        links = materialise(links.select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "spelling-roots")
    return links.select("word", "root")


def group_spellings(words: DataFrame, ratio: int = RATIO, min_chars: int = MIN_CHARS, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of ``words`` (word, n; each word once, ``min_chars`` code points or more).

    Near words differ by one inserted, deleted or replaced code point.  A word's form is
    its near word of largest n (ties: the smallest in code-point order) if that n is at
    least ``ratio`` (over 1) times the word's, else null; ``root`` follows forms to the last, the word itself if it has none.
    Rows with a null word or n are ignored.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1")
    words = materialise(words.select("word", "n").filter("word is not null and n is not null"), "spelling-words")
    near = near_words(words, min_chars, group_words).groupBy(F.col("word").alias("of_word"))
    near = near.agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    judged = words.join(near, words["word"] == near["of_word"], "left")
    fits = -F.col("best.less") >= ratio * F.col("n")
    judged = judged.select(
        "word",
        F.when(fits, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(fits, -F.col("best.less")).alias("form_n"),
    )
    judged = materialise(judged, "spelling-forms")
    roots = _roots(judged.filter("form is not null"))
    out = judged.join(roots.withColumnRenamed("word", "of_word"), judged["word"] == F.col("of_word"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
