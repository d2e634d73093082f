"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut at the tokenizer's special strings (each one token) and then into
words by the byte-level pre-tokenizer's pattern.  The symbols of a word form a
linked list; the adjacent pair of the lowest merge rank is popped from a heap
again and again and merged.  The count is the number of initial symbols minus
the number of merges; no token identifiers are built.

Words repeat, so each worker keeps the counts of recent words in two bounded
generations.  They only save time: a word not found is merged again.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices, texts_of

#: Entries of each of the two generations of word counts that a worker keeps.
CACHE_WORDS = 200_000
#: Longer words are merged each time and not kept.
CACHE_WORD_CHARS = 64
#: A tokenizer file over this size is refused, as its merge table is broadcast.
MAX_TOKENIZER_BYTES = 64 << 20

# Character classes of the byte-level pattern for code points up to U+00FF.
LATIN_LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
LATIN_NUMBERS = r"0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_SPACES = r"\t-\r \x85\xa0"

# Letters and numbers that Unicode gained after version 16, which the
# tokenizer's library does not know yet and so treats as other symbols.
NEWER_THAN_UNICODE_16 = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2),
    (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3),
    (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE),
    (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF),
    (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]


def _pattern(letters: str, numbers: str, spaces: str, other: str) -> str:
    return (
        rf" ?{letters}+| ?{numbers}+|'(?:[stmd]|re|ve|ll)| ?{other}+"
        rf"|[{spaces}]+(?![^{spaces}])|[{spaces}]+"
    )


def word_patterns():
    """The pre-tokenizer's pattern: a quick form for texts up to U+00FF, and the full one."""
    latin = re.compile(
        _pattern(
            f"[{LATIN_LETTERS}]", f"[{LATIN_NUMBERS}]", LATIN_SPACES, f"[^{LATIN_LETTERS}{LATIN_NUMBERS}{LATIN_SPACES}]"
        )
    )
    newer = "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in NEWER_THAN_UNICODE_16)
    full = regex.compile(
        "(?V1)" + _pattern(rf"[\p{{L}}--[{newer}]]", rf"[\p{{N}}--[{newer}]]", r"\s", rf"(?:[^\s\p{{L}}\p{{N}}]|[{newer}])")
    )
    return latin, full


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    symbol = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [symbol[b] for b in range(256)]


def load_merges(path: str) -> tuple[dict[tuple[str, str], int], list[str]]:
    """(rank of each mergeable pair, special strings) of a byte-level BPE tokenizer file."""
    with open(path, encoding="utf-8") as f:
        raw = f.read(MAX_TOKENIZER_BYTES + 1)
    if len(raw) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{path} is larger than {MAX_TOKENIZER_BYTES} bytes")
    spec = json.loads(raw)
    pre = spec.get("pre_tokenizer") or {}
    plain = not (pre.get("add_prefix_space") or spec.get("normalizer") or spec["model"].get("ignore_merges"))
    if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or not plain:
        raise ValueError(f"{path}: only plain byte-level BPE tokenizers are supported")
    pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
    added = spec.get("added_tokens", [])
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError(f"{path}: added tokens that take neighbouring text are not supported")
    return {(a, b): rank for rank, (a, b) in enumerate(pairs)}, [t["content"] for t in added]


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after all merges: lowest rank first, leftmost on ties."""
    n = len(symbols)
    if n < 2:
        return n
    symbols = list(symbols)
    after = [*range(1, n), -1]
    before = list(range(-1, n - 1))
    heap = []
    for k in range(n - 1):
        rank = ranks.get((symbols[k], symbols[k + 1]))
        if rank is not None:
            heap.append((rank, k, symbols[k + 1]))
    heapq.heapify(heap)
    left = n
    while heap:
        rank, k, right = heapq.heappop(heap)
        j = after[k]
        # A popped pair is stale when either symbol has since been merged away or grown.
        if symbols[k] is None or j < 0 or symbols[j] != right or ranks.get((symbols[k], right)) != rank:
            continue
        symbols[k] += right
        symbols[j] = None
        after[k] = j = after[j]
        left -= 1
        if j >= 0:
            before[j] = k
            rank = ranks.get((symbols[k], symbols[j]))
            if rank is not None:
                heapq.heappush(heap, (rank, k, symbols[j]))
        i = before[k]
        if i >= 0:
            rank = ranks.get((symbols[i], symbols[k]))
            if rank is not None:
                heapq.heappush(heap, (rank, i, symbols[k]))
    return left


class WordCounts(dict):
    """word -> number of tokens, computed on a miss; keeps two bounded generations."""

    def __init__(self, ranks: dict[tuple[str, str], int], limit: int = CACHE_WORDS):
        self.ranks, self.limit, self.old = ranks, limit, {}
        self.symbols = byte_symbols()

    def __missing__(self, word: str) -> int:
        count = self.old.get(word)
        if count is None:
            symbols = self.symbols
            count = merged_length([symbols[b] for b in word.encode()], self.ranks)
        if len(word) <= CACHE_WORD_CHARS:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[word] = count
        return count


class TokenCounter:
    def __init__(self, ranks: dict[tuple[str, str], int], specials: list[str]):
        self.words = WordCounts(ranks)
        self.latin, self.full = word_patterns()
        longest_first = sorted(specials, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest_first))) if specials else None

    def count(self, text: str) -> int:
        if not text:
            return 0
        parts = self.special.split(text) if self.special else [text]
        find = (self.latin if max(text) <= "\xff" else self.full).findall
        return len(parts) - 1 + sum(sum(map(self.words.__getitem__, find(p))) for p in parts)


def count_tokens(docs: DataFrame, tokenizer_path: str, max_tokens: int = 512) -> DataFrame:
    """Tokens of every whole text under a byte-level BPE tokenizer file.

    Returns doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``max_tokens``),
    one row for each input row, repeated rows included.  A null or empty text has no
    bytes and no tokens; a null doc_id is kept.  A very long text is one row of one
    task; a long word takes n log n steps.  Only doc_id and text are read.
    """
    ranks, specials = load_merges(tokenizer_path)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, specials))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(*shared.value)
        for batch in slices(batches):
            texts = texts_of(batch)
            tokens = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > max_tokens for n in tokens], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )
