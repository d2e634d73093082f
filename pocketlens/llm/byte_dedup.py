"""Removal of repeated byte strings with per-shard suffix arrays.

A byte goes when a string of ``match`` bytes that covers it starts anywhere else as well.
All pairs of shards cannot be compared, so equal strings are first brought together:

1. Each window of ``match`` bytes belongs to its anchor, the run of ANCHOR bytes of the
   smallest hash in it.  Equal windows have equal anchors.  The windows of one anchor make
   one *piece* of text, known by the hashes of its anchor and of its bytes.
2. By anchor: a piece that occurs twice is removed whole.  An anchor with one piece that
   occurs once has no match.  Only anchors with different pieces go on, with one
   occurrence of each piece (the *variants*).
3. The variants' texts are dealt to shards by anchor.  A shard's suffix array
   (Larsson-Sadakane) and common prefixes (Kasai) show which windows repeat.
4. An anchor with too many variants for one shard is cut into several.  Each gives its
   distinct windows as sorted digests, dealt by digest, and a binary search in the merged
   run finds those that stand in more than one shard.
5. The removed spans of a document are put together and cut from its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix64, rolling_hashes, slices, utf8_of
from .suffixes import repeated_windows

MATCH = 200
ANCHOR = 40
#: Bytes hashed at a time; positions in a block take the lowest bits of a sort key.
BLOCK = 1 << 16
_PLACE_BITS = np.uint64(17)
#: Text gathered in a task before anchors are sought, and pieces gathered before equal ones are put together.
CHUNK_BYTES = 4 << 20
CHUNK_PIECES = 1 << 18
#: Text of one shard's suffix array, and variants of one anchor that a shard takes.
SHARD_BYTES = 1 << 20
SHARD_VARIANTS = 3_000

#: Kinds of rows that step 1 deals out.
SINGLE, SEVERAL, DONE = 0, 1, 2

PIECES = "deal bigint, kind int, piece bigint, doc_key bigint, text_key bigint, start int, stop int"
FOUND = "anchor bigint, piece bigint, doc_key bigint, text_key bigint, start int, stop int, variant boolean, removed boolean"
SPANS = "doc_key bigint, text_key bigint, start int, stop int"
WINDOWS = SPANS + ", shard int, removed boolean, digest bigint, digest_low bigint"


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    arrays = [pa.array(c, kinds[k]) for (_, k), c in zip(fields, columns)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])


def _identity(seed: int) -> Column:
    # a row's doc_id (null or not) and whole text; the number of bytes is hashed as well
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.octet_length(text), text)


def _doc_key() -> Column:
    """With :func:`_text_key` 128 bits that name a row by doc_id and text; only equal rows share both."""
    return _identity(1).alias("doc_key")


def _text_key() -> Column:
    return _identity(2).alias("text_key")


def anchored_pieces(data: np.ndarray, ends: np.ndarray, match: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text number, start, stop, anchor hash) of the pieces of texts that lie one after the other up to ``ends``."""
    found = []
    width = match - anchor + 1  # anchors of a window
    low = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    for a in range(0, len(data) - match + 1, BLOCK):
        part = data[a : a + BLOCK + match - 1]
        hashes = mix64(rolling_hashes(part, [anchor])[anchor])
        least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)  # leftmost on ties
        size = 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        windows = len(part) - match + 1
        least = np.minimum(least[:windows], least[width - size : width - size + windows])
        place = (least & low).astype(np.int64)
        texts = ends[np.searchsorted(ends, a, "right") : np.searchsorted(ends, a + windows + match, "left")] - a
        cuts = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1, texts, texts - match + 1])
        first = np.unique(cuts[(cuts >= 0) & (cuts < windows)])
        last = np.r_[first[1:], windows] - 1
        text = np.searchsorted(ends, a + first, "right")
        whole = a + first + match <= ends[text]
        first, last, text = first[whole], last[whole], text[whole]
        found.append((text, a + first, a + last + match, hashes[place[first]]))
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*found))


def _joined_spans(owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the same owner that overlap or touch, put together."""
    order = np.lexsort((start, owner))
    owner, start, stop = owner[order], start[order], stop[order]
    shift = owner * (int(stop.max(initial=0)) + 2)  # keeps owners apart on one axis
    reach = np.maximum.accumulate(stop + shift)
    head = np.flatnonzero(np.r_[True, (start + shift)[1:] > reach[:-1]][: len(start)])
    if not len(head):
        return owner, start, stop
    return owner[head], start[head], reach[np.r_[head[1:], len(start)] - 1] - shift[head]


def _dealt_pieces(match: int, anchor: int):
    """Step 1: pieces dealt by anchor; equal pieces of a task are marked and sent once."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        doc, text, start, stop, anchors, pieces = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((pieces, anchors))
        doc, text, start, stop, anchors, pieces = (c[order] for c in (doc, text, start, stop, anchors, pieces))
        head = np.r_[True, (anchors[1:] != anchors[:-1]) | (pieces[1:] != pieces[:-1])]
        first = np.flatnonzero(head)
        several = np.diff(np.r_[first, len(head)]) > 1
        twice = several[np.cumsum(head) - 1]
        keys, owner = np.unique(np.stack([doc[twice], text[twice]]), axis=1, return_inverse=True)
        owner, done_start, done_stop = _joined_spans(owner.ravel(), start[twice], stop[twice])
        done_doc, done_text = keys[0][owner], keys[1][owner]
        n = len(owner)
        spread = mix64(np.ascontiguousarray(done_doc).view(np.uint64) + done_start.astype(np.uint64)).view(np.int64)
        return _batch(
            PIECES,
            [
                np.concatenate([anchors[first], spread]),
                np.concatenate([np.where(several, SEVERAL, SINGLE), np.full(n, DONE)]),
                np.concatenate([pieces[first], np.zeros(n, np.int64)]),
                np.concatenate([doc[first], done_doc]),
                np.concatenate([text[first], done_text]),
                np.concatenate([start[first], done_start]),
                np.concatenate([stop[first], done_stop]),
            ],
        )

    def pieces_of(keys: list[tuple[int, int]], texts: list[bytes]) -> tuple[np.ndarray, ...]:
        joined = b"".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        text, start, stop, anchors = anchored_pieces(np.frombuffer(joined, np.uint8), ends, match, anchor)
        view, digest = memoryview(joined), xxhash.xxh3_64_intdigest
        pieces = np.array([digest(view[a:b]) for a, b in zip(start.tolist(), stop.tolist())], np.uint64)
        begin = ends - [len(t) for t in texts]
        doc_key = np.array([k for k, _ in keys], np.int64)[text]
        text_key = np.array([k for _, k in keys], np.int64)[text]
        return doc_key, text_key, start - begin[text], stop - begin[text], anchors.view(np.int64), pieces.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, keys, texts, size = [], 0, [], [], 0
        for batch in slices(batches):
            columns = batch.column("doc_key").to_pylist(), batch.column("text_key").to_pylist(), utf8_of(batch)
            for doc_key, text_key, text in zip(*columns):
                if len(text) < match:
                    continue
                keys.append((doc_key, text_key))
                texts.append(text)
                size += len(text)
                if size >= CHUNK_BYTES:
                    held.append(pieces_of(keys, texts))
                    count, keys, texts, size = count + len(held[-1][0]), [], [], 0
                if count >= CHUNK_PIECES:
                    yield flush(held)
                    held, count = [], 0
        if texts:
            held.append(pieces_of(keys, texts))
        if held:
            yield flush(held)

    return run


def _met_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2: rows come by anchor and piece; finds pieces that occur again and anchors with different pieces.

    The last piece of a batch may go on in the next one, so its rows wait; ``earlier``
    tells whether its anchor had another piece before.
    """
    held: list[np.ndarray] | None = None
    earlier = False

    def decide(rows: list[np.ndarray], last_too: bool) -> tuple[pa.RecordBatch, list[np.ndarray], bool]:
        anchor, kind, piece = rows[:3]
        n = len(anchor)
        head = np.r_[True, (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])]
        first = np.flatnonzero(head)
        group = np.cumsum(head) - 1
        size = np.diff(np.r_[first, n])
        again = (size > 1) | (np.maximum.reduceat(kind, first) == SEVERAL)
        of = anchor[first]
        same = of[1:] == of[:-1]
        several = np.r_[same, False] | np.r_[earlier & (of[0] == rows_anchor), same]
        use = n if last_too else int(first[-1])
        row_again, row_several = again[group][:use], several[group][:use]
        variant = head[:use] & row_several
        out = (row_again & (kind[:use] != SEVERAL)) | variant  # spans of SEVERAL are among the DONE ones
        columns = [r[:use][out] for r in (anchor, piece, *rows[3:])]
        batch = _batch(FOUND, [*columns, variant[out], row_again[out]])
        return batch, [r[use:] for r in rows], bool(several[-1] and (len(of) > 1 and same[-1] or earlier and of[-1] == rows_anchor))

    rows_anchor = None
    for batch in batches:
        rows = [batch.column(i).to_numpy() for i in range(7)]
        done = rows[1] == DONE
        if done.any():
            zero = np.zeros(int(done.sum()), np.int64)
            no = np.zeros(len(zero), bool)
            yield _batch(FOUND, [zero, zero, *[r[done] for r in rows[3:]], no, ~no])
        rows = [r[~done] for r in rows]
        if held is not None:
            rows = [np.concatenate(pair) for pair in zip(held, rows)]
        if not len(rows[0]):
            continue
        out, held, earlier = decide(rows, False)
        rows_anchor = held[0][0]
        yield out
    if held is not None and len(held[0]):
        yield decide(held, True)[0]


def _sharded(match: int, digests: bool):
    """Step 3: rows of a shard come together; gives removed spans or, for anchors in several shards, windows."""

    def spans(rows: list[list], windows: np.ndarray, repeated: np.ndarray, begin: np.ndarray, piece: np.ndarray) -> pa.RecordBatch:
        at = windows[repeated]
        owner, start, stop = _joined_spans(piece[at], at, at + match)
        doc, text, offset = (np.array(rows[i], np.int64)[owner] for i in (0, 1, 2))
        return _batch(SPANS, [doc, text, offset + start - begin[owner], offset + stop - begin[owner]])

    def digest_rows(rows, joined, windows, repeated, begin, piece) -> pa.RecordBatch:
        # one row for each distinct window; where it repeats here, its spans are known already
        view, digest = memoryview(joined), xxhash.xxh3_128_digest
        made = np.frombuffer(b"".join(digest(view[a : a + match]) for a in windows.tolist()), np.int64).reshape(-1, 2)
        first = np.sort(np.unique(made, axis=0, return_index=True)[1])
        at, made, known = windows[first], made[first], repeated[first]
        owner = piece[at]
        doc, text, offset, shard, removed = (np.array(rows[i])[owner] for i in (0, 1, 2, 4, 5))
        start = offset + at - begin[owner]
        return _batch(WINDOWS, [doc, text, start, start + match, shard, known | removed, made[:, 0], made[:, 1]])

    def solve(rows: list[list]) -> Iterator[pa.RecordBatch]:
        texts = rows[3]
        joined = b"".join(texts)
        sizes = np.array([len(t) for t in texts])
        stops = np.cumsum(sizes)
        piece = np.repeat(np.arange(len(texts)), sizes)
        windows, repeated = repeated_windows(np.frombuffer(joined, np.uint8), stops[piece], match)
        if digests:
            yield digest_rows(rows, joined, windows, repeated, stops - sizes, piece)
        else:
            yield spans(rows, windows, repeated, stops - sizes, piece)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("doc_key", "text_key", "start", "text", "shard", "removed", "anchor")
        rows, size, last = [[] for _ in names], 0, None
        for batch in slices(batches):
            for row in zip(*(batch.column(n).to_pylist() for n in names)):
                key = (row[6], row[4])
                if rows[0] and key != last and (digests or size >= SHARD_BYTES):
                    yield from solve(rows)
                    rows, size = [[] for _ in names], 0
                last = key
                for column, value in zip(rows, row):
                    column.append(value)
                size += len(row[3])
        if rows[0]:
            yield from solve(rows)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 4: digests come in order; a binary search in the merged run counts each one's places."""
    held: list[np.ndarray] | None = None

    def shared(columns: list[np.ndarray]) -> pa.RecordBatch:
        doc, text, start, stop, known, digest, low = columns
        more = np.searchsorted(digest, digest, "right") - np.searchsorted(digest, digest, "left") > 1
        at = np.flatnonzero(more)  # few rows: now both halves of the digest
        order = at[np.lexsort((low[at], digest[at]))]
        same = (digest[order][1:] == digest[order][:-1]) & (low[order][1:] == low[order][:-1])
        hit = order[np.r_[same, False][: len(order)] | np.r_[False, same][: len(order)]]
        hit = hit[~known[hit]]
        return _batch(SPANS, [c[hit] for c in (doc, text, start, stop)])

    names = ("doc_key", "text_key", "start", "stop", "removed", "digest", "digest_low")
    for batch in batches:
        columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        if held is not None:
            columns = [np.concatenate(pair) for pair in zip(held, columns)]
        if not len(columns[0]):
            continue
        whole = int(np.searchsorted(columns[5], columns[5][-1]))
        yield shared([c[:whole] for c in columns])
        held = [c[whole:] for c in columns]
    if held is not None:
        yield shared(held)


def removed_spans(docs: DataFrame, match: int = MATCH, anchor: int = ANCHOR, shard_variants: int = SHARD_VARIANTS) -> DataFrame:
    """doc_key, text_key, start, stop (bytes) of removed spans of ``docs`` (doc_key, text_key, text); they may overlap."""
    dealt = docs.mapInArrow(_dealt_pieces(match, anchor), PIECES)
    dealt = dealt.repartition("deal").sortWithinPartitions("deal", "piece")
    found = materialise(dealt.mapInArrow(_met_pieces, FOUND), "byte-pieces")

    variants = found.filter("variant").drop("variant")
    crowded = variants.groupBy("anchor").agg(F.count("*").alias("variants")).filter(F.col("variants") > shard_variants)
    crowded = crowded.withColumnRenamed("anchor", "crowded_anchor")
    shards = F.ceil(F.col("variants") / F.lit(shard_variants * 0.75))
    shard = F.coalesce(F.pmod("piece", shards), F.lit(-1)).cast("int")
    asked = variants.join(crowded, variants["anchor"] == crowded["crowded_anchor"], "left").withColumn("shard", shard)
    asked = asked.groupBy("doc_key", "text_key").agg(
        F.collect_list(F.struct("anchor", "start", "stop", "shard", "removed")).alias("asked")
    )

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            rows = []
            columns = [batch.column(n).to_pylist() for n in ("doc_key", "text_key", "asked")]
            for doc_key, text_key, asked, text in zip(*columns, utf8_of(batch)):
                for a in asked:
                    piece = text[a["start"] : a["stop"]]
                    rows.append((a["anchor"], a["shard"], doc_key, text_key, a["start"], a["removed"], piece))
            yield _batch(cut_schema, list(zip(*rows)) if rows else [[]] * 7)

    cut_schema = "anchor bigint, shard int, doc_key bigint, text_key bigint, start int, removed boolean, text binary"
    texts = docs.join(asked, ["doc_key", "text_key"]).select("doc_key", "text_key", "text", "asked")
    pieces = materialise(texts.mapInArrow(cut_out, cut_schema), "byte-variants")

    names = ["doc_key", "text_key", "start", "text", "shard", "removed", "anchor"]
    own = pieces.repartition("anchor", "shard").sortWithinPartitions("anchor", "shard").select(names)
    inside = own.mapInArrow(_sharded(match, False), SPANS)
    crowd = pieces.filter("shard >= 0").repartition("anchor", "shard").sortWithinPartitions("anchor", "shard").select(names)
    windows = crowd.mapInArrow(_sharded(match, True), WINDOWS)
    across = windows.repartition("digest").sortWithinPartitions("digest").mapInArrow(_merged, SPANS)
    done = found.filter("removed").select("doc_key", "text_key", "start", "stop")
    return done.unionByName(inside).unionByName(across)


def _cut(text: bytes, spans: list[dict] | None, whole_characters: bool) -> tuple[bytes, list[tuple[int, int]]]:
    """(remaining bytes, maximal removed runs)."""
    runs: list[list[int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans or ()):
        if whole_characters:  # bytes 10xxxxxx go on with a UTF-8 character
            while start > 0 and text[start] & 0xC0 == 0x80:
                start -= 1
            while stop < len(text) and text[stop] & 0xC0 == 0x80:
                stop += 1
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], stop)
        else:
            runs.append([start, stop])
    kept, at = [], 0
    for start, stop in runs:
        kept.append(text[at:start])
        at = stop
    return b"".join([*kept, text[at:]]), [tuple(r) for r in runs]


def remove_repeats(
    docs: DataFrame,
    match: int = MATCH,
    anchor: int = ANCHOR,
    shard_variants: int = SHARD_VARIANTS,
    whole_characters: bool = False,
) -> DataFrame:
    """``docs`` with kept (the remaining bytes) for text, n_bytes (before) and removed (maximal runs of start and stop).

    Every occurrence of a repeated string goes, in the same document as well; strings are
    judged on the input and never cross documents.  A null text is empty; texts under
    ``match`` bytes stay whole.  Repeated rows repeat each other's text.  A null doc_id is
    kept.  One row for each input row, with all its other columns; those named like the
    added ones are replaced.  ``whole_characters`` widens removed runs to whole characters.

    Texts are shuffled twice (variants are cut out; spans are cut out).  A task holds one
    slice of documents, one chunk of text or one shard at a time.
    """
    added = ["kept", "n_bytes", "removed"]
    names = [c for c in docs.columns if c not in (*added, "text")]
    texts = docs.select(_doc_key(), _text_key(), "text")
    spans = removed_spans(texts, match, anchor, shard_variants)
    spans = spans.groupBy("doc_key", "text_key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    keyed = docs.select(_doc_key(), _text_key(), F.struct(*names).alias("row"), "text")
    joined = keyed.join(spans, ["doc_key", "text_key"], "left").select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            texts = utf8_of(batch)
            cuts = [_cut(t, s, whole_characters) for t, s in zip(texts, batch.column("spans").to_pylist())]
            runs = [[{"start": a, "stop": b} for a, b in r] for _, r in cuts]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            columns = [pa.array([k for k, _ in cuts], pa.binary()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *columns, pa.array(runs, kind)], names=["row", *added])

    row = joined.schema["row"].dataType.simpleString()
    out = joined.mapInArrow(run, f"row {row}, kept binary, n_bytes bigint, removed array<struct<start: bigint, stop: bigint>>")
    return out.select("row.*", *added)


def digest_kept(cleaned: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of the result of :func:`remove_repeats`."""
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    return cleaned.select(
        "doc_id",
        "n_bytes",
        lost.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def drop_repeats(docs: DataFrame, match: int = MATCH) -> DataFrame:
    """``docs`` with repeated strings cut from the texts (to whole characters), with the same columns.

    A document of which nothing is left goes; one that was empty stays.  A column n_chars
    follows the text.
    """
    cleaned = remove_repeats(docs, match, whole_characters=True)
    cleaned = cleaned.filter((F.length("kept") > 0) | (F.size("removed") == 0))
    cleaned = cleaned.withColumn("text", F.col("kept").cast("string"))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)
