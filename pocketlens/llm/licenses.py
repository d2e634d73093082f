"""License scan by diagonal voting, in DataFrame functions alone.

All rolling word k-grams of every text are joined by hash with the positions of the same
k-gram in license templates; each match votes for its diagonal (place in the text minus
place in the template).  Votes are summed by diagonal; each diagonal is merged with those that
lie up to MAX_SHIFT further on (words put in shift them), and a span is verified by
the share of the template's words that it covers.  A span starts with one alignment and
ends MAX_SHIFT words behind the template's length, so partial hits elsewhere neither lengthen nor hide it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Words of a k-gram: the shortest phrase has two.
GRAM = 2
#: Diagonals of a span differ by at most so much, so it is longer than its template by no more.
MAX_SHIFT = 2
#: Least share of a template's words that a verified span covers.
MIN_COVER = 0.75
#: Template k-grams up to this number are broadcast (about 100 bytes each); more are joined by a shuffle.
MAX_BROADCAST_GRAMS = 50_000

# The base phrases and their labels.
BASE_PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: Longer wordings that the method looks for besides the base phrases.
NOTICES = [
    ("licensed under the gnu general public license version", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may obtain a copy of the license at http www apache org licenses license 2 0", "apache"),
    ("cc by nc", "cc-by-nc"),
    ("creative commons attribution", "cc-by"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("mozilla public license", "mpl"),
]


def template_grams(spark: SparkSession, base: Sequence[tuple[str, str]], notices: Sequence[tuple[str, str]]) -> DataFrame:
    """One row for each k-gram of each template: hash, template, its length, place, label, whether it is a base phrase."""
    rows = []
    for t, (phrase, label) in enumerate([*base, *notices]):
        words = phrase.split(" ")
        if len(words) < GRAM:
            raise ValueError(f"a template needs {GRAM} words: {phrase!r}")
        for at in range(len(words) - GRAM + 1):
            rows.append((" ".join(words[at : at + GRAM]), t, len(words), at, label, t < len(base)))
    grams = spark.createDataFrame(rows, "t_gram string, t int, t_len int, t_at int, label string, base boolean")
    grams = grams.withColumn("hash", F.xxhash64("t_gram"))
    return F.broadcast(grams) if len(rows) <= MAX_BROADCAST_GRAMS else grams


def scan_licenses(
    docs: DataFrame, base: Sequence[tuple[str, str]] = BASE_PHRASES, notices: Sequence[tuple[str, str]] = NOTICES
) -> DataFrame:
    """License phrases and notices in every whole text.

    Returns doc_id; n_words; n_base, the places where a base phrase's words stand one
    after the other; first_word and last_word, the smallest and largest start of such a
    place (null without one); base_labels and labels (base ones and those of verified
    spans), distinct, sorted and joined by commas, empty without any; and score (0 to 1),
    the largest share of a template's words that a span covers.  One row for each input
    row, repeated rows included.  A null or empty text has no words, no labels and score
    0; a null doc_id is kept.  Only doc_id and text are read.

    The text itself is not shuffled: only its matches and one row for each document are.
    """
    text = F.coalesce("text", F.lit(""))
    key = ["doc_id", "text_hash", "n_chars"]
    words = docs.select(
        "doc_id",
        F.xxhash64(text).alias("text_hash"),
        F.length(text).alias("n_chars"),
        F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)).alias("words"),
    )
    n_words = F.size("words")
    follow = F.slice("words", 2, F.greatest(n_words, F.lit(1)))
    grams = F.zip_with("words", follow, lambda a, b: F.concat(a, F.lit(" "), b))
    # element 0 stands for the document, so documents without any match stay
    rows = words.select(*key, n_words.alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), grams)).alias("place", "gram"))
    rows = rows.withColumn("hash", F.xxhash64("gram"))
    joined = rows.join(template_grams(docs.sparkSession, base, notices), "hash", "left")
    joined = joined.filter((F.col("place") == 0) | (F.col("gram") == F.col("t_gram")))
    votes = joined.select(
        *key, "n_words", "t", "t_len", "t_at", "label", "base",
        (F.col("place") == 0).cast("long").alias("is_document"),
        (F.col("place") - 1 - F.col("t_at")).alias("diagonal"),
    )

    diagonals = votes.groupBy(*key, "t", "t_len", "label", "base", "diagonal").agg(
        F.sum("is_document").alias("documents"),
        F.max("n_words").alias("n_words"),
        F.collect_set("t_at").alias("places"),
    )
    ahead = Window.partitionBy(*key, "t").orderBy("diagonal").rangeBetween(0, MAX_SHIFT)
    near = F.flatten(F.collect_list("places").over(ahead))
    covered = F.flatten(F.transform("near", lambda p: F.sequence(p, p + (GRAM - 1))))
    full = F.col("base") & (F.size("places") == F.col("t_len") - (GRAM - 1))
    spans = diagonals.withColumn("near", near).select(
        *key, "label", "documents", "n_words", "diagonal",
        full.alias("full"),
        F.when(F.col("t").isNotNull(), F.size(F.array_distinct(covered)) / F.col("t_len")).alias("cover"),
    )
    verified = F.col("cover") >= MIN_COVER

    def joined_labels(which):
        return F.array_join(F.sort_array(F.collect_set(F.when(which, F.col("label")))), ",")

    out = spans.groupBy(*key).agg(
        F.sum("documents").alias("documents"),
        F.max("n_words").cast("long").alias("n_words"),
        F.count_if("full").alias("n_base"),
        F.min(F.when(F.col("full"), F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("full"), F.col("diagonal"))).cast("long").alias("last_word"),
        joined_labels(F.col("full")).alias("base_labels"),
        joined_labels(F.col("full") | verified).alias("labels"),
        F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
    )
    result = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("documents"))).alias("copy")
    return out.select(*result, copy).select(*result)


def oracle_sql() -> str:
    """The same scan over ``documents`` in DuckDB SQL, for documents of unique doc_id."""
    templates = ", ".join(
        f"({t}, '{p}', '{label}', {str(t < len(BASE_PHRASES)).lower()})" for t, (p, label) in enumerate([*BASE_PHRASES, *NOTICES])
    )
    return rf"""
WITH templates(t, phrase, label, base) AS (VALUES {templates}),
t_words AS (SELECT t, label, base, string_split(phrase, ' ') AS w FROM templates),
t_grams AS (
  SELECT t, label, base, len(w) AS t_len, i - 1 AS t_at, w[i] || ' ' || w[i + 1] AS gram
  FROM (SELECT *, unnest(range(1, len(w))) AS i FROM t_words)
),
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
hits AS (  -- a k-gram of the text in its place of a template laid at word ``start`` of the text
  SELECT doc_id, t, t_len, label, base, t_at, i - 1 - t_at AS start
  FROM (SELECT doc_id, i, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT *, unnest(range(1, len(w))) AS i FROM words)) JOIN t_grams USING (gram)
),
laid AS (SELECT DISTINCT doc_id, t, t_len, label, start FROM hits),
covers AS (
  SELECT doc_id, label, laid.start, count(DISTINCT h.t_at + k) / t_len AS cover
  FROM laid JOIN hits h USING (doc_id, t, t_len, label), (VALUES (0), (1)) AS n(k)
  WHERE h.start BETWEEN laid.start AND laid.start + {MAX_SHIFT} GROUP BY doc_id, t, t_len, label, laid.start
),
bases AS (
  SELECT doc_id, label, start FROM hits WHERE base GROUP BY doc_id, t, t_len, label, start HAVING count(*) = t_len - 1
),
found AS (
  SELECT doc_id, max(cover) AS score,
    (SELECT count(*) FROM bases b WHERE b.doc_id = c.doc_id) AS n_base,
    (SELECT min(start) FROM bases b WHERE b.doc_id = c.doc_id) AS first_word,
    (SELECT max(start) FROM bases b WHERE b.doc_id = c.doc_id) AS last_word,
    (SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM bases b WHERE b.doc_id = c.doc_id) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (cover >= {MIN_COVER}) AS labels
  FROM covers c GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM words LEFT JOIN found USING (doc_id)
"""
