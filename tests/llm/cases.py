"""Small tables with awkward rows, shared by the operators' tests."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use for their own columns.
CLASHING = ["score", "size", "key", "words", "kept", "row", "slot", "range", "spans", "taken", "predicted", "fp", "host"]


def awkward_docs(spark, extra=()):
    """Nulls in any column, empty and long texts, equal texts, repeated rows, clashing extra columns."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "gämma", "delta", "Ünit", "mit", "license", "the", "of", "zeta"]
    long_text = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(4000))
    rows = [
        (1, "MIT License. the same text here", "en", "a", 5),
        (2, "MIT License. the same text here", None, "b", None),
        (2, "MIT License. the same text here", None, "b", None),
        (3, None, "en", None, 0),
        (4, "", "en", "a", 0),
        (None, "a row without an id", "en", "a", 3),
        (None, None, None, None, None),
        (5, long_text, "en", "é", 9),
        (6, long_text + " one more", "en", "é", 9),
        (7, "x" * 3000, "en", "b", 3000),
        (8, "one", "en", "b", 3),
        (9, " \t\n  ", "en", "c", 3),
        (20, "日本語 😀 text <|endoftext|> end", "ja", "c", 3),
        *extra,
    ]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for name in CLASHING:
        df = df.selectExpr("*", f"'clash' AS {name}")
    return df, rows


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))
