import re

from pocketlens.llm import licenses

from .cases import awkward_docs, empty_docs, ordered

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = []
    for phrase, label in licenses.BASE_PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    labels = ",".join(sorted({label for _, label in places}))
    return len(words), len(places), min(starts, default=None), max(starts, default=None), labels


def scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}


def test_base_places_against_brute_force(spark):
    docs, rows = awkward_docs(spark)
    got = [tuple(r)[:6] for r in licenses.scan_licenses(docs).collect()]
    assert ordered(got) == ordered((i, *base(t)) for i, t, *_ in rows)
    assert licenses.scan_licenses(empty_docs(spark)).count() == 0


def test_labels_of_the_method(spark):
    texts = [
        "GNU General, Public License! and CC BY-NC 4.0 cc by",
        "gnu general and public license",  # a word put in: neighbouring diagonals
        "gnu general nothing of the kind follows here public license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this",
        "redistribution and use in source and binary forms",
        "MIT License mitlicense mit licenses",
        "apache license " * 500,
        "LİCENSE mit lİcense K mit license",
    ]
    got = scan(spark, texts)
    assert {i: r.labels for i, r in got.items()} == {
        0: "cc-by,cc-by-nc,gpl", 1: "gpl", 2: "", 3: "mit", 4: "", 5: "", 6: "apache", 7: "mit",
    }
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text)
        assert (r.score == 1) >= (r.n_base > 0) and 0 <= r.score <= 1
    assert got[6].n_base == 500 and 0 < got[4].score < 0.75


def spans(text):
    """(labels, score) by laying every template at every word, with words put in up to the allowed shift."""
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    pairs = list(zip(words, words[1:]))
    labels, best = set(), 0.0
    for phrase, label in [*licenses.BASE_PHRASES, *licenses.NOTICES]:
        p = phrase.split()
        for start in range(-len(p), len(words)):
            covered = set()
            for shift in range(licenses.MAX_SHIFT + 1):
                for at in range(len(p) - 1):
                    if 0 <= start + shift + at < len(pairs) and pairs[start + shift + at] == (p[at], p[at + 1]):
                        covered |= {at, at + 1}
            # a span begins with a hit of its first alignment
            if any(0 <= start + at < len(pairs) and pairs[start + at] == (p[at], p[at + 1]) for at in range(len(p) - 1)):
                best = max(best, len(covered) / len(p))
                if len(covered) / len(p) >= licenses.MIN_COVER:
                    labels.add(label)
    return ",".join(sorted(labels | set(filter(None, base(text)[4].split(","))))), best


def test_notices_stay_among_repeated_partial_hits(spark):
    texts, expected = [], []
    for phrase, label in [*licenses.BASE_PHRASES, *licenses.NOTICES]:
        p = phrase.split()
        for part in {" ".join(p[1:]), " ".join(p[:-1]), " ".join(p[-2:]), " ".join(p[: max(2, len(p) // 2)])}:
            for text in (f"{phrase} {part} {part} {part}", f"{part} {part} {phrase}", f"{part} x {part} x {phrase} y {part} {part}"):
                texts.append(text)
                expected.append(label)
    texts += ["mozilla public license public license public license", "mozilla public public license public license", "gnu gnu general gnu general public"]
    expected += ["mpl", "mpl", None]
    got = scan(spark, texts)
    for i, (text, label) in enumerate(zip(texts, expected)):
        assert label is None or label in got[i].labels.split(","), text
        assert (got[i].labels, round(got[i].score, 9)) == (spans(text)[0], round(spans(text)[1], 9)), text
