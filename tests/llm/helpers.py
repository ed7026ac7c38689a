"""Small tables for the operators' tests, and the awkward rows that every operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=False):
    """documents from (doc_id, text[, source]); with ``extra`` also columns named like those inside operators."""
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else None, None if r[1] is None else len(r[1])) for r in rows]
    schema = DOCS
    if extra:
        full = [(*r, 1, "x", 2.0, True, "y") for r in full]
        schema += ", n_words long, pair string, node double, kept boolean, hits string"
    return spark.createDataFrame(full, schema)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}x" for _ in range(n))


def awkward():
    """Nulls in every column, empty and blank texts, a very long text and word, ties, repeated rows."""
    long = prose(9, 60_000, 5000)
    return [(1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (4, "one"), (None, "a text without an id"), (None, None), (5, long), (5, long),
            (6, "z" * 300_000), (7, "ties and ties"), (7, "ties and ties"), (8, "ünïcode 中文 \U0001f600 words here now"), (9, "line\n\nline\n line ")]
