"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, extra columns."""

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, words=400):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmno") for _ in range(r.randint(2, 8))) for _ in range(words)]
    return " ".join(r.choice(vocabulary) for _ in range(n))


def awkward():
    """(doc_id, text, lang, source, n_chars)"""
    long = prose(3, 30_000)
    texts = [
        (1, prose(1, 120)),
        (2, prose(1, 120)),  # a copy
        (3, prose(1, 120).replace(" ", "\n", 5)),  # the same words
        (4, None),
        (5, ""),
        (6, " \t\n "),
        (7, "one"),
        (8, "one two three"),
        (9, long),
        (9, long),  # a repeated row
        (10, "x" * 5_000),
        (11, ("again and again " * 60).strip()),
        (12, prose(2, 80) + "\n" + prose(4, 90)),
        (13, prose(5, 70) + " " + prose(4, 90)),
        (None, prose(1, 120)),
        (14, "Größe ist naïve – 漢字 😀 \x0b\x0c end"),
    ]
    return [(i, t, "en", f"s{(i or 0) % 3}" if i != 8 else None, len(t or "")) for i, t in texts]


def documents(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, DOCUMENTS)
