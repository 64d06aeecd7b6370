"""Small tables with the cases that every operator must take, and texts to plant."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cls long, token string, size long, shard int, domain string, w string, h string, score double"


def prose(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(400)]
    return " ".join(r.choice(words) for _ in range(n))


def docs(spark, rows):
    """Rows (doc_id, text[, lang, source]) with columns of clashing names."""
    full = [(i, t, *(more or ("en", "src0")), None if t is None else len(t), 7, "x", 1, 2, "y", "z", "q", 0.5) for i, t, *more in rows]
    return spark.createDataFrame(full, SCHEMA)


#: Null id, null text, empty and blank texts, ties, repeated rows, a very long text, odd characters.
ODD = [
    (None, prose(1, 50)), (1, None), (2, ""), (3, " \n\t\r\x0b\x0c "), (4, "one two"), (5, "One TWO"), (6, prose(2, 60)), (6, prose(2, 60)), (6, prose(3, 60)),
    (7, prose(4, 30_000)), (8, "x" * 200_000), (9, "é́ \U0001f600  a b \x1c \x85 \x00 " * 20), (10, "a\n\nb\n" * 50), (11, prose(2, 60) + " more"), (12, None),
]
