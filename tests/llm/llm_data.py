"""Texts that the tests of this folder share."""

WORDS = "the of and ore with from stone river light under green north early paper glass sound".split()


def sentence(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 12) % 97))
    return " ".join(out)


LONG = sentence(1, 3000)

#: Nulls, empty and very long texts, repeated rows, copies, blanks, other scripts.
EDGE = [
    (1, None), (2, ""), (3, "   \t\n"), (4, "One"), (5, "one"), (6, "Ünïcödé naïve 日本語 \U0001f600"),
    (7, LONG), (8, LONG), (9, LONG + " tail"), (9, LONG + " tail"), (None, "a null key"),
    (10, sentence(2, 60)), (11, sentence(2, 60) + " more"), (12, sentence(3, 12)), (13, "!!! ... 123"),
]


def documents(spark, rows):
    """Rows of (doc_id, text), with columns whose names the operators use themselves."""
    wide = [(i, t, "en", "s", 0, "x", 1.5, "k", 7) for i, t in rows]
    return spark.createDataFrame(
        wide, "doc_id long, text string, lang string, source string, n_chars long, key string, score double, places string, node long"
    )


