"""Documents with nulls, empty and long texts, ties, repeated rows and further columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, target string, kept string, score string, lines string, row string, quality string, doc long, version string"


def words(n, k=0):
    return " ".join(f"word{(i * 7 + k) % 997}x{i}" for i in range(n))


ROWS = [
    (1, words(80), "en", "a", 1),
    (2, words(80), "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, "one", "fr", None, 3),
    (6, "\n\n", "xx", "b", 2),
    (None, words(30, 5), "de", "a", 7),
    (7, words(80) + " more words at the end", "en", "c", 9),
    (7, words(80) + " more words at the end", "en", "c", 9),
    (8, words(20000, 3) + "\n" + "z" * 50000, "es", "c", 9),
    (9, "Tie Tie Tie\nTie Tie Tie\n" + words(60, 9), "en", "b", 9),
    (10, "tie tie tie \n" + words(60, 11), "en", "b", 9),
    # Equal rows that lose a line, rows that differ in one further column only, and one id with two texts.
    (11, "Tie tie TIE\nand a line of its own\n" + words(60, 13), "en", "b", 9),
    (11, "Tie tie TIE\nand a line of its own\n" + words(60, 13), "en", "b", 9),
    (12, words(70, 17), "en", "c", 9),
    (12, words(70, 17), "fr", "c", 9),
    (13, words(75, 19), "en", "a", 9),
    (13, words(75, 23), "en", "a", 9),
]


def documents(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 7, "t", "k", "s", "l", "r", "q", 5, "v") for r in rows], SCHEMA)


def empty(spark):
    return documents(spark, [])
