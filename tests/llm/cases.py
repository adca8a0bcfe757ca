"""Rows that every operator on documents has to take: nulls, empty and long texts, repeated rows,
repeated ids, and further columns whose names the operators use themselves."""

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it all day long."),
    (2, "The quick brown fox jumps over the lazy dog and runs away from it all day long."),
    (3, None), (4, ""), (5, " \t\n\x0b\x0c\r "), (6, "one"), (7, "One two three FOUR"), (7, "One two three FOUR"),
    (8, LONG), (9, LONG + " end"), (None, "no id at all here today"), (None, None), (10, "\u00c9t\u00e9 \u00fcber stra\u00dfe \U0001F600\U0001F600 \u4f60\u597d 'll x"),
    (11, "a" * 5000), (12, "!!! ??? ###"), (10, "another text under an id that is taken"),
]
_CLASHES = "words string, node long, row string, text_hash long, chunk long, spans string, host string, n int, a int, b int"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + _CLASHES


def documents(spark, rows=ROWS):
    return spark.createDataFrame(
        [(i, t, "en", "s", None if t is None else len(t), "x", 1, "x", 1, 1, "x", "x", 1, 1, 1) for i, t in rows], SCHEMA)


def order(rows):
    return sorted(rows, key=repr)
