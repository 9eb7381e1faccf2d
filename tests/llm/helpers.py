"""Small tables with the awkward cases that every operator has to take."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, position int, h string, rank int, fp string"

PROSE = "The quick brown fox jumps over the lazy dog while seven small boats drift slowly down the wide grey river toward the sea"
SECOND = "Every morning the baker opens a blue door and puts warm loaves of dark bread on the long wooden shelf by the window"


def awkward() -> list[tuple]:
    """Null, empty, blank, long, tied and repeated rows, null ids, and columns named like the operators' own."""
    long_text = "\n".join(f"line number {i} of a rather long text about item {i * 7 % 1000}" for i in range(3000))
    texts = [
        (1, PROSE), (2, PROSE), (3, PROSE + "\n" + SECOND), (4, None), (5, ""), (6, " \t\n "), (7, "word"), (8, long_text), (9, long_text),
        (10, SECOND), (10, SECOND), (11, SECOND + "."), (None, PROSE), (None, "an id is missing here"), (12, "x " * 400), (13, "ÄÖ é 日本 ▁"),
        (14, "a\rb\x0bc\x0cd"), (10, "another text under a repeated id"),
    ]
    sources = ["s1", None, "s2"]
    return [(i, t, "en" if n % 2 else None, sources[n % 3], len(t or ""), "kept", n, "h", n, "fp") for n, (i, t) in enumerate(texts)]


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def texts(spark, values):
    return spark.createDataFrame(list(values), "doc_id long, text string")
