"""Small tables with the awkward cases every operator has to bear."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "key string, id string, size string, c0 string, spans string, score string, component string, rep string"


def words(n, seed=0):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(2, 8))) for _ in range(n))


def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and ids, clashing extra columns."""
    base = words(60, 1)
    rows = [
        (1, base, "en", "a", 10),
        (2, base, "en", "a", 10),
        (2, base, "en", "a", 10),
        (3, None, "fr", None, None),
        (4, "", None, "b", 0),
        (None, words(40, 2), "fr", "b", 5),
        (None, None, None, None, None),
        (5, words(30_000, 3), "de", "c", 7),
        (6, base + " tail", "de", None, 7),
        (7, "   \n\t ", "en", "b", 3),
        (8, "12 34 !!", "en", "b", 3),
        (9, "é▁ 日本 \U0001f600 password=abcdef12", "es", "a", 3),
        (9, "other text with the same id", "es", "a", 3),
    ]
    extra = tuple(f"x{k}" for k in range(8))
    return spark.createDataFrame([r + extra for r in rows], f"{DOCS}, {CLASHING}")


def empty(spark):
    return spark.createDataFrame([], f"{DOCS}, {CLASHING}")


def docs(spark, texts, source="a"):
    return spark.createDataFrame([(i, t, "en", source, 0) for i, t in enumerate(texts)], DOCS)
