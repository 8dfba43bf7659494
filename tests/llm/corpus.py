"""Small tables with the awkward cases every operator has to stand."""

import random

from pyspark.sql import Row

WORDS = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "r", "st", "lt")]


def prose(rng, n):
    words = rng.choices(WORDS, k=n)
    out = []
    for i, w in enumerate(words):
        out.append(w + (". " if i % 9 == 8 else " "))
    return "".join(out).strip()


def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns that clash with those the operators add."""
    rng = random.Random(5)
    long_text = prose(rng, 6000)
    rows = [
        (1, prose(rng, 80), "a"),
        (2, None, "a"),
        (3, "", "b"),
        (4, "   \n\t", None),
        (5, long_text, "b"),
        (6, long_text, "a"),
        (6, long_text, "a"),
        (None, "one two", "b"),
        (None, None, None),
        (7, "x" * 5000, "c"),
        (8, prose(rng, 1), "c"),
        (8, prose(rng, 50), "c"),
    ]
    return spark.createDataFrame(
        [Row(doc_id=i, text=t, source=s, n_tokens=9, hit="h", score=0.5, kept=1, key="k", id=3, tag=1, copies=2, epoch=4)
         for i, t, s in rows],
        "doc_id long, text string, source string, n_tokens int, hit string, score double, kept int, key string, id int, tag int,"
        " copies int, epoch int",
    )


def as_docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, source) for i, t in enumerate(texts)], "doc_id long, text string, source string")
