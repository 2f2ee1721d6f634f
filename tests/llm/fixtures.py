"""Small document tables with the cases that every operator must stand."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside.
CLASHING = ("_row", "ids", "words", "size", "chunk", "rep", "n", "digest", "kept", "spans", "taken", "n_words", "shared")


def hard_rows():
    """Null and empty texts and ids, blanks only, a very long text, ties and repeated rows."""
    long = " ".join(f"word{i % 997} and" for i in range(30_000))
    return [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n", "en", "a", 3),
        (4, long, "en", "a", len(long)),
        (5, "the cat sat on the mat. " * 12, "en", "b", 0),
        (6, "the cat sat on the mat. " * 12, "en", "b", 0),
        (6, "the cat sat on the mat. " * 12, "en", "b", 0),
        (7, "x" * 20_000, None, "b", 0),
        (None, "no id here but words", "fr", None, 0),
        (8, "Übermut tut selten gut, sagt der größte Käse 中文 😀 <|endoftext|> it's", "de", "é", 0),
        (9, "!!! 123 ???", "en", "b", 0),
    ]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for name in CLASHING:
            df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return frame(spark, [])


def prose(n, seed=1, vocabulary=400, length=(60, 200)):
    """Invented documents; (doc_id, text, lang, source, n_chars)."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(vocabulary)]
    out = []
    for i in range(n):
        text = " ".join(r.choice(words) for _ in range(r.randint(*length)))
        out.append((i, text, "en", f"s{i % 3}", len(text)))
    return out
