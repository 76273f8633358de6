"""Small hand-made documents with every awkward case, and plain helpers."""

import hashlib

DOCS_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LONG = "lorem ipsum dolor " * 20_000

#: Null and empty texts, blanks, a null id, null columns, a repeated row, equal texts, a long text.
AWKWARD = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \t\n ", None, "b", 4),
    (4, "The quick brown fox\nshared line", "en", None, 30),
    (5, "The quick brown fox\nshared line", "en", "b", 30),
    (5, "The quick brown fox\nshared line", "en", "b", 30),
    (None, "without an id\nshared line", "en", "b", None),
    (6, LONG, "la", "b", len(LONG)),
    (7, "ärger über ß  　 x\r\nSHARED LINE ", "de", "a", 30),
    (8, "12345 ...", "en", "c", 9),
]


def awkward(spark, extra=()):
    """The awkward documents; ``extra`` names columns whose names clash with results."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(AWKWARD, DOCS_SCHEMA)
    for name in extra:
        df = df.withColumn(name, F.lit("x"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS_SCHEMA)


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in enumerate(texts)], DOCS_SCHEMA)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()
