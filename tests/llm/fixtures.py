"""Small tables with every awkward case, and helpers for the text operator tests."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])

LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(9000))

ROWS = [
    (1, "The cat sat on the mat and the dog lay by the old door of the house", "en", "a", 5),
    (2, "the CAT sat on the mat and the dog lay by the old door of the house", "en", "a", 5),
    (3, "The cat sat on the mat and the dog lay by the old door of the barn", "en", "b", 5),
    (4, "", "en", "b", 0),
    (5, None, None, None, None),
    (6, LONG, "en", "a", 1),
    (6, LONG, "en", "a", 1),
    (7, LONG + " end", None, "c", 1),
    (8, "a" * 700, "en", None, 1),
    (9, "ÀÉ été naïve — 漢字 \U0001F600 fin", "fr", "c", 1),
    (10, " \t\n  ", "en", "c", 4),
    (None, "no id at all", "en", "c", 4),
    (None, None, None, None, None),
]

# columns named like those the operators make
EXTRA = ("row", "digest", "k", "tk", "fp", "rn", "kept", "copies", "ordinal", "n", "size", "score", "no")


def docs(spark, rows=ROWS, extra=False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(EXTRA)]) if extra else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(rows):
    return sorted((tuple(r) for r in rows), key=repr)
