"""Small tables with every awkward case, shared by the operator tests."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])

LONG = "Lorem ipsum dolor sit amet. " * 4000

TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog"), (2, "the quick  brown fox\njumps over the lazy dog"),
    (3, None), (4, ""), (5, " \t\n"), (6, LONG), (7, LONG), (8, LONG + "x"), (9, "Éa ñu 東京   🙂 tail"), (10, "one"),
    (11, "two words"), (None, "the quick brown fox jumps over the lazy dog"), (None, None), (12, "one"), (12, "one"),
    (13, "ONE"), (14, "a" * 5000), (15, "trash idiot scum " * 3), (16, "x y z " * 700),
]


def documents(spark):
    rows = [(i, t, None if n % 5 == 0 else "en", None if n % 7 == 0 else f"src{n % 3}", len(t) if t else None)
            for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(spark):
    """The same rows with extra columns named like those the operators make or use inside."""
    from pyspark.sql import functions as F
    names = ["id", "kept", "keep_id", "shard", "slot", "rank", "bucket", "fp", "score", "piece", "chunk", "_keep", "_raw", "mix", "row",
             "group_rows", "component_id", "n", "held_out", "severity", "x", "y", "key", "length", "hash", "block", "template"]
    return documents(spark).withColumns({n: F.lit("clash") for n in names})


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
