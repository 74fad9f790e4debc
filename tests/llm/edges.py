"""Tables with the awkward cases that every operator must take."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
#: Names that operators use inside, as columns of the input.
CLASHING = ["id", "chunk", "bucket", "n", "score", "kept", "keys", "bits", "t", "row", "found", "u", "v", "token", "root", "spans", "label", "x", "_hit_so_far", "__key", "_score", "contaminated", "predicted", "m", "i"]
LONG = " ".join(f"word{k % 997} of{k % 31}" for k in range(40_000))
RAW = [
    (1, None, None, None, None), (2, "", None, "s", 0), (None, "a text without an id of some words", "en", None, 5), (None, None, None, None, None),
    (3, "   \n\t ", "en", "s", 3), (4, "one", "en", "s", 3), (5, "Same text here for a copy", "en", "s", 3), (6, "same TEXT here for a copy", "en", "s", 3),
    (6, "same TEXT here for a copy", "en", "s", 3), (6, "another text of the same id", "en", "s", 3), (7, "é ü　漢字 \x00 🙂 ÀÉ", None, "s", 3), (8, LONG, "en", "s", len(LONG)),
    (-5, LONG + " end", "en", "s", 1),
]


def edge_docs(spark, clash: bool = True):
    df = spark.createDataFrame(RAW, SCHEMA)
    for c in CLASHING if clash else ():
        df = df.withColumn(c, df["lang"])
    return df


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def docs(spark, items):
    return spark.createDataFrame(list(items), "doc_id long, text string")
