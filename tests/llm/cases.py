"""Hand-made documents: nulls, empty and long texts, ties, repeats, and columns whose names clash."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("id", T.StringType()), T.StructField("key", T.LongType())])


def documents(spark, texts, ids=None):
    ids = ids or range(len(texts))
    rows = [(i, t, "en", "s", None if t is None else len(t), "x", 1) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", "   \n\t ", "a", "A", "one two", "One  Two", "é ü – ß 字 𝒳", "word " * 30000, "x" * 50000, "the cat sat on the mat", "the cat sat on the mat", "THE CAT sat on\nthe mat", "tab\tand\x0bvt\x1cfs nb  double \n end "]
