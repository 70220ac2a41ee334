from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Further columns whose names clash with those that operators use inside.
CLASHING = "node long, size long, part int, key long, block int, host string, rank double, label int, component_id long, fingerprint string, shard int, copies long, row_key long, target double, ident long, all_shards string, same int, nth int, mine int, row int, a.b int, c`d int"

PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potions behind an old wooden door near the river bank and nobody sees them go home again before the morning light".split()


def prose(n, seed=0):
    return " ".join(PROSE[(i * (seed * 2 + 3) + i * i * (seed + 1) + seed) % len(PROSE)] + str((i * 7 + seed * 13) % 97) for i in range(n))


def hard_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows."""
    long = prose(30_000, 5)
    return [
        (1, prose(80, 1), "en", "a", 10), (2, prose(80, 1), "en", "a", 10), (3, prose(80, 1) + " x", "en", "b", None), (3, prose(80, 1) + " x", "en", "b", None),
        (4, "", "en", "b", 0), (5, None, None, None, None), (6, " \n\t ", "en", None, 4), (7, long, "en", "c", len(long)), (8, long, "en", "c", len(long)),
        (None, prose(80, 2), "en", "a", 1), (None, None, None, None, None), (9, "x", "en", "d", 1), (10, "Ünïcödé ▁▁ \u0000 😀 </s>", "de", "d", 20), (11, "x" * 50_000, "en", "d", 50_000),
    ]


def docs(spark, rows=None, clash=False):
    df = spark.createDataFrame(hard_rows() if rows is None else rows, DOCS)
    if clash:
        for field in CLASHING.split(", "):
            name, kind = field.split(" ")
            df = df.withColumn(name, __import__("pyspark.sql.functions", fromlist=["lit"]).lit(None).cast(kind))
    return df
