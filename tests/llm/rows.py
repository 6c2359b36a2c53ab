"""Small documents with every odd case, for the tests of this folder."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
#: Column names that the operators use themselves.
CLASHES = "uid key sha part fp measures verdict host_key n_words kept component length rank size start target body".split()


def odd_rows():
    base = "the quick brown fox jumps over the lazy dog while seven wizards mix potions in a quiet tower near the old river bank today "
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(6000))
    rows = [
        (1, base * 3, "en", "a", 1), (2, (base * 3).upper(), "en", "a", 1), (3, base * 3 + "end", "en", "b", 1), (4, None, "en", "b", None),
        (5, "", None, None, 0), (6, " \n\t ", "en", "a", 3), (7, long, "en", "a", 1), (8, long + " tail", "en", "c", 1),
        (9, "one two", "en", "c", 7), (9, "one two", "en", "c", 7), (None, "one two", "en", "c", 7), (None, None, None, None, None),
        (10, "É É É É " * 40, "fr", "", 1), (11, "é é é é " * 40, "fr", "", 1), (12, "a b c a b c a b c x y z", "en", "a", 1),
        (13, "\n".join(["same line here"] * 60), "en", "a", 1), (14, "x" * 5000, "en", "d", 1), (15, "%%% " * 200, "en", "d", 1),
        (16, "wide　blank and hard blank\x0bvertical\x1cfield", "en", "d", 1), (17, "<|endoftext|> is text", "en", None, 1),
    ]
    for i in range(40):
        rows.append((100 + i, f"document {i} " + base * (1 + i % 4) + " ".join(f"t{i}k{j}" for j in range(i * 3)), "en", f"s{i % 5}", 1))
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA).repartition(3)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("mine") for c in CLASHES})


def given(spark, sf="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")


def key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)
