"""Small tables with every odd case that the operators must bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("ids", "decoded", "fingerprint", "component_id", "t1", "t2", "shard", "slot", "bytes", "group", "score", "_text", "n_tokens", "media", "lang_pred")


def words(rnd, n, letters="abcdeé"):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 7))) for _ in range(n))


def odd_rows(seed=1, n=40):
    """NULLs in every column, empty and long texts, repeated rows, one id twice, copies."""
    rnd = random.Random(seed)
    rows = [(i, words(rnd, rnd.randint(1, 60)), rnd.choice(["en", "fr", None]), "s", None) for i in range(n)]
    rows += [(100, None, "en", None, None), (101, "", "en", "s", 0), (None, "no id here at all", "fr", "s", 1), (None, None, None, None, None)]
    rows += [(102, words(rnd, 20_000), "en", "s", 1), rows[3], rows[3], (4, "another text under id four", "en", "s", 2)]
    rows += [(200 + i, rows[7][1], "en", "s", 3) for i in range(5)]
    return rows


def odd_table(spark, seed=1, n=40):
    return spark.createDataFrame(odd_rows(seed, n), SCHEMA).repartition(3)


def empty_table(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """The table with extra columns named as the operators name theirs."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES if c not in df.columns])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
