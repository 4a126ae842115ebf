"""Texts are searched once a pattern, and common texts without tables."""

import re

from pyspark.sql import functions as F

from quoin.functions import text as X
from quoin.functions import tokens as T
from quoin.operators import contract


def test_errors_search_each_side_once_a_category(spark):
    rows = [("a {v1} 2 2.5 mm GPP", "a {v1} 2", 1), ("ABSTRACT 7 7", "7", 2), ("x", " ", 3)]
    df = spark.createDataFrame(rows, "source string, target string, i int").select("i", contract.errors(F.col("source"), F.col("target")).alias("e"))
    assert {r["i"]: r["e"] for r in df.collect()} == {1: ["number_missing:2.5", "abbreviation_missing:GPP", "unit_missing:mm"], 2: ["number_missing:7"], 3: ["blank"]}
    plan = df.selectExpr("i", "e")._jdf.queryExecution().analyzed().toString()
    assert len(re.findall(r"regexp_extract_all\(", plan)) == 2 * len(T.CATEGORIES)


def test_letters_are_counted_no_further_than_needed(spark):
    rows = [("",), ("abc",), ("a1b-c",), ("1a中b",), ("中" * 100,), ("é" * 9 + "xyz",)]
    for r in spark.createDataFrame(rows, "t string").select("t", T.has_ascii_letters(F.col("t"), 3).alias("h"), T.ascii_letters(F.col("t")).alias("n")).collect():
        assert r["h"] == (r["n"] >= 3)


def test_common_texts_are_folded_by_lower_case(spark):
    common = ["Straße ÉÖÜ ñ", "ЖЁ Άλφα", "“Quoted” – 中文", "I am İ", "ΣΑΣ", "ﬁ K Å ŉ", "Ì Į́", None]
    df = spark.createDataFrame([(x,) for x in common], "t string")
    got = df.select("t", X.fold(F.col("t")).alias("f"), X.strip(F.concat(F.lit(" "), "t", F.lit("\x1c\n"))).alias("s"), F.col("t").rlike(X._odd()).alias("odd")).collect()
    assert all(r["f"] == (r["t"] and r["t"].casefold()) and r["s"] == r["t"] for r in got)
    assert [r["odd"] for r in got] == [False] * 3 + [True] * 4 + [None]
