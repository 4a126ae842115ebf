"""Contract operators: golden cases and differential checks against Python's own re and str."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quoin.functions import text as X
from quoin.functions import tokens as T
from quoin.operators import contract, segments

SPICE = ["{v1}", "{V2}", "<style id='1'>", '<STYLE  id="22">', "</style>", "https://a.b/c.", "HTTP://x/y）", "10.1000/ab.c;", "2.5", "-3", "−4,5e-6", "1960s", "mid-1960", "GPP", "AB-c", "AB-", "ABSTRACT", "ERA5", "mm", "MM", "°C", "%", "μmol m-2 s-1", "g C m-2", "W m-2", "K", "K", "km", "Pa", "中文", "é", "ß", "ﬁ", "ς", "\x1c", "\x85", " ", "\n", "\r\n", " ", "٣", "²", "x", "10", "A1"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(SPICE) + rng.choice(["", " ", "", "a", "."]) for _ in range(rng.randint(0, 9)))) for i in range(1500)]
    return rows, spark.createDataFrame(rows, "i long, t string").repartition(4).cache()


PYTHON = {"formula": (T.FORMULA, 0), "style": (T.STYLE, re.I), "url": (T.URL, re.I), "doi": (T.DOI, re.I), "number": (T.NUMBER, 0), "abbreviation": (T.ABBREVIATION, 0), "unit": (T.UNIT, re.I)}


@pytest.mark.parametrize("category", T.CATEGORIES)
def test_tokens_as_python_finds_them(texts, category):
    rows, df = texts
    pattern, flags = PYTHON[category]
    got = dict(df.select("i", T.tokens(F.col("t"), category)).collect())
    for i, t in rows:
        want = [m.group() for m in re.finditer(pattern, t, flags)]
        if category in ("url", "doi"):
            want = [w.rstrip(T.TRAILING) for w in want]
        if category == "abbreviation":
            want = [w for w in want if w not in T.NOT_ABBREVIATIONS]
        assert got[i] == want, repr(t)


def test_text_functions_as_python(texts):
    rows, df = texts
    t = F.col("t")
    got = {r["i"]: r for r in df.select("i", X.normalize_text(t).alias("n"), X.collapse(t).alias("c"), X.fold(t).alias("f"), X.match_text(t).alias("m"), X.without_line_numbers(t, F.array(F.lit("x"), F.lit("10"))).alias("l"), X.is_digits(t).alias("d")).collect()}
    for i, s in rows:
        r = got[i]
        assert r["n"] == s.replace("\r\n", "\n").replace("\r", "\n").strip()
        assert r["c"] == re.sub(r"\s+", " ", s).strip()
        assert r["f"] == s.casefold()
        assert r["m"] == re.sub("[^a-z0-9]+", "", re.sub(r"\{v\d+\}", "", s, flags=re.I).casefold())
        assert r["l"] == " ".join(x.strip() for x in s.splitlines() if x.strip() and x.strip() not in ("x", "10"))
        assert r["d"] == s.isdigit()


def test_folding_of_every_character(spark):
    import sys

    some = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).casefold() != chr(c)]
    got = spark.createDataFrame([(c,) for c in some], "c string").select("c", X.fold(F.col("c"))).collect()
    assert all(f == c.casefold() for c, f in got) and len(got) == len(some)


def test_rounding_as_python(spark):
    rng = random.Random(1)
    xs = [rng.uniform(-500, 500) for _ in range(3000)] + [k / 8 for k in range(-40, 40)] + [0.005, 2.675, 1.005]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", X.rounded(F.col("x"), 2)).collect()
    assert all(b == round(a, 2) for a, b in got)


GLOSSARY = [{"source": "Drifting buoy", "target": "漂流浮标", "required": True, "note": ""}, {"source": "straße", "target": "路", "required": True, "note": ""}, {"source": "measured", "target": "测", "required": False, "note": ""}]
CASES = [
    ("Curve {v3} ends near 41 km.", "曲线止于41 km附近。", ["formula_mismatch"]),
    ("<style id='7'>Low</style> tide, <style id='8'>high</style> tide", "<style id='8'>高</style>潮，<style id='7'>低</style>潮", ["style_order"]),
    ("The vane turned 30° after 12 mm of rain.", "雨后风向标转了。", ["number_missing:30|12", "unit_missing:°|mm"]),
    ("A drifting buoy (DB) was measured.", "测到了一个（DB）。", ["glossary:Drifting buoy"]),
    ("The drifting buoy (DB) lost 3.1% under {v2}.", "漂流浮标（DB）在{v2}下损失3.1%。", []),
    ("STRASSE", "x", ["abbreviation_missing:STRASSE", "glossary:straße"]),
    ("anything", " 　\n", ["blank"]),
    ("a long english sentence without any numbers in it at all", "nothing but letters here", ["cjk_missing"]),
    ("see https://a.b/c.", "见 https://a.b/c。", []),
    ("10.1000/x at https://doi.org/10.1000/x", "10.1000/x", ["url_mismatch", "doi_mismatch", "number_missing:10.1000"]),
]


def test_golden_cases(spark):
    df = spark.createDataFrame([(i, s, t) for i, (s, t, _) in enumerate(CASES)], "i int, s string, t string")
    got = dict(df.select("i", contract.errors(F.col("s"), F.col("t"), GLOSSARY)).collect())
    assert got == {i: e for i, (_, _, e) in enumerate(CASES)}


def test_headings_are_no_abbreviations_and_decades(spark):
    row = spark.sql("select 'ABSTRACT KEYWORDS REFERENCES in the mid-1960s.' as t").select(T.tokens(F.col("t"), "abbreviation"), T.tokens(F.col("t"), "number")).first()
    assert list(row) == [[], ["1960"]]


def with_ids(spark, rows, names):
    return spark.createDataFrame(rows, f"pos long, {names}").withColumn("id", X.segment_id(F.col("source")))


def test_validate_files(spark):
    segs = with_ids(spark, [(1, "one 1"), (2, "two"), (3, "three"), (4, "AB four")], "source string")
    good = segs.select("pos", "id", "source", F.col("source").alias("target"))
    contract.ensure_valid(segs, good)
    codes = lambda *a, **k: sorted(c for r in contract.validate(*a, **k).collect() for c in r["errors"])
    assert codes(segs, good.where("pos < 4")) == ["missing"]
    assert codes(segs.where("pos < 4"), good) == ["unexpected"]
    assert codes(segs, good.unionByName(good.where("pos = 1"))) == ["duplicate_translation"]
    assert codes(segs, good.withColumn("target", F.when(F.col("pos") == 1, "uno").otherwise(F.col("target")))) == ["number_missing:1"]
    assert codes(segs.withColumn("id", F.when(F.col("pos") == 2, F.lit("x")).otherwise(F.col("id"))), good.withColumn("id", F.when(F.col("pos") == 2, F.lit("x")).otherwise(F.col("id")))) == ["id"]
    assert codes(segs, good.withColumn("source", F.when(F.col("pos") == 2, F.lit("zwei")).otherwise(F.col("source")))) == ["source"]
    one, four = segs.where("pos = 1").select("id"), segs.where("pos = 4").select("id")
    changed = good.withColumn("target", F.when(F.col("pos").isin(1, 4), F.lit("1 AB new")).otherwise(F.col("target")))
    assert codes(segs, changed, None, one, four) == ["passthrough_changed", "preserved_changed"]
    assert codes(segs, changed, None, one, None, "translate-titles") == []
    assert codes(segs, good, None, one, one) == ["reference_and_passthrough"]
    assert codes(segs, good, None, None, spark.createDataFrame([("nope",)], "id string")) == ["unknown_passthrough"]
    with pytest.raises(ValueError):
        contract.ensure_valid(segs, changed, None, one, four)
    with pytest.raises(ValueError):
        contract.validate(segs, good, policy="guess")


def greedy(sizes, most, limit):
    out, n, total, b = [], 0, 0, 0
    for s in sizes:
        if n and (n >= most or total + s > limit):
            b, n, total = b + 1, 0, 0
        out.append(b)
        n, total = n + 1, total + s
    return out


def test_batches(spark):
    rng = random.Random(4)
    for most, limit, sizes in [(10, 25, [10] * 5), (3, 100, [200, 1, 1, 1, 1, 300])] + [(rng.randint(1, 6), rng.randint(1, 60), [rng.randint(0, 40) for _ in range(60)]) for _ in range(6)]:
        df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "pos long, size long")
        got = [r["batch"] for r in segments.batches(df, most, limit).orderBy("pos").collect()]
        assert got == greedy(sizes, most, limit)
    with pytest.raises(ValueError):
        segments.batches(df, 0, 1)


def test_collect_and_lookup(spark):
    rows = spark.createDataFrame([(3, "b"), (1, " a\r\n"), (2, "a"), (4, "c")], "pos long, source string")
    got = segments.collect(rows)
    assert sorted((r["pos"], r["source"]) for r in got.collect()) == [(1, " a\r\n"), (3, "b"), (4, "c")]
    t = got.where("pos < 4").select("pos", "id", F.concat(F.lit("T"), F.col("pos")).alias("target"))
    t = t.unionByName(t.where("pos = 3").select(F.lit(9).alias("pos"), "id", F.lit("later").alias("target")))
    found = segments.lookup(rows, t)
    assert {r["pos"]: r["target"] for r in found.collect()} == {1: "T1", 2: "T1", 3: "later", 4: None}
    assert segments.missing_targets(found).count() == 1
    assert segments.identity_violations(got).count() == 0 and segments.identity_violations(got.withColumn("id", F.lit(None).cast("string"))).count() == 3


def test_passthrough_order_idempotence_and_conflict(spark):
    segs = with_ids(spark, [(i, f"s{i}") for i in range(5)], "source string")
    none = spark.createDataFrame([], "pos long, id string, reason string, confirmed_by string")
    ask = segs.where("pos in (3, 1)").select("id")
    first, bad = segments.confirm_passthrough(none, ask, segs, " names ", "ann")
    order = [r["id"] for r in first.orderBy("pos").collect()]
    assert order == [r["id"] for r in segs.where("pos in (1, 3)").orderBy("pos").collect()] and bad.count() == 0
    again, bad = segments.confirm_passthrough(first, ask, segs, "names", "ann")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect())) and bad.count() == 0
    _, bad = segments.confirm_passthrough(first, ask.unionByName(spark.createDataFrame([("zz",)], "id string")), segs, "other", "ann")
    assert sorted(r["why"] for r in bad.collect()) == ["confirmed_otherwise", "confirmed_otherwise", "unknown"]


def test_evaluate(spark):
    rows = [(i, s, t, t) for i, (s, t, e) in enumerate(CASES)]
    r = contract.evaluate(spark.createDataFrame(rows, "pos int, source string, reference string, target string"), GLOSSARY).first()
    assert tuple(r) == (10, 2, 8, 10)
    echo = contract.evaluate(spark.createDataFrame([(i, s, t, s) for i, s, t, _ in rows], "pos int, source string, reference string, target string"), GLOSSARY).first()
    assert echo["failed"] > 0 and echo["exact"] == 0
