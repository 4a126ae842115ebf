"""Registered queries on small tables: whole texts, all rows."""

import difflib
import hashlib
import random
import re

import pytest

from quoin.operators import regions
from quoin.plans import queries

WORDS = "the of survey stone river letter window of in measure garden an late cold method".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def plain(x):
    return re.sub("[^a-z0-9]+", "", x.lower())


def share(a, b):
    return sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) / len(a) if a and b else 0.0


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    return {1: "\n".join([prose(rng, 600), prose(rng, 120), "", prose(rng, 40)]), 2: "\n".join([prose(rng, 5), prose(rng, 90)]), 3: prose(rng, 30), 4: "one\n \nthe three\nthe three"}


@pytest.fixture(scope="module")
def sf(spark, texts, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_matching_blocks_as_difflib():
    rng = random.Random(4)
    for _ in range(1500):
        letters = rng.choice(["a", "ab", "abc", "abcdefgh"])
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(2))
        assert regions._matched(a, b) == share(a, b)
    a, b = plain(prose(rng, 300)), plain(prose(rng, 400))
    assert regions._matched(a, b) == share(a, b)


def every_line(texts):
    return {d * 1_000_000 + i: (x, t) for d, t in texts.items() for i, x in enumerate(t.split("\n"), 1) if x.strip()}


def test_coverage_full_takes_whole_texts(spark, sf, texts):
    got = {r["pos"]: r["coverage"] for r in queries.coverage_full(spark, sf).collect()}
    want = {p: pytest.approx(share("zq" + plain(x), plain(t))) for p, (x, t) in every_line(texts).items()}
    assert got == want
    assert len(plain(texts[1].split("\n")[1])) > 300 and got[1_000_002] > 0.99


def test_coverage_fastpath_takes_every_line(spark, sf, texts):
    got = {(r["pos"], r["n"], r["m"], r["coverage"]) for r in queries.coverage_fastpath(spark, sf).collect()}
    assert got == {(p, len(plain(x)), len(plain(t)), 1.0) for p, (x, t) in every_line(texts).items()}
    assert {p for p, *_ in got} >= {3_000_001, 4_000_001, 1_000_004}  # no second line, a blank one, the fourth


def test_region_review_takes_every_line(spark, tmp_path):
    rng = random.Random(9)
    rows = [[prose(rng, 25) for _ in range(24)] for _ in range(4)] + [[prose(rng, 25) for _ in range(3)]]
    rows[1][11] = rows[1][2]
    rows[2][7] = "  "
    spark.createDataFrame([(d, "\n".join(x)) for d, x in enumerate(rows, 1)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["pos"]: (r["automatic"], r["coverage"]) for r in queries.region_review(spark, str(tmp_path)).collect()}
    want = {}
    for d, x in enumerate(rows, 1):
        region, numbers = (plain("".join(x[5:19])), [str(n) for n in range(4, 19)]) if len(x) > 4 else ("", [])
        for i, line in enumerate(x):
            if line.strip():
                at = share(plain(line), region)
                want[d * 1_000_000 + i + 1] = (len(plain(line)) >= 80 and region != "" and at >= 0.99, pytest.approx(at, abs=1e-6))
    assert got == want
    assert got[2_000_003][0] and not got[1_000_003][0]


def digits(texts):
    """The first hex digit of each segment's id."""
    return [hashlib.sha256(x.encode()).hexdigest()[0] for x in {x.strip() for t in texts for x in t.split("\n") if x.strip()}]


def test_eval_report_judges_every_pair(spark, tmp_path):
    rng = random.Random(10)
    docs = ["\n".join(prose(rng, 8) for _ in range(30)) for _ in range(5)]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    h = digits(docs)
    assert set(h) == set("0123456789abcdef")
    passed, exact = sum(x in "89ab" for x in h), sum(x in "0123" for x in h)  # by the rules of pairs
    assert tuple(queries.eval_report(spark, str(tmp_path)).first()) == (len(h), passed, len(h) - passed, exact)


def test_contract_errors_keeps_lost_units(spark, tmp_path):
    rng = random.Random(11)
    docs = ["\n".join(prose(rng, 8) + " 5 W m-2" for _ in range(30)) for _ in range(3)]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["id"]: r["errors"] for r in queries.contract_errors(spark, str(tmp_path)).collect()}
    lost = {i for i, e in rows.items() if "unit_missing:" in e}
    assert sorted(x[0] for x in rows) == sorted(digits(docs))
    assert lost == {i for i in rows if i[0] in "456"}  # their targets lose the digit of m-2


def test_split_word_scan_takes_every_line(spark, tmp_path):
    docs = {1: "a cat\ncatalogue of cats\n cat \nconcat", 2: "short\nshorts", 3: "at\nand", 4: "whole lines only here"}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for d, t in docs.items():
        flat = " ".join(t.split())
        for line in {x.strip() for x in t.split("\n")}:
            for m in re.finditer(f"(?={re.escape(line)})", flat):
                before = re.search(r"[A-Za-z]*$", flat[: m.start()])[0]
                after = re.match("[A-Za-z]*", flat[m.start() + len(line) :])[0]
                if before or after:
                    want.add((d, m.start() + 1, before, after))
    got = queries.split_word_scan(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["i"], r["prefix"], r["suffix"]) for r in got} == want and len(got) == len(want)
    assert {r["doc_id"] for r in got} == {1, 2} and len(want) == 4
