"""Nothing that grows is broadcast through the driver by the near-duplicate operator, whatever size Spark takes a table of files to be."""

import random

import brute
import pytest

import corpus_pipeline
from quoin.llm import queries, simhash


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(8)
    base = [" ".join(rng.choices("sun river stone bread cloud wind rain hill".split(), k=rng.randint(3, 60))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t + " end") for i, t in enumerate(base[:20])] + [(i, t) for i, t in enumerate(base[20:30])] + [(200, None), (None, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), rows


@pytest.fixture
def plans(monkeypatch):
    """(name, plan as Spark first chooses it) of each table written on the way."""
    seen, write = [], simhash.settled

    def settled(df, name):
        seen.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(simhash, "settled", settled)
    return seen


@pytest.mark.parametrize("few", [0, 100_000])
def test_near_dedup_broadcasts_no_table_that_grows(spark, folder, plans, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few, raising=False)
    at, rows = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, at)
    assert {"buckets", "large", "small", "roots", "classes", "twins"} <= {name for name, _ in plans}
    assert [name for name, plan in plans if "Broadcast" in plan] == []
    if not few:  # many repeated ids: neither of the two joins with them is a broadcast
        assert kept._jdf.queryExecution().optimizedPlan().toString().count("rightHint=(strategy=merge)") >= 3
    parts = brute.components(range(len(rows)), [brute.fingerprint((t or "").encode()) for _, t in rows])
    best = {}
    for row, part in zip(rows, parts, strict=True):
        best[part] = min(best.get(part, row), row, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(best.values(), key=str)


def test_op4_broadcasts_nothing(spark, folder, plans):
    at, rows = folder
    out = queries.op4_simhash(spark, at)
    assert [name for name, plan in [*plans, ("out", out._jdf.queryExecution().executedPlan().toString())] if "Broadcast" in plan] == []
    parts = brute.components([i for i, _ in rows], [brute.fingerprint((t or "").encode()) for _, t in rows])
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in out.collect()) == sorted((str(i), str(p)) for (i, _), p in zip(rows, parts, strict=True))
