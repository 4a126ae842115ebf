"""Isolated queries beside large groups: op10 gives k rows wherever there are k others."""

import numpy as np
import pytest

from quoin.llm import ann


def crowd(rng, close, isolated, dims=32):
    middle = ann.unit(rng.standard_normal((1, dims)))
    near = middle + 1e-3 * rng.standard_normal((close, dims))
    return np.concatenate([near, ann.unit(rng.standard_normal((isolated, dims)))])


@pytest.mark.parametrize("seed", [0, 1])
def test_isolated_queries_get_k_rows(spark, seed):
    m = crowd(np.random.default_rng(seed), 97, 3)
    m[:60] = m[0]  # copies
    ids = [*range(1, 49), *range(51, 100), 0, 50, 100]  # the isolated rows ask
    rows = [(i, v.tolist()) for i, v in zip(ids, m, strict=True)]
    rows += [(0, v.tolist()) for v in -m[-3:]]  # more rows of a query's own id do not count
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert set(got) == {0, 50, 100}
    for q, found in got.items():
        assert [r for r, _ in sorted(found)] == [1, 2, 3, 4, 5] and q not in {i for _, i in found}


def test_fewer_rows_than_asked_for(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.1])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(r["vec_id"] for r in got) == [1, 2]


def test_scan_leaves_k():
    d = 64
    q = np.zeros(d, dtype=np.float32)
    c = np.zeros((d, 400), dtype=np.float32)
    c[0] = 1  # all of the distance is in the first columns
    assert len(ann.scan(q, c, 5)) >= 5
