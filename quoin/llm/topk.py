"""Exact top-k by inner product: columnar branch-and-bound.

Vectors become integers, floor(scale * x). Candidates lie in blocks in vertical layout, one dimension after another. For a
few queries at a time, scores accumulate dimension block by dimension block; after each, the mass that is left of query
and candidate (the product of their remaining norms) bounds what a candidate may still gain or lose. Candidates that cannot
reach the k-th best lower bound any more are dropped and the rest compacted, so that later dimensions are read for
survivors only. Bounds are wide by half a unit, scores are whole numbers: the result is exact.

Query blocks meet candidate blocks pair by pair; both are of bounded size. All queries meet one block first: the k-th best
score found there is a floor under every other block's bounds, so those send only rows that may be among the best.
Vectors that are null, empty, or hold null or non-finite components take no part; nor do rows with a null id. Only vectors of
the same length are compared. A repeated row is a candidate as often as it is there, but asks once; rows with a query's own id are
no candidates of it. Rows that share an id but not a vector each contribute their scores as queries. Numbers too large for exact doubles are multiplied as Python integers, and scores
beyond a long are held at its ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.llm.blocks import best, dealt, numbered, packed, rows_per_block, unpacked, usable
from quoin.llm.common import map_rows, settled

SCALE, K, EVERY = 64, 20, 20
#: Dimensions added between two bounds; queries worked on at a time.
STEP, BATCH = 16, 64
LONG = 2**63 - 1


def remaining(m: np.ndarray, starts: list[int]) -> list[np.ndarray]:
    """Norms of what is left of each column of m from each start on, rounded up a little."""
    squares = np.add.reduceat(m * m, starts, axis=0) if starts else m[:0]
    tail = np.cumsum(squares[::-1], axis=0)[::-1]
    return [np.sqrt(t) * (1 + 1e-9) for t in tail] + [np.zeros(m.shape[1])]


def pair(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, floors: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query, candidate, score): for each query its k best of this block, of those not below its floor, by branch and bound; q and c have a row for each dimension."""
    dims, out = len(c), []
    least = np.full(len(q_ids), -np.inf) if floors is None else np.where(floors == -LONG - 1, -np.inf, floors.astype(np.float64))
    reach = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * dims
    if reach >= 2**53:
        return whole_numbers(q_ids, q, c_ids, c, k)
    kind = np.float32 if reach < 2**24 else np.float64  # whole numbers are exact in either
    order = np.argsort(-(c * c).sum(axis=1), kind="stable")  # heavy dimensions first: bounds close sooner
    q, c = q[order], c[order]
    starts = list(range(0, dims, STEP))
    rc, rq = remaining(c, starts), remaining(q, starts)
    c, q = np.ascontiguousarray(c, dtype=kind), np.ascontiguousarray(q, dtype=kind)
    for at in range(0, len(q_ids), BATCH):
        ids = q_ids[at : at + BATCH]
        part = q[:STEP, at : at + BATCH].T @ c[:STEP]
        for i, own in enumerate(ids):
            score, live, qi = part[i].astype(np.float64), None, q[:, at + i]
            mine = np.flatnonzero(c_ids == own)
            if len(mine):
                live = np.delete(np.arange(len(c_ids)), mine)
                score = score[live]
            for b, start in enumerate(starts):
                if b:
                    cols = c[start : start + STEP] if live is None else c[start : start + STEP, live]
                    score = score + qi[start : start + STEP] @ cols
                if b == len(starts) - 1 or len(score) <= k and least[at + i] == -np.inf:
                    continue
                slack = rq[b + 1][at + i] * (rc[b + 1] if live is None else rc[b + 1][live]) + 0.5
                floor = max(least[at + i], np.partition(score - slack, len(score) - k)[len(score) - k] if len(score) > k else -np.inf)
                alive = score + slack >= floor
                live = np.flatnonzero(alive) if live is None else live[alive]
                score = score[alive]
            found = c_ids if live is None else c_ids[live]
            if len(score) > k:
                floor = np.partition(score, len(score) - k)[len(score) - k]
                top = score >= floor
                score, found = score[top], found[top]
            for j in np.lexsort((found, -score))[:k]:
                if score[j] >= least[at + i]:
                    out.append((int(own), int(found[j]), int(score[j])))
    return out


def whole_numbers(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The same by Python integers, without bounds: for numbers that doubles cannot add exactly."""
    out, columns = [], [[int(x) for x in col] for col in c.T]
    for own, col in zip(q_ids, q.T, strict=True):
        mine = [int(x) for x in col]
        got = [(max(-LONG - 1, min(LONG, sum(a * b for a, b in zip(mine, other, strict=True)))), int(i)) for i, other in zip(c_ids, columns, strict=True) if i != own]
        out += [(int(own), i, s) for s, i in sorted(got, key=lambda x: (-x[0], x[1]))[:k]]
    return out


def search(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each row whose id is divisible by `every`."""
    rows = usable(vectors, key, vector).select(F.col(key).alias("vec_id"), F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"), F.size("v").alias("len"))
    rows = settled(rows, "vectors")
    asking = rows.where(F.pmod("vec_id", F.lit(every)) == 0).distinct()
    per = F.greatest(F.lit(64), F.floor(F.lit(rows_per_block(1)) / F.col("len")))
    n, q = (t.groupBy("len").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.first(per))).alias(name)) for t, name in ((rows, "c_blocks"), (asking, "q_blocks")))
    grid = settled(n.join(q, "len"), "grid")  # a row for each vector length that is asked for; L lengths need L * L / 2 numbers
    c = numbered(rows).join(F.broadcast(grid), "len").withColumn("cb", dealt(F.col("c_blocks")))
    c = settled(packed(c.select("len", "cb", "q_blocks", "vec_id", "v"), ["len", "cb", "q_blocks"]), "blocks")
    placed = asking.join(F.broadcast(grid), "len").withColumn("qb", F.pmod(F.xxhash64("vec_id", "v"), F.col("q_blocks")).cast("int"))
    q = settled(packed(placed.select("len", "qb", "c_blocks", "vec_id", "v"), ["len", "qb", "c_blocks"]), "queries")

    def run(row: tuple):
        dims, qi, qd, ci, cd, known = row
        ids, data = unpacked(dims, qi, qd)
        of = {} if known is None else {x["vec_id"]: x["floor"] for x in known}
        floors = np.array([of.get(int(i), -LONG - 1) for i in ids], dtype=np.int64) if of else None
        yield from pair(ids, data, *unpacked(dims, ci, cd), k, floors)

    def met(queries: DataFrame, blocks: DataFrame, known: Column) -> DataFrame:
        each = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
        right = blocks.withColumn("qb", each("q_blocks")).select("len", "cb", "qb", F.col("ids").alias("c_ids"), F.col("data").alias("c_data"))
        left = queries.withColumn("cb", each("c_blocks")).select("len", "cb", "qb", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), known.alias("known"))
        pairs = left.join(right, ["len", "cb", "qb"]).select("len", "q_ids", "q_data", "c_ids", "c_data", "known")
        return map_rows(pairs, run, "query_id long, vec_id long, score long", pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))

    none = F.lit(None).cast("array<struct<vec_id:bigint,floor:bigint>>")
    first = settled(met(q, c.where("cb = 0"), none), "first")
    floors = first.groupBy("query_id").agg(F.count("*").alias("n"), F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1)).alias("floor")).where(F.col("n") >= k)  # at most k scores for each row that asks with an id
    known = placed.select("len", "qb", F.col("vec_id").alias("query_id")).join(floors, "query_id").groupBy("len", "qb").agg(F.collect_set(F.struct(F.col("query_id").alias("vec_id"), "floor")).alias("known"))
    rest = met(q.join(known, ["len", "qb"], "left"), c.where("cb > 0"), F.col("known"))
    return best(first.unionByName(rest), k, F.col("score")).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
