"""Approximate nearest neighbours by cosine: inverted lists with an adaptive dimension scan.

Unit vectors are turned by a random rotation, once, and kept, list by list, in column blocks. A query visits the lists of its
nearest centroids, and on until they hold k other rows. In each, squared distances accumulate column block by column block; after d of D columns a hypothesis test
asks whether the whole distance can still be below the k-th best so far: the part so far, times D/d, is expected to
be the whole, within a factor (1 + EPS/sqrt(d))^2 by the rotation; candidates beyond are abandoned, and the others compacted.
The k-th best of a query's nearest list is the first threshold in all its others. What survives all columns is scored in double
precision on the original vectors.

There are a quarter of the square root of the rows lists, at most LISTS. Centroids are fitted on SAMPLE rows, or SAMPLE_LIST for
each list if that is more, chosen by a hash; the same sample says how many lists must be visited for RECALL of its own true
neighbours. Every row is indexed. Lists are cut into blocks of bounded size, so a list that many equal vectors fill is
spread. Centroids and the rotation go to the workers with the code: at most LISTS times the dimensions.

Vectors that are null, empty or zero, or hold null or non-finite components, take no part; nor do rows with a null id. Of several lengths,
each is searched by itself. A repeated row is a candidate as often as it is there, but asks once; rows with a query's own id are no
candidates of it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.llm.blocks import best, dealt, numbered, packed, rows_per_block, unpacked, usable
from quoin.llm.common import map_rows, settled

K, EVERY = 5, 50
#: Rows of the sample, rows for each list if that is more, and numbers at most.
SAMPLE, SAMPLE_LIST, SAMPLE_NUMBERS = 20_000, 16, 1 << 22
LISTS, RECALL, EPS, STEP = 4_096, 0.97, 2.1, 16


@dataclass
class Index:
    rotation: np.ndarray
    centroids: np.ndarray  # rotated
    probes: int


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow."""
    big = np.abs(m).max(axis=1, keepdims=True)
    m = m / big
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def lists_of(rows: int) -> int:
    return int(min(LISTS, max(1, math.sqrt(rows) / 4)))


def fit(sample: np.ndarray, rows: int, k: int = K, seed: int = 11, recall: float = RECALL) -> Index:
    """Spherical k-means on the sample's rotated unit vectors; lists to visit so that the sample's own neighbours are found."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
    x = unit(sample) @ rotation
    lists = min(lists_of(rows), len(x))
    c = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(12):
        at = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        empty = (sums * sums).sum(axis=1) < 1e-18
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        c = unit(sums)
    at = (x @ c.T).argmax(axis=1)
    asked = rng.choice(len(x), min(500, len(x)), replace=False)
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -9
    top = np.argsort(-near, axis=1)[:, :k]
    ranks = np.argsort(np.argsort(-(x[asked] @ c.T), axis=1), axis=1)
    need = np.sort(np.take_along_axis(ranks, at[top], axis=1).ravel())
    probes = int(need[min(len(need) - 1, int(np.ceil(recall * len(need))))]) + 1 if len(need) else 1
    return Index(rotation, c, min(lists, probes))


def scan(q: np.ndarray, c: np.ndarray, k: int, known: float = np.inf, eps: float = EPS, step: int = STEP) -> np.ndarray:
    """Columns of c (rotated unit vectors, a row for each dimension) that the tests leave for q: of those nearer than known (a squared distance) at least its k nearest, as far as the tests hold."""
    dims, n = c.shape
    if n <= 4 * k and known == np.inf:
        return np.arange(n)
    limit = known
    if n > 4 * k:
        first = ((c[:, : 4 * k] - q[:, None]) ** 2).sum(axis=0)  # some whole distances give the first threshold
        limit = min(known, np.partition(first, k - 1)[k - 1])
    live, part = None, np.zeros(n, dtype=c.dtype)
    for at in range(0, dims, step):
        cols = c[at : at + step] if live is None else c[at : at + step, live]
        diff = cols - q[at : at + step, None]
        part = part + np.einsum("ij,ij->j", diff, diff)
        seen = min(dims, at + step)
        if seen < dims:
            allowed = limit * seen / dims * (1 + eps / np.sqrt(seen)) ** 2 + 1e-5
        else:
            if len(part) > k:
                limit = min(limit, np.partition(part, k - 1)[k - 1])
            allowed = limit + 1e-5
        keep = part <= allowed
        if known == np.inf and np.count_nonzero(keep) < k:  # never fewer than were asked for
            keep = part <= np.partition(part, k - 1)[k - 1]
        live = np.flatnonzero(keep) if live is None else live[keep]
        part = part[keep]
        if not len(part):
            break
    return live


def visit(q_ids, q, q_turned, c_ids, c, turned, k: int, known: dict[int, float] | None = None) -> list[tuple[int, int, float]]:
    """For each query its k best of this block of a list, of those not below its known score; exact scores on the original vectors of what the scan leaves."""
    out, known = [], known or {}
    rows, asked = np.ascontiguousarray(c.T), np.ascontiguousarray(q.T)
    for own, vector, t in zip(q_ids.tolist(), asked, np.ascontiguousarray(q_turned.T), strict=True):
        mine = int(np.count_nonzero(c_ids == own))
        least = known.get(own)
        live = scan(t, turned, k + mine, np.inf if least is None else max(0.0, 2 - 2 * least) + 1e-5)
        live = live[c_ids[live] != own]
        s = cosine(rows[live], vector)
        for j in np.lexsort((c_ids[live], -s))[:k]:
            if least is None or s[j] >= least:
                out.append((own, int(c_ids[live[j]]), float(s[j])))
    return out


def cosine(rows: np.ndarray, v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        dots, left, right = (rows * v).sum(axis=1), np.sqrt((rows * rows).sum(axis=1)), np.sqrt((v * v).sum())
        s = dots / (left * right)
        odd = ~np.isfinite(s) | (left < 1e-140) | (right < 1e-140) | (left * right > 1e300)
    if odd.any():  # squares too large or too small for a double
        s[odd] = (unit(rows[odd]) * unit(v[None, :])).sum(axis=1)
    return s


def build(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, dict[int, Index]]:
    """(rows: vec_id, v, len; an index for each length that has rows)."""
    rows = usable(vectors, key, vector).where(F.exists("v", lambda x: x != 0)).select(F.col(key).alias("vec_id"), "v", F.size("v").alias("len"))
    rows = settled(rows, "vectors")
    made = {}
    for r in rows.groupBy("len").agg(F.count("*").alias("n")).collect():  # as many as there are lengths
        size = max(64, min(max(SAMPLE, SAMPLE_LIST * lists_of(r["n"])), SAMPLE_NUMBERS // r["len"]))
        picked = rows.where(F.col("len") == r["len"]).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(size)
        bytes_of = map_rows(picked.select("v"), lambda row: iter([(np.array(row[0], dtype=np.float64).tobytes(),)]), "b binary", pa.schema([("b", pa.binary())]))
        made[r["len"]] = fit(np.frombuffer(b"".join(x["b"] for x in bytes_of.collect()), dtype=np.float64).reshape(-1, r["len"]), r["n"])
    return rows, made


def search(vectors: DataFrame, k: int = K, every: int = EVERY, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each row whose id is divisible by `every`."""
    rows, made = build(vectors, key, vector)
    out = None
    for dims, index in made.items():
        found = search_one(rows.where(F.col("len") == dims), dims, index, k, every)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return best(out, k, F.col("score")).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search_one(rows: DataFrame, dims: int, index: Index, k: int, every: int) -> DataFrame:
    rotation, centroids, probes = index.rotation, index.centroids, index.probes
    query = F.pmod("vec_id", F.lit(every)) == 0

    def lists(held: np.ndarray | None = None):
        """The nearest list of each row; with rows held by each list, all that a query (with own: rows of its id) has to visit."""

        def run(batches):
            for batch in batches:
                ids, col = batch.column(0), batch.column(1)
                for at in range(0, batch.num_rows, 8192):
                    some = col.slice(at, 8192)
                    m = some.flatten().to_numpy(zero_copy_only=False).reshape(len(some), dims)
                    near = (unit(m) @ rotation) @ centroids.T
                    order = np.argsort(-near, axis=1, kind="stable").astype(np.int32)
                    if held is None:
                        n = np.ones(len(some), dtype=np.int64)
                    else:
                        own = batch.column(2).slice(at, 8192).to_numpy(zero_copy_only=False)
                        n = np.maximum(probes, (np.cumsum(held[order], axis=1) < (k + own)[:, None]).sum(axis=1) + 1)
                    yield pa.RecordBatch.from_arrays([ids.slice(at, 8192), some, pa.array([o[:x].tolist() for o, x in zip(order, n, strict=True)], pa.list_(pa.int32()))], names=["vec_id", "v", "lists"])

        return run

    ddl = "vec_id long, v array<double>, lists array<int>"
    placed = settled(rows.select("vec_id", "v").mapInArrow(lists(), ddl).select("vec_id", "v", F.col("lists")[0].alias("list")), "placed")
    held = np.zeros(len(centroids), dtype=np.int64)
    for r in placed.groupBy("list").agg(F.count("*").alias("n")).collect():  # at most LISTS rows
        held[r["list"]] = r["n"]
    asking = rows.where(query).select("vec_id", "v")
    asking = asking.distinct().join(asking.groupBy("vec_id").agg(F.count("*").alias("own")), "vec_id").select("vec_id", "v", "own")
    asked = settled(asking.mapInArrow(lists(held), ddl).select("vec_id", "v", F.posexplode("lists").alias("nth", "list")), "asked")
    per = rows_per_block(dims) // 4
    sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / per).alias("c_blocks"))  # at most LISTS rows
    turn = lambda m: unit(m) @ rotation
    c = numbered(placed).join(F.broadcast(sizes), "list").withColumn("cb", dealt(F.col("c_blocks")))
    c = settled(packed(c.select("list", "cb", "vec_id", "v"), ["list", "cb"], more=turn), "blocks")

    def run(row: tuple):
        qi, qd, qt, ci, cd, ct, known = row
        ids, data = unpacked(dims, qi, qd)
        more = lambda b, n: np.frombuffer(b, dtype=np.float32).reshape(dims, n)
        c_ids, c_data = unpacked(dims, ci, cd)
        yield from visit(ids, data, more(qt, len(ids)), c_ids, c_data, more(ct, len(c_ids)), k, {x["vec_id"]: x["score"] for x in known or ()})

    def found(some: DataFrame, floors: DataFrame | None) -> DataFrame:
        """The lists that `some` asks for, block by block; floors: query_id, score."""
        blocks = sizes.join(some.groupBy("list").agg(F.ceil(F.count("*") / per).alias("q_blocks")), "list")
        q = some.join(F.broadcast(blocks), "list").withColumn("qb", F.pmod(F.xxhash64("vec_id", "v"), F.col("q_blocks")).cast("int"))
        q = settled(q, "dealt")
        left = packed(q.select("list", "qb", "c_blocks", "vec_id", "v"), ["list", "qb", "c_blocks"], more=turn)
        if floors is None:
            left = left.withColumn("known", F.lit(None).cast("array<struct<vec_id:bigint,score:double>>"))
        else:
            known = q.select("list", "qb", "vec_id").join(floors.withColumnRenamed("query_id", "vec_id"), "vec_id").groupBy("list", "qb").agg(F.collect_set(F.struct("vec_id", "score")).alias("known"))
            left = left.join(known, ["list", "qb"], "left")
        left = left.withColumn("cb", F.explode(F.sequence(F.lit(0), (F.col("c_blocks") - 1).cast("int")))).select("list", "cb", "qb", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("more").alias("q_more"), "known")
        right = c.join(F.broadcast(blocks.select("list", "q_blocks")), "list").withColumn("qb", F.explode(F.sequence(F.lit(0), (F.col("q_blocks") - 1).cast("int")))).select("list", "cb", "qb", F.col("ids").alias("c_ids"), F.col("data").alias("c_data"), F.col("more").alias("c_more"))
        met = left.join(right, ["list", "cb", "qb"]).select("q_ids", "q_data", "q_more", "c_ids", "c_data", "c_more", "known")
        return map_rows(met, run, "query_id long, vec_id long, score double", pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    near = settled(found(asked.where("nth = 0"), None), "near")
    floors = near.groupBy("query_id").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1)).alias("score")).where("score is not null")  # at most k scores for each block of one list
    return near.unionByName(found(asked.where("nth > 0"), floors))
