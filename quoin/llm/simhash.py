"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: one bit is set where it is set in over half of the XXH64 hashes of a text's word shingles.
Search: every bit position gets a vector of r+1 bits; for each of the 2^(r+1)-1 non-zero vectors v, a mask keeps the
positions whose vector has an odd overlap with v. Any r positions leave some v that overlaps all of them evenly, so two
fingerprints that differ in at most r bits agree under that mask: no pair within the radius is missed.

Distinct fingerprints only are compared, and only a spanning forest of a bucket's links goes out. A bucket with more than
BUCKET fingerprints is parted by a second family of masks, and so on: each family covers every pair by itself, so none is
missed, and five masks together leave at most 10 bits open, so 1,024 fingerprints. (Where a smaller bucket is asked for, what
is still larger after the fifth is cut by a hash, and its parts meet pair by pair.) Alternating large-star and small-star
steps, each written to the shared folder, join the forests into components.

Joins of tables that grow are hinted to be sort-merge joins: Spark takes a table read from files to be as large as its files,
compressed and before its rows are multiplied by masks or ways, and would broadcast far more than its threshold through the driver.

Null text counts as empty: fingerprint zero. Rows with equal doc_id are rows of their own; a component's id is its
smallest doc_id, null only if all its doc_ids are null. Other columns do not matter. An empty table gives no rows.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.llm.common import annotated, column, dropped, map_rows, row_key, settled, spread_join

RADIUS, WORDS, SEED = 4, 4, 42
#: Fingerprints compared in one group; a larger bucket is parted by the next family of masks.
BUCKET = 1024
FAMILIES = 5
#: So many repeated ids may be broadcast.
FEW = 100_000


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """64 bits, as a signed integer."""
    parts = text.lower().split()  # bytes: A-Z only; ASCII white space only
    n = len(parts)
    if not n:
        return 0
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=n)
    ends = np.cumsum(lengths + 1) - 1
    k = min(words, n)
    starts, stops = (ends - lengths)[: n - k + 1].tolist(), ends[k - 1 :].tolist()
    h, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), 1 << 15):
        hashes = np.array([h(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 15)], stops[at : at + (1 << 15)], strict=True)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "_fp") -> DataFrame:
    """docs without text, with the fingerprint as a signed long."""
    return annotated(docs, text, f"`{out}` long", lambda: lambda data: (fingerprint(data or b""),), keep_text=False)


@lru_cache(maxsize=8)
def masks(radius: int, family: int = 0) -> tuple[int, ...]:
    """2^(radius+1)-1 masks of the 64 positions; any `radius` positions are left out by at least one. Families differ in which positions share a vector."""
    span = (1 << (radius + 1)) - 1
    vectors = [1 + i % span for i in range(64)]
    random.Random(radius + 1000 * family).shuffle(vectors)
    return tuple(sum(1 << p for p, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, span + 1))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def keyed(rows: DataFrame, radius: int, family: int) -> DataFrame:
    """rows: fp, and key from the family before. A row (key, fp) for each mask: the key names the mask and the masked bits, within the key before."""
    wide = F.explode(F.array(*(F.lit(signed(m)) for m in masks(radius, family)))).alias("mask")
    before = [F.col("key")] if family else []
    each = rows.select("fp", *before, wide)
    return each.select(F.xxhash64(*before, "mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp")


def forest(fps: list[int], radius: int) -> list[tuple[int, int]]:
    """(smallest fingerprint, member) for each member of each linked group within a bucket."""
    a = np.array(fps, dtype=np.int64)
    near = np.bitwise_count(a.view(np.uint64)[:, None] ^ a.view(np.uint64)[None, :]) <= radius
    label = np.arange(len(a))
    order = np.argsort(a, kind="stable")
    rank = np.empty_like(order)
    rank[order] = label
    label = rank.copy()
    while True:  # the smallest rank spreads over the links
        new = np.where(near, label[None, :], len(a)).min(axis=1)
        new = np.minimum(new, new[order[new]])
        if (new == label).all():
            break
        label = new
    return [(int(a[order[x]]), int(f)) for x, f in zip(label, a, strict=True) if a[order[x]] != f]


def links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """nodes: one column fp, distinct. Rows (a, b), a < b: a forest whose trees are, bucket by bucket, the linked groups. Where two keys fall together by chance, more is compared, not less."""
    rows, every, used = nodes.select("fp"), None, []
    for family in range(FAMILIES):
        dealt = keyed(rows, radius, family)
        sizes = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        shared = settled(dealt.join(sizes.hint("merge"), "key"), "buckets")
        used.append(shared)
        groups = shared.where(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
        every = groups if every is None else every.unionByName(groups)
        rows = shared.where(F.col("n") > bucket).select("key", "fp", "n")
        if rows.isEmpty():
            break
    else:
        large = rows.withColumn("parts", F.ceil(F.col("n") / F.lit(bucket)).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        paired = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        pairs = paired.groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list("fp").alias("fps"))
        every = every.unionByName(pairs.select("fps"))
    out = settled(map_rows(every, lambda row: iter(forest(row[0], radius)), "a long, b long", pa.schema([("a", pa.int64()), ("b", pa.int64())])).distinct(), "links")
    for table in used:
        dropped(table)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has an edge (a, b) to another. Tables of a round go when the next one is written."""
    now = settled(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = spread_join(both.where("b > a"), least.hint("merge"), ["a"], ["b"], "inner").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        large = settled(large, "large")
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low.hint("merge"), "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(low.select(F.col("m").alias("a"), "b")).distinct()
        old, now = now, settled(small, "small")
        dropped(large)
        dropped(old)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(new) == tuple(state):
            break
        state = new
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def cluster(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Of each row of docs (doc_id, text): doc_id, _fp, component_id and _root (a fingerprint that names the component)."""
    marked = settled(fingerprints(docs.select("doc_id", "text")), "fingerprints")
    groups = settled(marked.groupBy(F.col("_fp").alias("fp")).agg(F.min("doc_id").alias("least")), "groups")
    edges = links(groups.select("fp"), radius, bucket)
    roots = components(edges)
    dropped(edges)
    whole = settled(groups.join(roots.hint("merge"), groups["fp"] == roots["node"], "left").select("fp", "least", "root"), "roots")
    linked = whole.where("root is not null")
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    alone = whole.where("root is null").select(F.col("fp").alias("_fp"), F.col("least").alias("component_id"), F.col("fp").alias("_root"))
    of = settled(alone.unionByName(spread_join(linked, named.hint("merge"), ["root"], ["fp"], "inner").select(F.col("fp").alias("_fp"), "component_id", F.col("root").alias("_root"))), "classes")
    dropped(groups)
    return spread_join(marked, of.hint("merge"), ["_fp"], ["doc_id"], "inner")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: that with its smallest doc_id; of rows that share it, the smallest text."""
    names = [column(c) for c in docs.columns]
    held = cluster(docs, radius)
    best = held.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    among = lambda ids: F.col("doc_id").eqNullSafe(ids["_id"])
    twins = settled(docs.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_id")), "twins")
    repeated = twins.count()
    if not repeated:
        return docs.join(best, among(best), "left_semi").select(names)
    if repeated > FEW:
        twins = twins.hint("merge")
    # rows with the same doc_id, or none, may be of one component or of several
    alone = docs.join(twins, among(twins), "left_anti").join(best, among(best), "left_semi").select(names)
    some = docs.join(twins, among(twins), "left_semi")
    prints = fingerprints(some.select(*[c.alias(f"_{i}") for i, c in enumerate(names)], F.col("text")))
    rows = prints.join(held.select("_fp", "component_id", "_root").distinct().hint("merge"), "_fp")
    own, text = F.col(f"_{docs.columns.index('doc_id')}"), F.col(f"_{docs.columns.index('text')}")
    one = rows.where(own.eqNullSafe(F.col("component_id"))).withColumn("_rn", F.row_number().over(Window.partitionBy("_root").orderBy(text, row_key(prints.drop("_fp"))))).where("_rn = 1")
    return alone.unionByName(one.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)]))
