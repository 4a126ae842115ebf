"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are shuffled (by a hash) into one stream of words, which repeats when it ends. Slot i
of the mix is the point frac(i * golden ratio) dropped into the sources' cumulative shares; a source's slots are
ranked, and the slot of rank r takes the r-th block of `block` words of the source's stream. Shares follow weights, but
no source gives more than `passes` times its words: the excess is reshared by weight. Where the points leave a source a
few slots short of its target, slots follow at the end; the last slot is cut so that the target is met to a word. So every
stretch of slots is near the targets, and the whole meets them. Of each row, the slots say where in the mix it stands.

No window or task holds a source: ranks and offsets are sums within hash buckets plus sums of buckets; windows over
sources have a row for each source. Null text has size 0, as has empty text; such rows take nothing. A null source is a
source of its own, the last. Rows with equal doc_id are rows of their own, told apart by a hash of the whole row, by
which rows without doc_id are shuffled. Other columns may have any names. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.llm.common import column, row_key, running_total, settled

WEIGHTS = (5, 2, 1)
PASSES = 3
BLOCK = 512
#: Cells of [0, 1) by which points find their source.
CELLS = 1024
GOLDEN = 0.6180339887498949
#: Stands for the slot of rows without words.
AFTER = 1 << 62
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, key, size) of each row, in the shared folder: texts are read once. key: a hash of the whole row."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    return settled(docs.select("doc_id", "source", row_key(docs).alias("key"), size.alias("size")), "sizes")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """One row a source: sid (1 up, by code point, null last), source, source_size, target (words), need (whole words), lo and hi (its share of [0, 1))."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = total.withColumn("sid", F.row_number().over(by_name)).withColumn("w", w).withColumn("cap", passes * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    every = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    up_to = by_ratio.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    rows = rows.withColumn("weight_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    rows = rows.withColumn("level", F.col("left") / F.col("weight_left"))
    rows = rows.withColumn("capped", F.min((F.col("cap") < F.col("w") * F.col("level")).cast("int")).over(up_to))
    rows = rows.withColumn("open_level", F.max(F.when(F.col("capped") == 0, F.struct(-F.row_number().over(by_ratio), "level"))).over(every)["level"])
    rows = rows.withColumn("target", F.when(F.col("capped") == 1, F.col("cap").cast("double")).otherwise(F.col("w") * F.col("open_level")))
    rows = rows.withColumn("need", F.least("cap", F.floor(F.col("target") + 0.5)))
    by_sid = Window.orderBy("sid")
    all_need = F.sum("target").over(every)
    hi = F.sum("target").over(by_sid.rowsBetween(Window.unboundedPreceding, 0)) / all_need
    rows = rows.withColumn("hi", F.when(F.lead("sid").over(by_sid).isNull(), F.lit(2.0)).otherwise(hi))
    rows = rows.withColumn("lo", F.coalesce(F.lag("hi").over(by_sid), F.lit(0.0)))
    return rows.select("sid", "source", "source_size", "target", "need", "lo", "hi")


def slots(plan: DataFrame, total: int, block: int = BLOCK, golden: float = GOLDEN) -> DataFrame:
    """(slot, sid, k): slot takes block k of its source's repeating stream. Every block below a source's need is there once."""
    n = math.ceil(total / block)
    i = F.col("id")
    # in two parts, so that the fraction stays exact enough for any number of slots
    point = F.pmod(F.shiftright(i, 20) * F.lit((golden * (1 << 20)) % 1.0) + i.bitwiseAND(F.lit((1 << 20) - 1)) * F.lit(golden), F.lit(1.0))
    points = plan.sparkSession.range(n).withColumn("x", point).withColumn("cell", F.floor(F.col("x") * CELLS).cast("int"))
    cells = plan.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS).cast("int"), F.least(F.floor(F.col("hi") * CELLS).cast("int"), F.lit(CELLS - 1)))))
    met = points.join(cells, "cell").where("x >= lo and x < hi").select(F.col("id").alias("slot"), "sid", F.shiftright(i, 16).alias("chunk"), F.lit(1).alias("one"))
    ranked = settled(running_total(met, ["sid"], "chunk", [F.col("slot")], "one", "k").select("slot", "sid", F.col("k").cast("long").alias("k")), "slots")
    have = ranked.groupBy("sid").agg(F.count("*").alias("n"))
    wanted = F.ceil(F.col("need") / F.lit(block))
    short = plan.join(have, "sid", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("lacks", F.greatest(wanted - F.col("n"), F.lit(0)))
    before = F.coalesce(F.sum("lacks").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each source
    late = short.withColumn("at", F.lit(n) + before).where("lacks > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lacks") - 1)))
    late = late.select((F.col("at") + F.col("i")).cast("long").alias("slot"), "sid", (F.col("n") + F.col("i")).cast("long").alias("k"))
    return ranked.join(plan.select("sid", "need"), "sid").where(F.col("k") * block < F.col("need")).select("slot", "sid", "k").unionByName(late)


def streams(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """Each row of sizes with sid, source_size, target, need and its offset in its source's shuffled stream."""
    rows = sizes.join(plan.drop("lo", "hi"), sizes["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    rows = rows.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("bucket", F.substring(F.when(F.col("doc_id").isNull(), F.md5(F.col("key").cast("string"))).otherwise(F.col("h")), 1, 3))
    return settled(running_total(rows, ["sid"], "bucket", [F.col("h"), F.col("doc_id"), F.col("size"), F.col("key")], "size", "offset").drop("h", "bucket"), "streams")


def schedule(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, block: int = BLOCK, golden: float = GOLDEN) -> tuple[DataFrame, DataFrame]:
    """(streams, pieces). pieces: slot, sid, offset (which names the row), pass (how often its source has been through), first (the piece's first word in the row), words."""
    sizes = sized(docs)
    plan = settled(targets(sizes, weights, passes), "plan")
    total = plan.agg(F.sum("source_size")).first()[0] or 0
    rows = streams(sizes, plan)
    lo = F.col("pass") * F.col("source_size") + F.col("offset")
    passed = rows.where("size > 0 and need > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("need") - 1) / F.col("source_size")))))
    passed = passed.withColumn("from", lo).withColumn("to", F.least(lo + F.col("size"), F.col("need"))).where("from < to")
    cut = passed.withColumn("k", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))))
    a, b = F.greatest(F.col("from"), F.col("k") * block), F.least(F.col("to"), (F.col("k") + 1) * block)
    blocks = cut.select("sid", "offset", "pass", "k", (a - F.col("from")).alias("first"), (b - a).alias("words"))
    return rows, slots(plan, total, block, golden).join(blocks, ["sid", "k"]).select("slot", "sid", "offset", "pass", "first", "words")


def placed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, block: int = BLOCK, golden: float = GOLDEN) -> DataFrame:
    """Of each row of docs (doc_id, text, source): doc_id, source, key, size, source_size, target, taken (words), first_slot, pieces, and starts (slot and words of each time it begins)."""
    rows, pieces = schedule(docs, weights, passes, block, golden)
    once = pieces.groupBy("sid", "offset", "pass").agg(F.min(F.struct("first", "slot"))["slot"].alias("slot"), F.sum("words").alias("words"), F.count("*").alias("pieces"))
    taken = once.groupBy("sid", F.col("offset").alias("_at")).agg(F.sum("words").alias("_taken"), F.min("slot").alias("first_slot"), F.sum("pieces").alias("_pieces"), F.sort_array(F.collect_list(F.struct("slot", "words"))).alias("starts"))
    keyed = rows.withColumn("_at", F.when(F.col("size") > 0, F.col("offset")))
    zero = F.lit(0).cast("long")
    return keyed.join(taken, ["sid", "_at"], "left").select("doc_id", "source", "key", "size", "source_size", "target", F.coalesce("_taken", zero).alias("taken"), "first_slot", F.coalesce("_pieces", zero).alias("pieces"), "starts")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, block: int = BLOCK, golden: float = GOLDEN) -> DataFrame:
    """`placed` without key and starts."""
    return placed(docs, weights, passes, block, golden).drop("key", "starts")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, block: int = BLOCK, golden: float = GOLDEN) -> DataFrame:
    """docs in the order of the schedule: a row stands wherever the mix begins it and takes at least half of it; rows without words stay once, at the ends of files.

    Rows go out by ranges of slots, so files follow the schedule one after another. Rows equal in all columns are interchangeable.
    """
    made = placed(docs, weights, passes, block, golden)
    begun = F.transform(F.filter("starts", lambda s: s["words"] * 2 >= F.col("size")), lambda s: s["slot"])
    at = F.when(F.col("size") == 0, F.array(F.lit(AFTER))).otherwise(begun)
    plan = settled(made.groupBy("doc_id", "source", "key").agg(F.flatten(F.collect_list(at)).alias("at"), F.count("*").alias("n")), "starts")
    last = plan.agg(F.max(F.array_max(F.filter("at", lambda s: s < AFTER)))).first()[0] or 0
    rows = docs.select("doc_id", "source", row_key(docs).alias("key"), *(column(c).alias(f"c{i}") for i, c in enumerate(docs.columns)))
    if not plan.where("n > 1").isEmpty():  # equal rows: one stands for all, with the places of all
        own = [f"c{i}" for i in range(len(docs.columns))]
        rows = rows.groupBy("doc_id", "source", "key").agg(*(F.first(c).alias(c) for c in own))
    same = rows["doc_id"].eqNullSafe(plan["doc_id"]) & rows["source"].eqNullSafe(plan["source"]) & (rows["key"] == plan["key"])
    out = rows.join(plan.where(F.size("at") > 0), same).select(rows["key"], F.explode("at").alias("slot"), *(f"c{i}" for i in range(len(docs.columns))))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # slots are equal in words, so equal ranges of slots are equal parts; rows without words are spread
    part = F.when(F.col("slot") == AFTER, F.pmod(F.xxhash64("key"), F.lit(parts))).otherwise(F.floor(F.col("slot") * F.lit(parts) / F.lit(last + 1)))
    dealt = out.repartitionById(parts, part.cast("int")).sortWithinPartitions("slot", "key")
    return dealt.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
