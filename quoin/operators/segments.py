"""Segments: collection, lookup, preserved and pending rows, greedy batches, accept and reject."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin.functions.text import segment_id


def collect(rows: DataFrame) -> DataFrame:
    """rows: pos, source. The first of each id, with its source unchanged; the smallest pos is found before any text is compared."""
    keyed = rows.withColumn("id", segment_id(F.col("source")))
    return keyed.groupBy("id").agg(F.min(F.struct("pos", "source")).alias("r")).select("id", "r.pos", "r.source")


def lookup(rows: DataFrame, translations: DataFrame) -> DataFrame:
    """rows: pos, source; translations: pos, id, target. Each row's target, of repeated ids the last; null where there is none (see `missing_targets`)."""
    last = translations.where("id is not null and id <> ''").groupBy("id").agg(F.max(F.struct("pos", "target")).alias("r")).select("id", F.col("r.target").alias("target"))
    return rows.withColumn("id", segment_id(F.col("source"))).join(last, "id", "left")


def missing_targets(found: DataFrame) -> DataFrame:
    return found.where(F.col("target").isNull())


def identity_violations(segments: DataFrame) -> DataFrame:
    """Rows without a source or whose id is not that of their source."""
    return segments.where(F.coalesce(F.col("source") == "", F.lit(True)) | ~F.col("id").eqNullSafe(segment_id(F.col("source"))))


def preserved(segments: DataFrame, ids: DataFrame, existing: DataFrame) -> DataFrame:
    """Segments kept as they are, in order, unless there already."""
    return segments.join(ids.select("id").distinct(), "id", "left_semi").join(existing.select("id"), "id", "left_anti").withColumn("target", F.col("source"))


def pending(segments: DataFrame, *done: DataFrame) -> DataFrame:
    """Segments in none of `done`."""
    for d in done:
        segments = segments.join(d.select("id"), "id", "left_anti")
    return segments


def states(segments: DataFrame, done: DataFrame, keep: DataFrame) -> DataFrame:
    """segments with state: reused (its id is done), else preserved (to be kept as it is), else pending."""
    flag = lambda ids, name: ids.select("id").distinct().withColumn(name, F.lit(True))
    met = segments.join(flag(done, "_done"), "id", "left").join(flag(keep, "_keep"), "id", "left")
    state = F.when(F.col("_done"), F.lit("reused")).when(F.col("_keep"), F.lit("preserved")).otherwise(F.lit("pending"))
    return met.withColumn("state", state).drop("_done", "_keep")


def batches(rows: DataFrame, max_rows: int, max_size: int, group: list[str] | None = None) -> DataFrame:
    """rows: pos, size (and group). Greedy batches in order, begun anew on overflow; a row too large is a batch of its own.

    A batch depends on the one before, so a group's sizes go through one task, as two numbers a row: group by run, document or stretch of positions.
    """
    if max_rows <= 0 or max_size <= 0:
        raise ValueError("limits must be positive")
    keys = group or []

    def deal(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos", kind="stable")
        sizes, out = part["size"].to_numpy(np.int64), np.zeros(len(part), dtype=np.int32)
        ends = np.append(0, np.cumsum(sizes))
        at, batch = 0, 0
        while at < len(sizes):  # once a batch
            to = min(at + max_rows, max(at + 1, int(np.searchsorted(ends, ends[at] + max_size, side="right")) - 1))
            out[at:to] = batch
            at, batch = to, batch + 1
        return part.assign(batch=out)

    narrow = rows.select(*keys, F.col("pos").cast("long").alias("pos"), F.col("size").cast("long").alias("size"), F.lit(0).alias("_all"))
    schema = T.StructType([*narrow.schema.fields, T.StructField("batch", T.IntegerType())])
    return narrow.groupBy(*keys, "_all").applyInPandas(deal, schema).drop("_all")


def split_results(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """judged: ..., errors. (accepted, rejected)."""
    return judged.where(F.size("errors") == 0).drop("errors"), judged.where(F.size("errors") > 0)


def confirm_passthrough(entries: DataFrame, requested: DataFrame, segments: DataFrame, reason: str, reviewer: str) -> tuple[DataFrame, DataFrame]:
    """(entries with the new ids behind, in segment order; conflicts: ids confirmed before with another reason or reviewer, and ids that no segment has). entries: pos, id, reason, confirmed_by."""
    reason, reviewer = reason.strip(), reviewer.strip()
    if not reason or not reviewer:
        raise ValueError("reason and reviewer must be given")
    asked = requested.select("id").distinct()
    changed = entries.join(asked, "id").where((F.col("reason") != reason) | (F.col("confirmed_by") != reviewer)).select("id", F.lit("confirmed_otherwise").alias("why"))
    unknown = asked.join(segments.select("id"), "id", "left_anti").select("id", F.lit("unknown").alias("why"))
    base = entries.agg(F.coalesce(F.max("pos"), F.lit(0)).alias("base"))
    new = segments.select("id", "pos").join(asked, "id", "left_semi").join(entries.select("id"), "id", "left_anti")
    new = new.withColumn("rn", F.row_number().over(Window.orderBy("pos"))).crossJoin(F.broadcast(base))  # as many rows as a person has asked for
    new = new.select((F.col("base") + F.col("rn")).cast("long").alias("pos"), "id", F.lit(reason).alias("reason"), F.lit(reviewer).alias("confirmed_by"))
    return entries.select("pos", "id", "reason", "confirmed_by").unionByName(new), changed.unionByName(unknown)
