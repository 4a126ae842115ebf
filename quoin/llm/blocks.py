"""Vectors packed into blocks of bounded size, and the grid of query blocks against candidate blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.llm.common import column

#: Numbers in a block: rows times dimensions.
BLOCK_NUMBERS = 1 << 20


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v): rows whose vector is not null or empty and has only finite components, as double. A repeated row is there as often."""
    v = column(vector)
    good = column(key).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(good, F.lit(False))).select(column(key).cast("long").alias(key), v.cast("array<double>").alias("v"))


def rows_per_block(dims: int) -> int:
    return max(64, BLOCK_NUMBERS // max(1, dims))


def packed(rows: DataFrame, group: list[str], key: str = "vec_id", more: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """One row a group: group, dims, ids (int64 bytes), data (float64 bytes, one dimension after another) and, if `more` is given, what it makes of the rows' matrix (float32 bytes, laid out alike). Groups must be bounded."""
    ints = ", ".join(f"{g} {rows.schema[g].dataType.simpleString()}" for g in group)

    def pack(of: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(key, kind="stable")
        data = np.stack(part["v"].to_list()).astype(np.float64)
        made = [] if more is None else [np.ascontiguousarray(more(data).astype(np.float32).T).tobytes()]
        return pd.DataFrame([[*of, data.shape[1], part[key].to_numpy(np.int64).tobytes(), np.ascontiguousarray(data.T).tobytes(), *made]], columns=[*group, "dims", "ids", "data", *["more"] * len(made)])

    return rows.groupBy(*group).applyInPandas(pack, f"{ints}, dims int, ids binary, data binary{', more binary' * (more is not None)}")


def unpacked(dims: int, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """ids; matrix with a row for each dimension."""
    k = np.frombuffer(ids, dtype=np.int64)
    return k, np.frombuffer(data, dtype=np.float64).reshape(dims, len(k))


def numbered(rows: DataFrame) -> DataFrame:
    """rows of a settled table with `n`, a number of each: a repeated row is dealt like any other."""
    return rows.withColumn("n", F.monotonically_increasing_id())


def dealt(blocks: Column) -> Column:
    """The block of a numbered row, of so many."""
    return F.pmod(F.xxhash64("n"), blocks).cast("int")


def best(rows: DataFrame, k: int, score: Column) -> DataFrame:
    """Of (query_id, vec_id, ...): the k best of each query with rank; ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(score.desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
