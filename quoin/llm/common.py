"""What the operators of this folder share: Arrow mapping, shared-folder tables, row keys, prefix sums."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows leave a Python worker in batches of about this many bytes.
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where it is unset and all tasks run on this machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="quoin-")
        sc.setCheckpointDir(named)
        named = sc.getCheckpointDir()
    return named


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/quoin/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Best effort: what is left behind is only space."""
    with contextlib.suppress(Exception):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settled(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read again: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes a settled table whose last reader is done."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)


def column(name: str) -> Column:
    """A top-level column, whatever its name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """The name, or one like it that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _has_map(t: T.DataType) -> bool:
    return isinstance(t, T.MapType) or isinstance(t, T.ArrayType) and _has_map(t.elementType) or isinstance(t, T.StructType) and any(_has_map(f.dataType) for f in t)


def row_key(df: DataFrame) -> Column:
    """A 64-bit hash of a whole row; maps are hashed as JSON."""
    return F.xxhash64(*(F.to_json(F.struct(column(f.name))) if _has_map(f.dataType) else column(f.name) for f in df.schema))


def annotated(df: DataFrame, text: str, results: str, worker: Callable[[], Callable[[bytes | None], tuple]], keep_text: bool = True) -> DataFrame:
    """df with the columns of `results` (DDL), which worker()(text as bytes, or None) gives as a tuple for each row.

    A column of df that has the name of a result is replaced by it; other names may be anything. Rows leave in batches of about BATCH_BYTES.
    """
    made = T.StructType.fromDDL(results)
    names = {f.name.lower() for f in made}
    others = [f for f in df.schema if f.name != text and f.name.lower() not in names]
    own = [f for f in df.schema if f.name == text]
    schema = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(others)), T.StructField("t", T.BinaryType()), *(T.StructField(f"r{i}", f.dataType) for i, f in enumerate(made))])
    kinds = [f.type for f in to_arrow_schema(T.StructType(made.fields))]
    sent = df.select(*(column(f.name).alias(f"c{i}") for i, f in enumerate(others)), column(text).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = worker()
        for batch in batches:
            raw, at = batch.column(batch.num_columns - 1), 0
            while at < batch.num_rows:
                got, held, start = [], 0, at
                while at < batch.num_rows and held < BATCH_BYTES:
                    data = raw[at].as_py()
                    got.append(fn(data))
                    held += 64 + 2 * len(data or b"")
                    at += 1
                part = batch.slice(start, at - start)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(list(c), k) for c, k in zip(zip(*got, strict=True), kinds, strict=True))], names=schema.names)

    out = sent.mapInArrow(run, schema)
    places = {f.name: f"c{i}" for i, f in enumerate(others)}
    back = {f.name.lower(): (f.name, f"r{i}") for i, f in enumerate(made)}
    chosen = []
    for f in df.schema:
        if f.name.lower() in back:
            name, at = back.pop(f.name.lower())
            chosen.append(F.col(at).alias(f.name))
        elif f.name != text:
            chosen.append(F.col(places[f.name]).alias(f.name))
        elif keep_text:
            chosen.append(F.col("t").cast(own[0].dataType).alias(text))
    return out.select(*chosen, *(F.col(at).alias(name) for name, at in back.values()))


def rows_in_arrow(batches: Iterator[pa.RecordBatch], fn: Callable[[tuple], Iterator[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Applies fn to each row; what it yields goes out in batches of about BATCH_BYTES."""
    out: list[tuple] = []
    held = 0
    for batch in batches:
        for row in zip(*(c for c in batch.columns), strict=True):
            for made in fn(tuple(x.as_py() for x in row)):
                out.append(made)
                held += 64 + sum(len(x) for x in made if isinstance(x, (bytes, str, list)))
                if held >= BATCH_BYTES:
                    yield _batch(out, schema)
                    out, held = [], 0
    if out:
        yield _batch(out, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def map_rows(df: DataFrame, fn: Callable[[tuple], Iterator[tuple]], ddl: str, schema: pa.Schema) -> DataFrame:
    """df.mapInArrow with fn from a row's tuple to tuples of schema; ddl is the same schema for Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows_in_arrow(batches, fn, schema)

    return df.mapInArrow(run, ddl)


def running_total(df: DataFrame, key: list[str], chunk: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds out: the sum of value over the rows before this one, within key, in the order (chunk, order).

    No window holds a whole key: each holds one (key, chunk), and the chunks' own sums are added up apart.
    """
    sums = df.groupBy(*key, chunk).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*key, chunk, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return inner.join(bases, [*key, chunk]).withColumn(out, F.col("_base") + F.col("_in")).drop("_base", "_in")


def spread_join(left: DataFrame, right: DataFrame, on: list[str], by: list[str], how: str = "left", ways: int = 16) -> DataFrame:
    """left.join(right, on), where one key may hold very many rows of left: they are dealt over `ways` tasks by the columns `by`, and right, which has each key once, is there that often."""
    dealt = left.withColumn("_way", F.pmod(F.xxhash64(*by), F.lit(ways)).cast("int"))
    several = right.withColumn("_way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return dealt.join(several, [*on, "_way"], how).drop("_way")
