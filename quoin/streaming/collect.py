"""An extension: segments collected from a stream, the first of each id, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quoin.operators.segments import collect


def collect_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """rows: a stream of pos, source. Appends segments not yet under path; a batch that is run again finds its rows there."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = collect(batch)
        there = spark.read.schema("id string, pos long, source string, batch long").parquet(f"{path}/*") if number else None
        if there is not None:
            new = new.join(there.where(f"batch < {number}").select("id"), "id", "left_anti")
        new.selectExpr("*", f"cast({number} as long) as batch").write.mode("overwrite").parquet(f"{path}/b{number}")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
