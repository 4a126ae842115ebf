"""Checks of a domain pack: its own cases, and a provider against them. Packs are small."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.functions.text import segment_id
from quoin.operators import contract
from quoin.provider import Provider
from quoin.sources.files import Pack

TOTALS = ("cases", "passed", "failed", "exact")


def totals(judged: DataFrame) -> dict:
    row = judged.agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count_if("exact").alias("exact")).first()
    return {k: row[k] for k in TOTALS}


def check(spark: SparkSession, pack: Pack) -> None:
    """A pack's own references must keep its contract."""
    n = totals(contract.evaluated(pack.cases.withColumn("target", F.col("reference")), pack.glossary))
    if not n["cases"] or n["failed"]:
        raise ValueError(f"{n['failed']} of {n['cases']} cases break the contract")


def evaluate(spark: SparkSession, pack: Pack, provider: Provider) -> dict:
    """Each case with what a provider made of it, and how many keep the contract or equal the reference; likeness is for a person to judge."""
    asked = pack.cases.withColumn("id", segment_id(F.col("source")))
    answers = provider.translate(asked.select("id", "source", F.lit(1).alias("batch"), "pos", F.lit(False).alias("is_reference")), pack.context)
    # a provider is asked once: its rows are few, and are held here
    held = spark.createDataFrame(answers.select("pos", "target", "problem").collect(), "pos long, target string, problem string")
    judged = contract.evaluated(asked.join(held, "pos", "left"), pack.glossary)
    rows = judged.orderBy("pos").select(F.col("pos").alias("case"), "id", "source", "reference", "target", "passed", "errors", "exact", "problem").collect()
    counts = {"cases": len(rows), "passed": sum(r["passed"] for r in rows), "failed": sum(not r["passed"] for r in rows), "exact": sum(r["exact"] for r in rows)}
    return counts | {"pack": pack.identity, "semantic_review": "required", "rows": [r.asDict() for r in rows]} | provider.provenance()
