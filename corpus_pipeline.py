"""From raw documents to token ids: five stages, each over all that the one before it kept.

toxicity drops documents whose noisy-or score is 0.5 or more (null and empty texts stay); near_dedup keeps one document of
each SimHash component; pii replaces personal data by its type; mixing repeats or leaves out documents, and puts
them in the order of its schedule, so that sources meet their target weights; encoding turns texts into ids and back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm import bpe, mixing, pii, queries, simhash, toxicity
from quoin.llm.common import column, dropped, fresh, settled


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = queries.toxicity_model(docs, queries.table(spark, sf_dir, "labels"))
    score, spans = fresh(docs, "toxic_score"), fresh(docs, "toxic_spans")
    return toxicity.score(docs, model, names=(score, spans)).where(F.col(score) < 0.5).select(*map(column, docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    base, spans = fresh(docs, "pii_base"), fresh(docs, "pii_spans")
    found = pii.detect(docs, mask=True, names=(base, spans))
    length = F.when(F.col(spans) != "", F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", length).select(*map(column, docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.digests(bpe.encode_decode(docs.select("doc_id", "text"), public_tokenizers.path(queries.VOCABULARY), public_tokenizers.PATTERN))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("pii", mask_personal_data), ("mixing", mix_sources), ("encoding", encode)]

#: XXH64 fingerprints, trained scores and byte pairs are beyond SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, settled(stage(spark, docs, sf_dir), name)
        if n:
            dropped(before)  # its only reader is done
    return STAGES[-1][1](spark, docs, sf_dir)
