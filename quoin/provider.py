"""Providers: what turns batches of segments into targets. No built-in one calls out.

An answer is JSON text. Whether it has the agreed shape and closes over the batch's ids is found by expressions on the row that holds the
batch and its answer; a batch whose call or answer fails comes back with a problem and no targets, beside the others.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Context:
    """What a provider is told beside the segments."""

    source_language: str = ""
    target_language: str = ""
    policy: str = "preserve"
    prompt: str = ""
    glossary: tuple[dict, ...] = ()


class Provider(Protocol):
    def translate(self, segments: DataFrame, context: Context) -> DataFrame:
        """segments: id, source, batch, pos, is_reference; returns them with target, and problem (null where the batch was answered)."""

    def provenance(self) -> dict: ...


class ColumnProvider:
    """A target by a native expression of the source."""

    def __init__(self, name: str, target: Callable[[Column], Column]) -> None:
        self.name, self.target = name, target

    def translate(self, segments: DataFrame, context: Context | None = None) -> DataFrame:
        return segments.withColumn("target", self.target(F.col("source"))).withColumn("problem", F.lit(None).cast("string"))

    def provenance(self) -> dict:
        return {"provider": self.name}


class BatchProvider:
    """A Python function from a batch's request (JSON text, see `request`) to an answer (JSON text, or what becomes it); one call a batch."""

    def __init__(self, name: str, call: Callable[[str], object]) -> None:
        self.name, self.call = name, call

    def translate(self, segments: DataFrame, context: Context | None = None) -> DataFrame:
        call, kept = self.call, ("pos", "id", "source", "is_reference")
        rows = F.sort_array(F.collect_list(F.struct(*kept)))
        asked = segments.groupBy("batch").agg(rows.alias("rows")).select("batch", "rows", request(F.col("rows"), context or Context()).alias("request"))
        sent = asked.select(F.col("batch").cast("int").alias("batch"), F.to_json("rows", {"ignoreNullFields": "false"}).alias("rows"), "request")

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    answer = failure = None
                    try:
                        said = call(batch.column(2)[i].as_py())
                        answer = said if isinstance(said, str) else json.dumps(said)
                    except Exception as why:  # noqa: BLE001 - one batch's failure must not lose the others' answers
                        failure = f"call: {why!r}"
                    columns = [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([answer], pa.string()), pa.array([failure], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["batch", "rows", "answer", "failure"])

        said = sent.mapInArrow(run, "batch int, rows string, answer string, failure string")
        listed = said.withColumn("rows", F.from_json("rows", "array<struct<pos:bigint,id:string,source:string,is_reference:boolean>>"))
        return closed(listed).select("batch", F.explode("rows").alias("r"), "targets", "problem").select("r.id", "r.source", "batch", "r.pos", "r.is_reference", F.when(F.col("problem").isNull(), F.col("targets")[F.col("r.id")]).alias("target"), "problem")

    def provenance(self) -> dict:
        return {"provider": self.name}


# The answer's format, as a JSON schema and as Spark names the type of such a value.
ANSWER = {"type": "object", "properties": {"translations": {"type": "array", "items": {"type": "object", "properties": {"id": {"type": "string"}, "target": {"type": "string"}}, "required": ["id", "target"], "additionalProperties": False}}}, "required": ["translations"], "additionalProperties": False}
ANSWER_TYPE = "OBJECT<translations: ARRAY<OBJECT<id: STRING, target: STRING>>>"


def answer_schema() -> dict:
    """JSON schema of a provider's answer: closed objects."""
    return ANSWER


def closed(answers: DataFrame) -> DataFrame:
    """answers: rows (array with id), answer (JSON text), failure. They with targets (a map by id) and problem: what keeps the answer from covering just these ids once each."""
    value = F.try_parse_json("answer")
    items = F.variant_get(value, "$.translations", "array<struct<id:string,target:string>>")
    got = answers.withColumn("_items", F.when(F.schema_of_variant(value) == ANSWER_TYPE, items))
    wanted, given = F.transform("rows", lambda r: r["id"]), F.transform("_items", lambda x: x["id"])
    said = lambda name, ids: F.when(F.size(ids) > 0, F.concat(F.lit(f"{name}: "), F.array_join(F.array_sort(ids), ",")))
    holes = F.exists("_items", lambda x: x["id"].isNull() | (x["id"] == "") | x["target"].isNull())
    repeated = F.filter(F.array_distinct(given), lambda k: F.size(F.filter(given, lambda x: x == k)) > 1)
    problem = F.coalesce("failure", F.when(F.col("_items").isNull() | holes, F.lit("shape")), said("repeated", repeated), said("missing", F.array_except(wanted, given)), said("unexpected", F.array_except(given, wanted)))
    entries = F.map_from_entries(F.transform("_items", lambda x: F.struct(x["id"], x["target"])))
    return got.withColumn("problem", problem).withColumn("targets", F.when(F.col("problem").isNull(), entries)).drop("_items")


# The request's rules in the language of prompts here; a pack's own prompt stands before them.
RULES = ("Return each id exactly once, unchanged.", "Keep all {vN} placeholders and <style id='N'>...</style> tags, as often and in the same order.", "Keep numbers, signs, units, abbreviations, names of datasets, URLs, DOIs and citations.", "Answer with JSON of the agreed form and nothing else.")
TITLES_ONLY = "Of kind reference, translate only titles; glossary terms do not apply to it."


def request(rows: Column, context: Context) -> Column:
    """A batch's request as JSON text: languages, prompt, rules by policy, glossary, and the segments with their kind. rows: array with id, source, is_reference."""
    rules = [*RULES, *([TITLES_ONLY] if context.policy == "translate-titles" else [])]
    fixed = {"source_language": context.source_language, "target_language": context.target_language, "prompt": context.prompt}
    terms = F.array(*(F.struct(F.lit(g["source"]).alias("source"), F.lit(g["target"]).alias("target")) for g in context.glossary)) if context.glossary else F.array().cast("array<struct<source:string,target:string>>")
    kind = lambda r: F.when(r["is_reference"], F.lit("reference")).otherwise(F.lit("body"))
    segments = F.transform(rows, lambda r: F.struct(r["id"].alias("id"), kind(r).alias("kind"), r["source"].alias("source")))
    return F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in fixed.items()), F.array(*map(F.lit, rules)).alias("rules"), terms.alias("glossary"), segments.alias("segments")))


def checked_endpoint(url: str) -> str:
    """HTTPS, or HTTP to this machine; no credentials, query or fragment."""
    parts = urlsplit(url)
    local = parts.hostname in ("localhost", "127.0.0.1", "::1")
    if parts.scheme not in ("https", "http") or (parts.scheme == "http" and not local) or not parts.hostname or parts.username or parts.password or parts.query or parts.fragment:
        raise ValueError("the endpoint must be plain HTTPS, or HTTP on this machine")
    return url.rstrip("/")
