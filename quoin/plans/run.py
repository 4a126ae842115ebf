"""A run: states, provenance by hash, and resumable translation over datasets."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoin.operators import contract, segments
from quoin.provider import Context, Provider
from quoin.sources.files import Pack, write_json

# The states of a run, which of them each stage accepts, the manifest's version, and the limits of a batch.
STATES = ("initialized", "collected", "translated", "validated", "rendered", "qa_generated", "accepted")
ACCEPTS = {"collect": ("initialized",), "confirm": ("collected",), "hold": ("collected",), "repair": ("rendered", "qa_generated", "accepted"), "translate": ("collected", "translated"), "validate": ("translated", "validated"), "render": ("validated", "rendered"), "qa": ("rendered", "qa_generated"), "accept": ("qa_generated",)}
LEADS_TO = {"collect": "collected", "confirm": "collected", "hold": "collected", "repair": "rendered", "translate": "translated", "validate": "validated", "render": "rendered", "qa": "qa_generated", "accept": "accepted"}
SCHEMA_VERSION = 4
MAX_SEGMENTS, MAX_CHARACTERS = 200, 30_000
#: Batches asked for at a time; positions within which batches are dealt by one task, and beyond which none reaches.
WAVE, STRETCH = 64, 1 << 20


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def content_hash(df: DataFrame) -> str:
    """Of a dataset's rows whatever their order: sums of row hashes in two seeds, and the count."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    half = lambda n: F.sum(F.conv(F.substring(F.sha2(row, 256), n, 15), 16, 10).cast("decimal(38,0)"))
    r = df.agg(F.count("*").alias("n"), half(1).alias("a"), half(16).alias("b")).first()
    return f"{r['n']}-{int(r['a'] or 0):x}-{int(r['b'] or 0):x}"


class Run:
    """A folder with a manifest and one dataset a stage. Stages check state and the hashes of what they read."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, Path(folder)

    @property
    def path(self) -> Path:
        return self.folder / "run_manifest.json"

    def load(self) -> dict:
        m = json.loads(self.path.read_text(encoding="utf-8"))
        if m.get("status") not in STATES:
            raise ValueError(f"unknown status: {m.get('status')}")
        return m

    def initialize(self, source: DataFrame, about: dict) -> dict:
        """source: pos, source."""
        if self.path.exists():
            raise ValueError("the run exists")
        m = {"schema_version": SCHEMA_VERSION, "status": "initialized", "created_at": now(), "source_hash": content_hash(source), "about": about, "datasets": {}, "history": []}
        write_json(str(self.path), m)
        return m

    def begin(self, stage: str) -> dict:
        m = self.load()
        if m["status"] not in ACCEPTS[stage]:
            raise ValueError(f"{stage} does not follow {m['status']}")
        return m

    def end(self, m: dict, stage: str, **more: object) -> dict:
        m |= {"status": LEADS_TO[stage], **more}
        m["history"] = [*m["history"], {"stage": stage, "at": now()}]
        write_json(str(self.path), m)
        return m

    def save(self, m: dict, name: str, df: DataFrame, more: str = "") -> DataFrame:
        """Writes a dataset under a new name and records its hash; readers of the old one are not disturbed."""
        at = str(self.folder / f"{name}-{len(m['history'])}{more}.parquet")
        df.write.mode("overwrite").parquet(at)
        out = self.spark.read.parquet(at)
        m["datasets"][name] = {"path": at, "hash": content_hash(out)}
        return out

    def read(self, m: dict, name: str) -> DataFrame | None:
        if name not in m["datasets"]:
            return None
        df = self.spark.read.parquet(m["datasets"][name]["path"])
        if content_hash(df) != m["datasets"][name]["hash"]:
            raise ValueError(f"{name} has changed")
        return df

    def collect(self, source: DataFrame) -> DataFrame:
        m = self.begin("collect")
        if content_hash(source) != m["source_hash"]:
            raise ValueError("the source has changed")
        out = self.save(m, "segments", segments.collect(source))
        if out.isEmpty():
            raise ValueError("no segments")
        self.end(m, "collect")
        return out

    def confirm(self, name: str, ids: DataFrame, reviewer: str, reason: str = "confirmed") -> None:
        """name: references or passthrough. Not once all is translated.

        The passthrough map only grows: an id confirmed before keeps its reason and reviewer, and cannot be confirmed with others, nor can one that has another target already.
        """
        if not reviewer.strip() or not reason.strip():
            raise ValueError("reviewer and reason must be given")
        m = self.begin("confirm")
        known = self.read(m, "segments")
        if not contract.unknown_ids(ids, known).isEmpty():
            raise ValueError("unknown ids")
        other = self.read(m, "passthrough" if name == "references" else "references")
        if other is not None and not contract.overlap(ids, other).isEmpty():
            raise ValueError("an id is in both maps")
        if name == "passthrough":
            old, done = self.read(m, "passthrough"), self.read(m, "translations")
            if done is not None and not done.where(~F.col("target").eqNullSafe(F.col("source"))).join(ids.select("id"), "id", "left_semi").isEmpty():
                raise ValueError("an id has another target already")
            if old is None:
                old = self.spark.createDataFrame([], "pos long, id string, reason string, confirmed_by string")
            made, bad = segments.confirm_passthrough(old, ids, known, reason, reviewer)
            if conflicts := [tuple(r) for r in bad.orderBy("id").limit(12).collect()]:
                raise ValueError(f"not confirmed: {conflicts}")
            if not old.isEmpty() and contract.unknown_ids(ids, old).isEmpty():
                return  # nothing new: the map stays as it is
        else:
            made = ids.select("id").distinct().withColumn("confirmed_by", F.lit(reviewer.strip()))
        self.save(m, name, made)
        self.end(m, "confirm")

    def hold(self, name: str, flagged: DataFrame) -> DataFrame:
        """name: safety (flagged segments, id) or references (a review, id and automatic). Nothing is translated until a person has confirmed.

        Each flagged segment must be confirmed as passthrough; a review of references needs a confirmed map.
        """
        if name not in ("safety", "references"):
            raise ValueError(f"unknown review: {name}")
        m = self.begin("hold")
        if not contract.unknown_ids(flagged.select("id"), self.read(m, "segments")).isEmpty():
            raise ValueError("unknown ids")
        out = self.save(m, f"{name}_review", flagged)
        self.end(m, "hold")
        return out

    def open_reviews(self, m: dict) -> list[str]:
        """What a person has still to confirm."""
        waiting = []
        if self.read(m, "references_review") is not None and "references" not in m["datasets"]:
            waiting.append("references are not confirmed")
        flagged, through = self.read(m, "safety_review"), self.read(m, "passthrough")
        if flagged is not None:
            left = flagged.select("id").distinct()
            left = left if through is None else contract.unknown_ids(left, through)
            if n := left.count():
                waiting.append(f"{n} flagged segments are not confirmed as passthrough")
        return waiting

    def bind(self, m: dict, pack: Pack | None) -> None:
        """A run keeps to the pack, in content and languages, that it was first given; none is also a choice."""
        own = None if pack is None else pack.identity
        about = m.get("about", {})
        for side in ("source_language", "target_language"):
            if own is not None and about.get(side, own[side]) != own[side]:
                raise ValueError(f"the run's {side} is {about[side]}, the pack's {own[side]}")
        if "pack" in m and m["pack"] != own:
            raise ValueError(f"the run is bound to another pack: {m['pack']}")
        m["pack"] = own

    def translate(self, provider: Provider, pack: Pack | None = None, policy: str = "preserve", max_segments: int = MAX_SEGMENTS, max_characters: int = MAX_CHARACTERS, wave: int = WAVE) -> tuple[int, int]:
        """(reused, new). `wave` batches are asked for at a time and saved before the next; a batch that fails, or a row that is rejected, stops it after its wave. A later call asks for what is not there yet."""
        m = self.begin("translate")
        if waiting := self.open_reviews(m):
            raise ValueError("; ".join(waiting))
        self.bind(m, pack)
        if m.setdefault("policy", policy) != policy:
            raise ValueError(f"the run's policy is {m['policy']}")
        m["provider"] = provider.provenance()
        write_json(str(self.path), m)  # on record before the provider is asked
        glossary = None if pack is None else pack.glossary
        context = replace(Context() if pack is None else pack.context, policy=policy)
        segs, old = self.read(m, "segments"), self.read(m, "translations")
        refs, through = self.read(m, "references"), self.read(m, "passthrough")
        columns = ["pos", "id", "source", "target"]
        if old is None:
            old = self.spark.createDataFrame([], "pos long, id string, source string, target string")
        if not segments.identity_violations(segs).isEmpty() or not contract.duplicate_ids(segs).isEmpty():
            raise ValueError("segments are inconsistent")
        there = segs.join(old.select("id"), "id", "left_semi")
        if not contract.validate(there, old, glossary, refs, None if through is None else through.join(old.select("id"), "id", "left_semi"), policy).isEmpty():
            raise ValueError("saved translations break the contract")
        keep = through.select("id") if through is not None else None
        if refs is not None and policy == "preserve":
            keep = refs.select("id") if keep is None else keep.unionByName(refs.select("id"))
        reused, new = old.count(), 0
        if keep is not None:
            same = segments.preserved(segs, keep, old).select(columns)
            if new := same.count():
                old = self.save(m, "translations", old.select(columns).unionByName(same))
                write_json(str(self.path), m)
        todo = contract.flagged(segments.pending(segs, old), refs, "is_reference").withColumn("stretch", F.floor(F.col("pos") / STRETCH))
        dealt = segments.batches(todo.select("stretch", "pos", F.length("source").alias("size")), max_segments, max_characters, ["stretch"])
        sizes = dealt.groupBy("stretch").agg((F.max("batch") + 1).alias("n"))
        base = sizes.select("stretch", F.coalesce(F.sum("n").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row for each stretch
        asked = self.save(m, "asked", todo.join(dealt.join(F.broadcast(base), "stretch").select("pos", (F.col("base") + F.col("batch")).cast("int").alias("batch")), "pos").select("id", "source", "batch", "pos", "is_reference"))
        count = asked.agg(F.coalesce(F.max("batch") + 1, F.lit(0))).first()[0]
        m["datasets"].pop("rejected", None)
        for first in range(0, count, wave):
            some = asked.where((F.col("batch") >= first) & (F.col("batch") < first + wave))
            answered = self.save(m, f"answers-{first}", provider.translate(some, context))  # kept before it is judged
            failed = [r[0] for r in answered.where("problem is not null").select("problem").distinct().limit(12).collect()]
            errors = F.when(F.col("is_reference"), contract.errors(F.col("source"), F.col("target"))).otherwise(contract.errors(F.col("source"), F.col("target"), glossary))
            accepted, rejected = segments.split_results(answered.where("problem is null").withColumn("errors", errors))
            old = self.save(m, "translations", old.select(columns).unionByName(accepted.select(columns)), f"-{first}")
            bad = rejected.select(*columns, "errors")
            n_bad = bad.count()
            if n_bad:
                self.save(m, "rejected", bad)
            m["datasets"].pop(f"answers-{first}")
            if n_bad or failed:
                m["history"] = [*m["history"], {"stage": "translate_failed", "at": now(), "rejected": n_bad, "failed": failed}]
                write_json(str(self.path), m)
                raise ValueError("; ".join([f"{n_bad} targets were rejected; the others are saved"] * bool(n_bad) + [f"batches failed: {failed}"] * bool(failed)))
            write_json(str(self.path), m)  # what is saved counts from here on
        new += asked.count()
        self.end(m, "translate", reused=reused, new=new)
        return reused, new

    def validate(self, pack: Pack | None = None, policy: str = "preserve") -> None:
        m = self.begin("validate")
        self.bind(m, pack)
        contract.ensure_valid(self.read(m, "segments"), self.read(m, "translations"), None if pack is None else pack.glossary, self.read(m, "references"), self.read(m, "passthrough"), policy)
        self.end(m, "validate")

    def render(self, output: DataFrame) -> None:
        """Records the output pages that a renderer made elsewhere."""
        m = self.begin("render")
        self.save(m, "rendered", output)
        m.pop("accepted_by", None)
        self.end(m, "render")

    def qa(self, report: DataFrame) -> None:
        """report: doc_id, n_errors (as pagediff.inspect gives). Only a report without errors leads on."""
        m = self.begin("qa")
        self.read(m, "rendered")
        n = report.agg(F.coalesce(F.sum("n_errors"), F.lit(0))).first()[0]
        if n:
            raise ValueError(f"{n} errors")
        self.end(m, "qa")

    def repair(self, kind: str, output: DataFrame, verdict: DataFrame) -> None:
        """Puts repaired output pages in place if verdict (doc_id, violations; from pagediff) finds nothing; checks and acceptance start anew.

        The output before stays on disk, and the history names it.
        """
        if kind not in ("vector", "text"):
            raise ValueError(f"unknown repair: {kind}")
        m = self.begin("repair")
        self.read(m, "rendered")
        bad = verdict.where(F.size("violations") > 0)
        if n := bad.count():
            raise ValueError(f"{n} documents are not repaired as agreed: {[(r['doc_id'], r['violations']) for r in bad.orderBy('doc_id').limit(12).collect()]}")
        replaced = m["datasets"]["rendered"]
        self.save(m, "rendered", output)  # a new place: if the manifest cannot be written, the run is as it was
        m.pop("accepted_by", None)
        m["history"] = [*m["history"], {"stage": f"{kind}_repair", "at": now(), "replaced": replaced, "by": m["datasets"]["rendered"]}]
        self.end(m, "repair")

    def to_qa(self, source: DataFrame, provider: Provider, render: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame], DataFrame], pack: Pack | None = None, policy: str = "preserve", max_segments: int = MAX_SEGMENTS, max_characters: int = MAX_CHARACTERS) -> str:
        """Goes on from the run's state until it is checked; never accepts. render: translations to output pages; check: those to a report (doc_id, n_errors)."""
        steps = {
            "initialized": lambda m: self.collect(source),
            "collected": lambda m: self.translate(provider, pack, policy, max_segments, max_characters),
            "translated": lambda m: self.validate(pack, policy),
            "validated": lambda m: self.render(render(self.read(m, "translations"))),
            "rendered": lambda m: self.qa(check(self.read(m, "rendered"))),
        }
        while (m := self.load())["status"] in steps:
            steps[m["status"]](m)
        return m["status"]

    def accept(self, reviewer: str) -> None:
        if not reviewer.strip():
            raise ValueError("a person's name must be given")
        m = self.begin("accept")
        self.read(m, "rendered")
        self.end(m, "accept", accepted_by=reviewer.strip())
