"""Command line: python -m quoin COMMAND. Thin wrappers over runs, the contract and packs; exit code 1 where a check fails."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quoin.operators import contract, pagediff, regions, safety
from quoin.plans import packs
from quoin.plans.run import MAX_CHARACTERS, MAX_SEGMENTS, Run
from quoin.sources.files import export_jsonl, read_jsonl, read_pack

POLICIES = ("preserve", "translate-titles")


def found(name: str):
    """module:attribute."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def provider(name: str):
    """module:attribute, a provider or a function that makes one."""
    one = found(name)
    return one if hasattr(one, "provenance") and not isinstance(one, type) else one()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quoin")
    sub = top.add_subparsers(dest="command", required=True)
    options = {
        "--pack": {},
        "--policy": {"choices": POLICIES, "default": "preserve"},
        "--provider": {"required": True, "help": "module:attribute"},
        "--reviewer": {"required": True},
        "--reason": {"required": True},
        "--renderer": {"required": True, "help": "module:attribute, a function from translations to output pages"},
        "--ids": {"nargs": "+", "required": True},
        "--references": {"help": "JSONL with id"},
        "--passthrough": {"help": "JSONL with id"},
        "--max-segments": {"type": int, "default": MAX_SEGMENTS},
        "--max-characters": {"type": int, "default": MAX_CHARACTERS},
    }
    for name, given in {
        "domain-check": ["folder"],
        "provider-eval": ["folder", "--provider"],
        "validate-segments": ["segments", "translations", "--pack", "--policy", "--references", "--passthrough"],
        "init-run": ["folder", "source"],
        "collect": ["folder", "source"],
        "safety-review": ["folder", "pages"],
        "confirm-references": ["folder", "--ids", "--reviewer"],
        "confirm-passthrough": ["folder", "--ids", "--reviewer", "--reason"],
        "reference-review": ["folder", "blocks", "lines"],
        "translate": ["folder", "--provider", "--pack", "--policy", "--max-segments", "--max-characters"],
        "translate-segments": ["segments", "translations", "--provider", "--pack", "--max-segments", "--max-characters"],
        "run": ["folder", "source", "pages", "--provider", "--pack", "--policy", "--renderer", "--max-segments", "--max-characters"],
        "apply-vector-repair": ["folder", "pages"],
        "apply-text-repair": ["folder", "pages", "verdict"],
        "validate": ["folder", "--pack", "--policy"],
        "render": ["folder", "pages"],
        "qa": ["folder", "pages"],
        "accept": ["folder", "--reviewer"],
        "status": ["folder"],
    }.items():
        command = sub.add_parser(name)
        for g in given:
            command.add_argument(g, **options.get(g, {}))
    return top


def perform(spark: SparkSession, a: argparse.Namespace) -> object:
    jsonl = lambda path, schema: read_jsonl(spark, path, schema)
    ids = lambda path: jsonl(path, "id string") if path else None
    pack = read_pack(spark, a.pack) if getattr(a, "pack", None) else None
    if a.command == "domain-check":
        return packs.check(spark, read_pack(spark, a.folder))
    if a.command == "provider-eval":
        report = packs.evaluate(spark, read_pack(spark, a.folder), provider(a.provider))
        print(json.dumps(report, ensure_ascii=False))
        if report["failed"]:
            raise ValueError(f"{report['failed']} of {report['cases']} targets break the contract")
        return None
    if a.command == "validate-segments":
        return contract.ensure_valid(jsonl(a.segments, "id string, source string"), jsonl(a.translations, "id string, source string, target string"), pack and pack.glossary, ids(a.references), ids(a.passthrough), a.policy)
    if a.command == "translate-segments":  # from file to file: a run of its own beside the translations
        given = jsonl(a.segments, "id string, source string")
        run = Run(spark, f"{a.translations}.run")
        if not run.path.exists():
            run.initialize(given.select("pos", "source"), {"source": a.segments})
            run.collect(given.select("pos", "source"))
        said = run.translate(provider(a.provider), pack, "preserve", a.max_segments, a.max_characters)
        export_jsonl(run.read(run.load(), "translations").select("pos", "id", "source", "target"), a.translations)
        return said
    run = Run(spark, a.folder)
    if a.command == "init-run":
        run.initialize(jsonl(a.source, "source string"), {"source": a.source})
    elif a.command == "collect":
        run.collect(jsonl(a.source, "source string"))
    elif a.command == "safety-review":  # pages: parquet with doc_id, page, text of the one document
        pages = spark.read.parquet(a.pages)
        segments = run.read(run.load(), "segments")
        document = pages.select("doc_id").distinct().limit(2).collect()  # a run holds one
        if len(document) != 1:
            raise ValueError("pages must be those of one document")
        return run.hold("safety", safety.review(segments.withColumn("doc_id", F.lit(document[0][0])), pages)).count()
    elif a.command == "reference-review":  # blocks, lines: parquet, as regions.regions takes them, of the one document
        blocks, lines = spark.read.parquet(a.blocks), spark.read.parquet(a.lines)
        document = blocks.select("doc_id").distinct().limit(2).collect()
        if len(document) != 1:
            raise ValueError("blocks must be those of one document")
        segments = run.read(run.load(), "segments").withColumn("doc_id", F.lit(document[0][0]))
        return run.hold("references", regions.review(segments, regions.regions(blocks, lines))).where("automatic").count()
    elif a.command.startswith("confirm-"):
        asked = spark.createDataFrame([(i,) for i in a.ids], "id string")
        run.confirm(a.command.removeprefix("confirm-"), asked, a.reviewer, getattr(a, "reason", "confirmed"))
    elif a.command == "translate":
        return run.translate(provider(a.provider), pack, a.policy, a.max_segments, a.max_characters)
    elif a.command == "run":  # pages: those of the source
        if not run.path.exists():
            run.initialize(jsonl(a.source, "source string"), {"source": a.source})
        of = spark.read.parquet(a.pages)
        return run.to_qa(jsonl(a.source, "source string"), provider(a.provider), found(a.renderer), lambda out: pagediff.inspect(of, out), pack, a.policy, a.max_segments, a.max_characters)
    elif a.command == "apply-vector-repair":  # pages: the repaired output, with rect, text, images, vectors
        after = spark.read.parquet(a.pages)
        run.repair("vector", after, pagediff.verify_vector_repair(run.read(run.load(), "rendered"), after))
    elif a.command == "apply-text-repair":  # verdict: parquet, as pagediff.verify_text_repair gives
        run.repair("text", spark.read.parquet(a.pages), spark.read.parquet(a.verdict))
    elif a.command == "validate":
        run.validate(pack, a.policy)
    elif a.command == "render":
        run.render(spark.read.parquet(a.pages))
    elif a.command == "qa":  # pages: those of the source
        run.qa(pagediff.inspect(spark.read.parquet(a.pages), run.read(run.load(), "rendered")))
    elif a.command == "accept":
        run.accept(a.reviewer)
    return run.load()["status"]


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        if (said := perform(SparkSession.builder.appName("quoin").getOrCreate(), a)) is not None:
            print(said)
    except ValueError as why:
        print(why, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
