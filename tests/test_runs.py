"""Reviews before translation, repairs, resuming, packs and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from quoin import __main__ as command
from quoin.operators import safety
from quoin.plans import packs
from quoin.plans.run import Run
from quoin.provider import BatchProvider, ColumnProvider, answer_schema
from quoin.sources import files

def echo(request):
    return json.dumps({"translations": [{"id": x["id"], "target": x["source"]} for x in json.loads(request)["segments"]]})


SAME = ColumnProvider("same", lambda s: s)
PAGE = "doc_id long, page int, text string"


def test_nothing_is_translated_before_reviews_are_confirmed(spark, tmp_path):
    run = Run(spark, str(tmp_path / "r"))
    src = spark.createDataFrame([(1, "re 5 shows a perio"), (2, "Hello"), (3, "a normal line 1")], "pos long, source string")
    run.initialize(src, {})
    segs = run.collect(src)
    calls = []
    provider = BatchProvider("counts", echo)
    flagged = safety.review(segs.withColumn("doc_id", F.lit(1).cast("long")), spark.createDataFrame([(1, 1, "Figure 5 shows a period; a normal line 1")], PAGE))
    assert run.hold("safety", flagged).count() == 2
    run.hold("references", segs.select("id", F.lit(False).alias("automatic")))
    watched = ColumnProvider("watched", lambda s: calls.append(1) or s)
    with pytest.raises(ValueError, match="references are not confirmed; 2 flagged"):
        run.translate(watched)
    ids = {r["source"]: r["id"] for r in segs.collect()}
    run.confirm("references", spark.createDataFrame([], "id string"), "ann")
    run.confirm("passthrough", spark.createDataFrame([(ids["Hello"],)], "id string"), "ann")
    with pytest.raises(ValueError, match="^1 flagged"):
        run.translate(watched)
    assert not calls and "provider" not in run.load()
    run.confirm("passthrough", flagged.select("id"), "ann")
    assert run.translate(provider) == (0, 3)
    assert run.read(run.load(), "asked").select("source").collect() == [("a normal line 1",)]
    with pytest.raises(ValueError):
        run.hold("safety", flagged)  # too late
    with pytest.raises(ValueError):
        run.hold("other", flagged)


def test_resume_and_repair(spark, tmp_path):
    run = Run(spark, str(tmp_path / "r"))
    src = spark.createDataFrame([(1, "one 1")], "pos long, source string")
    run.initialize(src, {})
    pages = spark.createDataFrame([(1, 1, "x")], PAGE)
    report = lambda n: spark.createDataFrame([(1, n)], "doc_id long, n_errors long")
    with pytest.raises(ValueError, match="2 errors"):
        run.to_qa(src, SAME, lambda t: pages, lambda p: report(2))
    assert run.load()["status"] == "rendered"
    assert run.to_qa(src, None, None, lambda p: report(0)) == "qa_generated"  # earlier stages are not done again
    run.accept("ann")
    assert run.to_qa(src, None, None, None) == "accepted"
    verdict = "doc_id long, violations array<string>"
    before = run.load()
    with pytest.raises(ValueError, match="nothing_added"):
        run.repair("vector", pages, spark.createDataFrame([(1, ["nothing_added"])], verdict))
    assert run.load() == before
    run.repair("vector", spark.createDataFrame([(1, 1, "y")], PAGE), spark.createDataFrame([(1, [])], verdict))
    m = run.load()
    assert m["status"] == "rendered" and "accepted_by" not in m and run.read(m, "rendered").first()["text"] == "y"
    row = m["history"][-2]
    assert row["stage"] == "vector_repair" and spark.read.parquet(row["replaced"]["path"]).first()["text"] == "x"
    with pytest.raises(ValueError):
        run.repair("font", pages, spark.createDataFrame([], verdict))


@pytest.fixture
def pack(tmp_path):
    at = tmp_path / "pack"
    at.mkdir()
    (at / "manifest.json").write_text(json.dumps({"id": "p", "version": "1", "source_language": "en", "target_language": "zh"}))
    (at / "prompt.txt").write_text("Translate.")
    (at / "glossary.tsv").write_text("source\ttarget\trequired\tnote\ngross production\t总生产\ttrue\t\n")
    (at / "eval_cases.jsonl").write_text('{"source": "Gross production rose by 2.5%.", "target": "总生产增加了2.5%。"}\n')
    return at


def test_packs_and_providers(spark, pack):
    read = files.read_pack(spark, str(pack))
    packs.check(spark, read)
    got = packs.evaluate(spark, read, SAME)
    assert (got["cases"], got["passed"], got["failed"], got["exact"], got["provider"]) == (1, 0, 1, 0, "same")
    assert [(r["case"], r["target"], r["passed"], r["errors"]) for r in got["rows"]] == [(1, "Gross production rose by 2.5%.", False, ["glossary:gross production"])]
    good = packs.evaluate(spark, read, ColumnProvider("fixed", lambda s: F.lit("总生产增加了2.5%。")))
    assert (good["passed"], good["exact"], good["semantic_review"]) == (1, 1, "required")
    (pack / "eval_cases.jsonl").write_text('{"source": "Gross production rose by 2.5%.", "target": "总生产增加了。"}\n')
    with pytest.raises(ValueError, match="1 of 1"):
        packs.check(spark, files.read_pack(spark, str(pack)))
    assert answer_schema()["properties"]["translations"]["items"]["additionalProperties"] is False


def test_command_line(spark, pack, tmp_path, capsys):
    source = tmp_path / "s.jsonl"
    source.write_text('{"source": "one 1"}\n{"source": "Hello"}\n')
    run, pages = str(tmp_path / "run"), str(tmp_path / "pages")
    spark.createDataFrame([(1, 1, "one 1 there")], PAGE).write.parquet(pages)
    go = lambda *a: command.main(list(a))
    assert go("domain-check", str(pack)) == 0
    assert go("provider-eval", str(pack), "--provider", "test_runs:SAME") == 1
    assert go("init-run", run, str(source)) == go("collect", run, str(source)) == go("safety-review", run, pages) == 0
    assert go("translate", run, "--provider", "test_runs:SAME") == 1
    hello = Run(spark, run).read(Run(spark, run).load(), "segments").where("source = 'Hello'").first()["id"]
    assert go("confirm-passthrough", run, "--ids", hello, "--reviewer", "ann", "--reason", "a name") == 0
    assert go("confirm-passthrough", run, "--ids", hello, "--reviewer", "ann", "--reason", "another") == 1
    assert go("translate", run, "--provider", "test_runs:SAME") == go("validate", run) == go("render", run, pages) == 0
    assert go("accept", run, "--reviewer", "ann") == 1
    capsys.readouterr()
    assert go("status", run) == 0 and capsys.readouterr().out.strip() == "rendered"
    segs, done = tmp_path / "segs.jsonl", tmp_path / "done.jsonl"
    segs.write_text(json.dumps({"id": hello, "source": "Hello"}) + "\n")
    done.write_text(json.dumps({"id": hello, "source": "Hello", "target": "Hello"}) + "\n")
    assert go("validate-segments", str(segs), str(done)) == 0
    done.write_text(json.dumps({"id": hello, "source": "Hello", "target": " "}) + "\n")
    assert go("validate-segments", str(segs), str(done)) == 1
    out = tmp_path / "made.jsonl"
    assert go("translate-segments", str(segs), str(out), "--provider", "test_runs:SAME") == 0
    assert [json.loads(x) for x in out.read_text().splitlines()] == [{"id": hello, "source": "Hello", "target": "Hello"}]
    again = str(tmp_path / "again")
    page = "doc_id long, page int, media_box array<double>, crop_box array<double>, rect array<double>, images int, vectors int, text string, nonwhite double"
    box = [0.0, 0.0, 9.0, 9.0]
    spark.createDataFrame([(1, 1, box, box, box, 0, 1, "x", 1.0)], page).write.parquet(str(tmp_path / "of"))
    assert go("run", again, str(source), str(tmp_path / "of"), "--provider", "test_runs:SAME", "--renderer", "test_runs:rendered") == 0
    assert Run(spark, again).load()["status"] == "qa_generated"
    assert go("apply-vector-repair", again, str(tmp_path / "of")) == 1  # nothing is added
    spark.createDataFrame([(1, 1, box, box, box, 0, 2, "x", 1.0)], page).write.parquet(str(tmp_path / "more"))
    assert go("apply-vector-repair", again, str(tmp_path / "more")) == 0 and Run(spark, again).load()["status"] == "rendered"
    spark.createDataFrame([(1, [])], "doc_id long, violations array<string>").write.parquet(str(tmp_path / "verdict"))
    assert go("apply-text-repair", again, str(tmp_path / "of"), str(tmp_path / "verdict")) == 0
    third = str(tmp_path / "third")
    assert go("init-run", third, str(source)) == go("collect", third, str(source)) == 0
    spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 9.0, 9.0, "References"), (1, 1, 1, 0.0, 10.0, 9.0, 19.0, "one 1")], "doc_id long, page int, block_no int, x0 double, y0 double, x1 double, y1 double, text string").write.parquet(str(tmp_path / "blocks"))
    spark.createDataFrame([], "doc_id long, page int, line_no int, x1 double, top double, bottom double, page_width double, text string").write.parquet(str(tmp_path / "lines"))
    assert go("reference-review", third, str(tmp_path / "blocks"), str(tmp_path / "lines")) == 0
    assert go("translate", third, "--provider", "test_runs:SAME") == 1  # references are to be confirmed


def rendered(translations):
    box = [0.0, 0.0, 9.0, 9.0]
    return translations.sparkSession.createDataFrame([(1, 1, box, box, box, 0, 1, "x", 1.0)], "doc_id long, page int, media_box array<double>, crop_box array<double>, rect array<double>, images int, vectors int, text string, nonwhite double")


def test_batches_are_saved_as_they_come(spark, tmp_path):
    run = Run(spark, str(tmp_path / "r"))
    src = spark.createDataFrame([(i, f"line {i}") for i in range(7)], "pos long, source string")
    run.initialize(src, {})
    run.collect(src)
    log = tmp_path / "log"

    def failing(at):
        def call(request):
            sources = [x["source"] for x in json.loads(request)["segments"]]
            with log.open("a") as f:
                f.write(",".join(sources) + "\n")
            if at in sources:
                raise RuntimeError("lost")
            return echo(request)

        return BatchProvider("fails", call)

    with pytest.raises(ValueError, match="batches failed.*lost"):
        run.translate(failing("line 4"), max_segments=2, wave=1)
    assert run.read(run.load(), "translations").count() == 4 and len(log.read_text().splitlines()) == 3
    assert run.load()["status"] == "collected" and run.load()["history"][-1]["stage"] == "translate_failed"
    log.unlink()
    assert run.translate(failing("none"), max_segments=2, wave=2) == (4, 3)
    assert sorted(log.read_text().splitlines()) == ["line 4,line 5", "line 6"]


def test_runs_keep_to_their_pack_and_policy(spark, pack, tmp_path):
    run = Run(spark, str(tmp_path / "r"))
    src = spark.createDataFrame([(1, "one 1"), (2, "two 2")], "pos long, source string")
    run.initialize(src, {"source_language": "en"})
    segs = run.collect(src)
    own = files.read_pack(spark, str(pack))
    two = segs.where("pos = 2").select("id")
    with pytest.raises(ValueError, match="rejected"):
        run.translate(ColumnProvider("loses", lambda s: F.when(s == "one 1", F.lit("uno 1")).otherwise(F.lit("dos"))), own)
    with pytest.raises(ValueError, match="another target"):
        run.confirm("passthrough", segs.where("pos = 1").select("id"), "ann", "names")
    run.confirm("passthrough", two, "ann", "names")
    kept = run.load()["datasets"]["passthrough"]
    run.confirm("passthrough", two, "ann", "names")
    assert run.load()["datasets"]["passthrough"] == kept
    with pytest.raises(ValueError, match="confirmed_otherwise"):
        run.confirm("passthrough", two, "bob", "names")
    for other in ({"prompt.txt": "Other."}, {"manifest.json": json.dumps({"id": "p", "version": "1", "source_language": "fr", "target_language": "zh"})}):
        for name, text in other.items():
            (pack / name).write_text(text)
        with pytest.raises(ValueError, match="pack"):
            run.translate(SAME, files.read_pack(spark, str(pack)))
    with pytest.raises(ValueError, match="pack"):
        run.translate(SAME)
    with pytest.raises(ValueError, match="policy"):
        run.translate(SAME, own, "translate-titles")
    assert run.translate(SAME, own) == (1, 1)
    with pytest.raises(ValueError, match="pack"):
        run.validate(files.read_pack(spark, str(pack)))
    run.validate(own)
