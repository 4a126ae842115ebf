"""Regions, safety, page comparison, files, providers and runs."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from quoin.functions.text import segment_id
from quoin.operators import pagediff, regions, safety
from quoin.plans.run import Run
from quoin.provider import BatchProvider, ColumnProvider, Context, checked_endpoint, closed, request
from quoin.sources import files

HEADS = {"Reference": 1, "REFERENCES": 1, "6 Reference 353": 1, "6 References": 1, " references\n": 1, "See Reference 353": 0, "6 Reference methods 353": 0, "Reference list follows": 0, "": 0}


def test_heading_patterns(spark):
    df = spark.createDataFrame([(k,) for k in [*HEADS, "7 Figure captions", "1999 2000", "7 Figure 2"]], "t string")
    got = {r[0]: (r[1], r[2]) for r in df.select("t", regions.is_heading(F.col("t")), regions.is_section(F.col("t"))).collect()}
    assert {k: int(got[k][0]) for k in HEADS} == HEADS
    assert got["7 Figure captions"][1] and not got["1999 2000"][1] and not got["7 Figure 2"][1]


BLOCK = "doc_id long, page int, block_no int, x0 double, y0 double, x1 double, y1 double, text string"
LINE = "doc_id long, page int, line_no int, x1 double, top double, bottom double, page_width double, text string"


def test_region_and_review(spark):
    entry = "Smith, A. and Jones, B. (2019) A study of things that matter a great deal to many. Journal of Matters 12, 345-367."
    b = [(1, 0, 0, 0, 0, 1, 9, "Intro Smith"), (1, 1, 0, 0, 0, 1, 9, "before"), (1, 1, 1, 0, 10, 1, 19, "353\n6 Reference"), (1, 1, 2, 0, 20, 1, 29, "354\n" + entry), (1, 2, 0, 0, 0, 1, 9, "Other (2020) more."), (1, 2, 1, 0, 10, 1, 19, "7 Figure"), (1, 2, 2, 0, 20, 1, 29, "after"), (2, 0, 0, 0, 0, 1, 9, "References"), (2, 0, 1, 0, 10, 1, 19, "References"), (3, 0, 0, 0, 0, 1, 9, "no heading")]
    n = [(1, 1, 0, 5, 11, 12, 100, "353"), (1, 1, 1, 5, 21, 22, 100, " 354 "), (1, 2, 0, 5, 1, 2, 100, "355"), (1, 2, 1, 5, 21, 22, 100, "356"), (1, 1, 2, 50, 1, 2, 100, "9"), (1, 0, 0, 5, 1, 2, 100, "352")]
    found = regions.regions(spark.createDataFrame([tuple(map(lambda v, k: float(v) if k in (3, 4, 5, 6) else v, r, range(8))) for r in b], BLOCK), spark.createDataFrame([tuple(map(lambda v, k: float(v) if k in (3, 4, 5, 6) else v, r, range(8))) for r in n], LINE))
    rows = found.collect()
    assert len(rows) == 1 and rows[0]["heading_page"] == 1 and rows[0]["numbers"] == ["353", "354", "355"]
    assert rows[0]["region"] == "354\n" + entry + "\nOther (2020) more."
    segs = spark.createDataFrame([(1, 1, "a", entry.upper()), (1, 2, "b", "REFERENCES"), (1, 3, "c", "body text " * 12), (1, 4, "d", " ".join(reversed(entry.split()))), (2, 5, "e", entry)], "doc_id long, pos long, id string, source string")
    got = regions.review(segs, found)
    assert {r["id"]: r["automatic"] for r in got.collect()} == {"a": True, "b": True, "c": False, "d": False, "e": False}
    assert 0.8 < regions.covered_share(got).where("doc_id = 1").first()["share"] <= 1
    assert [r["id"] for r in regions.confirm(got, segs.where("id = 'd'").select("id"), "ann").orderBy("rank").collect()] == ["a", "b", "d"]
    with pytest.raises(ValueError):
        regions.confirm(got, spark.createDataFrame([("zz",)], "id string"), "ann")


def test_coverage_as_the_standard_library(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choice("abc") for _ in range(rng.randint(0, 30))), "".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for _ in range(200)]
    got = regions.coverage(spark.createDataFrame(rows, "candidate string, region string")).collect()
    for r in got:
        a, b = r["candidate"], r["region"]
        want = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) / len(a) if a and b else 0.0
        assert r["coverage"] == pytest.approx(want)


def test_split_words_and_hidden_text(spark):
    segs = spark.createDataFrame([(1, "a", "re 5 ... perio"), (1, "b", "Hello"), (1, "c", "Figure 5"), (1, "d", "{v1}"), (1, "e", "aa"), (1, "f", "(x).*")], "doc_id long, id string, source string")
    pages = spark.createDataFrame([(1, 1, "Figure 5 ...\nperiod"), (1, 2, "an aaa. (x).* end")], "doc_id long, page int, text string")
    got = {r["id"]: r for r in safety.review(segs, pages).collect()}
    assert set(got) == {"a", "b", "e"}
    s = got["a"]["splits"]
    assert (s[0]["prefix"], s[0]["suffix"], s[0]["page"], s[0]["context"]) == ("Figu", "d", 1, "Figure 5 ... period")
    assert got["b"]["kind"] == "unlocated-short-ascii-text" and got["e"]["visible"] == 2 and len(got["e"]["splits"]) == 2
    assert tuple(safety.summary(safety.review(segs, pages), segs).first()) == (2, 1, 3, 6)


def test_page_pairs(spark):
    ddl = "doc_id long, page int, media_box array<double>, crop_box array<double>, images int, vectors int, text string, nonwhite double"
    a4, letter = [0.0, 0.0, 595.0, 842.0], [0.0, 0.0, 612.0, 792.0]
    src = [(1, 1, a4, a4, 1, 3, "", 0.2), (1, 2, a4, a4, 1, 3, "", 0.2), (2, 1, a4, a4, -1, 3, "", 0.2), (3, 1, a4, a4, 0, 0, "", 0.5), (3, 2, a4, a4, 0, 0, "", 0.5)]
    out = [(1, 1, a4, a4, 1, 3, "ok", 0.2), (1, 2, letter, a4, 0, 2, "{v99} <style id=", 0.001), (2, 1, a4, a4, 0, 4, "ok", 0.2), (3, 1, a4, [0.0, 0.0, 595.05, 842.0], 0, 0, "ok", 0.5)]
    s, t = spark.createDataFrame(src, ddl), spark.createDataFrame(out, ddl)
    got = {r["doc_id"]: r["errors"] for r in pagediff.inspect(s, t).collect()}
    assert got == {1: ["2:media_box", "2:placeholders:{v99}|<style id=", "2:images_fewer", "2:vectors_fewer", "2:blank"], 3: ["0:page_count"]}
    assert {(r["doc_id"], *r["warnings"]) for r in pagediff.compare(s, t).where("size(warnings) > 0").collect()} == {(2, "images_unlisted")}


def test_missing_drawings_as_a_loop(spark):
    rng = random.Random(5)
    draw = lambda n: [(1, rng.randint(1, 2), i, [round(rng.choice([0.005, 0.0149, 2.675, 1.0]) + rng.choice([0, 1e-4]), 6), 1.0, 2.0, 3.0], 1.0) for i in range(n)]
    a, b = draw(60), draw(40)
    there = {}
    for _, p, _, box, _ in b:
        k = (p, *(round(v, 2) for v in box))
        there[k] = there.get(k, 0) + 1
    want = []
    for _, p, o, box, _ in a:
        k = (p, *(round(v, 2) for v in box))
        if there.get(k, 0):
            there[k] -= 1
        else:
            want.append(o)
    ddl = "doc_id long, page int, ord int, bbox array<double>, area double"
    assert sorted(r["ord"] for r in pagediff.missing_drawings(spark.createDataFrame(a, ddl), spark.createDataFrame(b, ddl)).collect()) == want


def test_repairs(spark):
    ddl = "doc_id long, page int, rect array<double>, text string, images int, vectors int, links int, annotations int"
    box = [0.0, 0.0, 10.0, 10.0]
    old = spark.createDataFrame([(d, p, box, "t", 1, 2, 0, 0) for d in (1, 2, 3) for p in (1, 2)], ddl)
    new = spark.createDataFrame([(1, 1, box, "t", 1, 3, 0, 0), (1, 2, box, "t", 1, 2, 0, 0), (2, 1, box, "u", 1, 3, 0, 0), (2, 2, box, "t", 1, 1, 0, 0), (3, 1, box, "t", 1, 2, 0, 0), (3, 2, box, "t", 1, 2, 0, 0)], ddl)
    assert {r["doc_id"]: r["violations"] for r in pagediff.verify_vector_repair(old, new).collect()} == {1: [], 2: ["text", "vectors_fewer"], 3: ["nothing_added"]}
    words = "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, word string"
    w0 = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 1.0, "in"), (1, 1, 5.0, 5.0, 6.0, 6.0, "out")], words)
    w1 = spark.createDataFrame([(1, 1, 0.0, 0.0, 2.0, 1.0, "new"), (1, 1, 5.001, 5.0, 6.0, 6.0, "out")], words)
    rect = spark.createDataFrame([(1, " new\ntext ")], "doc_id long, text string")
    one, two = old.where("doc_id = 1"), new.where("doc_id = 1")
    assert pagediff.verify_text_repair(one, two, w0, w1, 1, (0.0, 0.0, 3.0, 3.0), rect, "new text").first()["violations"] == []
    assert pagediff.verify_text_repair(one, two, w0, w1.withColumn("word", F.lit("z")), 1, (0.0, 0.0, 3.0, 3.0), rect, "else").first()["violations"] == ["outside_words", "replacement"]


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_bytes('﻿{"id":"x","source":"é\\n"}\r\n\n  \n{"id":"y","source":null}\n'.encode())
    got = [tuple(r) for r in files.read_jsonl(spark, str(p), "id string, source string").orderBy("pos").collect()]
    assert got == [(1, "x", "é\n"), (4, "y", None)]
    for bad in ('{"id":', '[{"id":"x"}]', "3"):
        p.write_text('{"id":"x"}\n' + bad + "\n")
        with pytest.raises(Exception):
            files.read_jsonl(spark, str(p), "id string").collect()
    out = tmp_path / "o" / "b.jsonl"
    files.export_jsonl(spark.createDataFrame([(2, "b", None), (1, "é", "x")], "pos long, id string, t string"), str(out))
    assert out.read_text(encoding="utf-8") == '{"id":"é","t":"x"}\n{"id":"b","t":null}\n'
    files.write_jsonl(spark.read.json(str(out)), str(tmp_path / "ds"))
    assert spark.read.json(str(tmp_path / "ds")).count() == 2
    import hashlib

    assert files.file_hashes(spark, str(out)).first()["sha256"] == files.sha256(out) == hashlib.sha256(out.read_bytes()).hexdigest()


def test_packs(spark, tmp_path):
    (tmp_path / "manifest.json").write_text('{"id":"p","version":"1","source_language":"en","target_language":"de"}')
    (tmp_path / "prompt.txt").write_text("do it\n")
    (tmp_path / "eval_cases.jsonl").write_text('{"source":"a","target":"b"}\n\n')
    table = tmp_path / "glossary.tsv"
    table.write_text('source\ttarget\trequired\tnote\nred "x"\trot\tTrue\t\n blue \tblau\tfalse\tn\n')
    pack = files.read_pack(spark, str(tmp_path))
    assert [(g["source"], g["required"], g["note"]) for g in pack.glossary] == [('red "x"', True, ""), ("blue", False, "n")]
    (tmp_path / "prompt.txt").write_text("do that\n")
    assert files.read_pack(spark, str(tmp_path)).identity["content_sha256"] != pack.identity["content_sha256"]
    assert files.read_pack(spark, "p", str(tmp_path.parent)).identity["id"] == "p" and [tuple(r) for r in pack.cases.collect()] == [(1, "a", "b")]
    for lost in ("p", str(tmp_path / "none")):
        with pytest.raises(ValueError):
            files.read_pack(spark, lost)
    cases = tmp_path / "eval_cases.jsonl"
    for bad in ('{"source":"a"}', '{"source":"a","target":"b","more":"c"}', '{"source":1,"target":"b"}', "x"):
        cases.write_text('{"source":"a","target":"b"}\n' + bad + "\n")
        with pytest.raises(ValueError, match="line 2"):
            files.read_pack(spark, str(tmp_path))
    cases.write_text('{"source":"a","target":"b"}\n')
    for bad in ("source\ttarget\trequired\nx\ty\ttrue\n", "source\ttarget\trequired\tnote\nSS\ty\ttrue\t\nß\tz\ttrue\t\n", "source\ttarget\trequired\tnote\nx\ty\tmaybe\t\n", "source\ttarget\trequired\tnote\nx\t\ttrue\t\n"):
        table.write_text(bad)
        with pytest.raises(ValueError):
            files.read_pack(spark, str(tmp_path))


def test_lines_are_numbered_over_splits(spark, tmp_path):
    import json

    want = [{"id": f"{i:04d}", "source": "é" * (i % 7)} for i in range(900)]
    (tmp_path / "a.jsonl").write_text("\n".join("" if i % 50 == 9 else json.dumps(r) for i, r in enumerate(want[:700])))
    (tmp_path / "b.jsonl").write_text("\r\n".join(map(json.dumps, want[700:])) + "\r\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        frame = files.read_jsonl(spark, f"{tmp_path}/*.jsonl", "id string, source string")
        assert frame.rdd.getNumPartitions() > 5
        got = [tuple(r) for r in frame.orderBy("pos").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == [(i + 1, r["id"], r["source"]) for i, r in enumerate(want) if i >= 700 or i % 50 != 9]


def test_provider_answers_close_over_their_ids(spark):
    import json

    a, b = {"id": "a", "target": "A"}, {"id": "b", "target": "B"}
    said = {
        "": [b, a], "missing: b": [a], "unexpected: c": [a, b, {"id": "c", "target": "C"}], "repeated: a": [a, b, a], "shape": [{"id": "a", "target": 1}, b], "shape ": [{**a, "more": "x"}, b], "shape  ": [{"id": "a"}, b], "shape   ": [],
    }
    rows = [(k.strip(), json.dumps({"translations": v}), None) for k, v in said.items()] + [("shape", "no json", None), ("shape", "{}", None), ("call: lost", None, "call: lost")]
    frame = spark.createDataFrame([(k, [("a",), ("b",)], x, f) for k, x, f in rows], "want string, rows array<struct<id:string>>, answer string, failure string")
    got = closed(frame).collect()
    assert [r["want"] for r in got] == [r["problem"] or "" for r in got]
    assert got[0]["targets"] == {"a": "A", "b": "B"} and all(r["targets"] is None for r in got[1:])


def test_requests_tell_the_kind_and_the_rules(spark):
    import json

    frame = spark.createDataFrame([([("a", 'say "x"', True), ("b", "y", False)],)], "rows array<struct<id:string,source:string,is_reference:boolean>>")
    told = lambda policy: json.loads(frame.select(request(F.col("rows"), Context("en", "de", policy, "Be brief.", ({"source": "red", "target": "rot", "required": True, "note": ""},)))).first()[0])
    got = told("translate-titles")
    assert got["segments"] == [{"id": "a", "kind": "reference", "source": 'say "x"'}, {"id": "b", "kind": "body", "source": "y"}]
    assert (got["source_language"], got["target_language"], got["prompt"], got["glossary"]) == ("en", "de", "Be brief.", [{"source": "red", "target": "rot"}])
    assert len(got["rules"]) == len(told("preserve")["rules"]) + 1


def test_endpoints():
    assert checked_endpoint("https://x.org/v1/") == "https://x.org/v1" and checked_endpoint("http://localhost:1/v1")
    for bad in ("http://x.org", "https://u:p@x.org", "https://x.org/?k=1", "https://x.org/#f", "ftp://x"):
        with pytest.raises(ValueError):
            checked_endpoint(bad)


def test_run_resumes_and_guards(spark, tmp_path):
    src = spark.createDataFrame([(1, "one 1"), (2, "keep me"), (3, "bad 20 °C"), (4, "one 1")], "pos long, source string")
    run = Run(spark, str(tmp_path / "r"))
    run.initialize(src, {"title": "t"})
    with pytest.raises(ValueError):
        run.initialize(src, {})
    with pytest.raises(ValueError):
        run.collect(src.limit(1))
    segs = run.collect(src)
    assert segs.count() == 3
    with pytest.raises(ValueError):
        run.collect(src)
    run.confirm("passthrough", segs.where("pos = 2").select("id"), "ann")
    broken = ColumnProvider("drops", lambda s: F.regexp_replace(s, "20 °C", "x"))
    with pytest.raises(ValueError):
        run.translate(broken)
    assert run.load()["status"] == "collected"
    seen = []

    def call(text):
        import json

        return {"translations": [{"id": x["id"], "target": x["source"] + "!"} for x in json.loads(text)["segments"]]}

    assert run.translate(BatchProvider("calls", call), max_segments=1) == (2, 1)
    assert run.translate(broken) == (3, 0) and not seen
    run.validate()
    with pytest.raises(ValueError):
        run.accept("ann")
    run.render(spark.createDataFrame([(1, 1)], "doc_id long, page int"))
    with pytest.raises(ValueError):
        run.qa(spark.createDataFrame([(1, 2)], "doc_id long, n_errors long"))
    run.qa(spark.createDataFrame([], "doc_id long, n_errors long"))
    run.accept("ann")
    assert run.load()["status"] == "accepted"
    got = {r["source"]: r["target"] for r in run.read(run.load(), "translations").collect()}
    assert got == {"one 1": "one 1", "keep me": "keep me", "bad 20 °C": "bad 20 °C!"}
    spark.createDataFrame([(9, "z", "z", "z")], "pos long, id string, source string, target string").write.mode("append").parquet(run.load()["datasets"]["translations"]["path"])
    with pytest.raises(ValueError):
        run.read(run.load(), "translations")


def test_collect_from_a_stream(spark, tmp_path):
    from quoin.streaming.collect import collect_stream

    at = tmp_path / "in"
    spark.createDataFrame([(1, "a"), (2, "a "), (3, "b")], "pos long, source string").write.parquet(str(at))
    go = lambda: collect_stream(spark.readStream.schema("pos long, source string").parquet(str(at)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    go()
    spark.createDataFrame([(4, "b"), (5, "c")], "pos long, source string").write.mode("append").parquet(str(at))
    go()
    got = spark.read.parquet(*[str(p) for p in (tmp_path / "out").glob("b*")])
    assert sorted((r["id"][:4], r["source"]) for r in got.collect()) == sorted((r["i"][:4], r["s"]) for r in spark.sql("select * from values ('a'), ('b'), ('c') as t(s)").select("s", segment_id(F.col("s")).alias("i")).collect())


def test_glyphs_boxes_and_histograms(spark):
    from quoin.functions.text import nonwhite_ratio, pixel_box

    got = pagediff.missing_glyphs(spark.createDataFrame([("a", "zaä!"), ("b", "a")], "id string, text string"), spark.createDataFrame([("a",), ("z",)], "character string"))
    assert [tuple(r) for r in got.collect()] == [("a", ["!", "ä"])]
    row = spark.sql("select array(10D,20D,30D,40D) b, array(100D,200D) p, array(200D,200D) i, transform(sequence(0,255), k -> if(k in (0, 255), 1, 0)) h").select(pixel_box(F.col("b"), F.col("p"), F.col("i")), nonwhite_ratio(F.col("h"))).first()
    assert list(row) == [[16.0, 16.0, 64.0, 44.0], 0.5]
    ops = spark.createDataFrame([(1, 1, o) for o in ("S", "f*", "re", "b")], "doc_id long, page int, op string")
    assert pagediff.paint_count(ops).first()["vectors"] == 3
