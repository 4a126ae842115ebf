"""Registered queries for the contract operators, over the shared tables, and their DuckDB equivalents.

Segments are the non-blank lines of documents. Sources get placeholders, tags, numbers and abbreviations appended, and targets
follow from the first hex digit of a segment's id, since the shared texts hold few such tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.functions import tokens as T
from quoin.functions.text import fold, match_text, segment_id, strip
from quoin.operators import contract, pagediff, regions, safety, segments

GLOSSARY = [{"source": "the", "target": "DER", "required": True, "note": ""}, {"source": "Tion", "target": "que", "required": True, "note": ""}, {"source": "is", "target": "absent", "required": False, "note": ""}]
TAIL = " {v1} <style id='2'>GPP</style> 2.5 mm https://x.org/a. doi 10.1000/demo;"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark, sf_dir) -> DataFrame:
    """pos, doc_id, line_no, source of every non-blank line."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "source"))
    return rows.where(F.trim("source") != "").select((F.col("doc_id") * 1_000_000 + F.col("i") + 1).alias("pos"), "doc_id", (F.col("i") + 1).alias("line_no"), "source")


def collected(spark, sf_dir) -> DataFrame:
    return segments.collect(lines(spark, sf_dir))


def pairs(spark, sf_dir) -> DataFrame:
    """id, source with injected tokens, and a target by rule."""
    s = F.concat("source", F.lit(TAIL))
    h = F.substring("id", 1, 1)
    target = (
        F.when(h <= "3", s).when(h <= "6", F.regexp_replace(s, "[0-9]", "")).when(h == "7", F.lit("  "))
        .when(h.isin("8", "9", "a", "b"), F.concat(s, F.lit(" 中文 NEW 7"))).when(h <= "d", F.replace(s, F.lit("{v1}"), F.lit(""))).otherwise(F.replace(s, F.lit("GPP"), F.lit("gross")))
    )
    return collected(spark, sf_dir).select("id", s.alias("source"), target.alias("target"))


def seg_collect(spark, sf_dir):
    return collected(spark, sf_dir).select("id", "pos", F.sha2("source", 256).alias("raw_sha"))


def seg_dup_count(spark, sf_dir):
    rows = lines(spark, sf_dir).select(segment_id(F.col("source")).alias("id"))
    return contract.duplicate_ids(rows).agg(F.count("*").alias("ids"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in_them"))


def _tokens(spark, sf_dir, category):
    d = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text"), category).alias("t"))
    return d.where(F.size("t") > 0).select("doc_id", F.size("t").alias("n"), F.array_join("t", "|").alias("found"))


def tok_number(spark, sf_dir):
    return _tokens(spark, sf_dir, "number")


def tok_abbreviation(spark, sf_dir):
    return _tokens(spark, sf_dir, "abbreviation")


def tok_unit(spark, sf_dir):
    return _tokens(spark, sf_dir, "unit")


def tok_formula_style(spark, sf_dir):
    p = pairs(spark, sf_dir).where("target <> '  '")
    return p.select("id", F.array_join(T.tokens(F.col("target"), "formula"), "|").alias("formula"), F.array_join(T.tokens(F.col("target"), "style"), "|").alias("style"), F.array_join(T.tokens(F.col("target"), "doi"), "|").alias("doi"))


def tok_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(T.tokens(F.concat(F.lit("see "), F.col("url"), F.lit(").")), "url"), "|").alias("found"))


def token_counts(spark, sf_dir):
    p = pairs(spark, sf_dir).select(F.explode(T.counts(T.tokens(F.col("source"), "number"))).alias("c"))
    return p.groupBy(F.col("c.token").alias("token")).agg(F.sum("c.n").cast("long").alias("n"))


def contract_errors(spark, sf_dir):
    return pairs(spark, sf_dir).select("id", F.array_join(contract.errors(F.col("source"), F.col("target")), ",").alias("errors"))


def contract_summary(spark, sf_dir):
    e = contract.errors(F.col("source"), F.col("target"))
    each = pairs(spark, sf_dir).select(F.explode(F.when(F.size(e) == 0, F.array(F.lit("clean"))).otherwise(e)).alias("e"))
    return each.groupBy(F.split("e", ":")[0].alias("code")).agg(F.count("*").alias("n"))


def contract_summary_all(spark, sf_dir):
    """With a glossary."""
    e = pairs(spark, sf_dir).select(F.explode(contract.errors(F.col("source"), F.col("target"), GLOSSARY)).alias("e"))
    return e.groupBy(F.split("e", ":")[0].alias("code")).agg(F.count("*").alias("n"))


def multiset_missing(spark, sf_dir):
    p = pairs(spark, sf_dir)
    side = lambda c: p.select("id", F.explode(T.tokens(F.col(c), "number")).alias("token"))
    return side("source").exceptAll(side("target")).groupBy("token").agg(F.count("*").alias("n"))


def glossary_violations(spark, sf_dir):
    got = pairs(spark, sf_dir).select("id", F.explode(contract.glossary_errors(fold(F.col("source")), fold(F.col("target")), GLOSSARY)).alias("e"))
    return got.select("id", F.substring("e", 10, 99).alias("term"))


def id_closure(spark, sf_dir):
    s = collected(spark, sf_dir).select("id")
    return contract.closure(s.where("id < 'd'"), s.where("id > '3'"))


def validate_rows(spark, sf_dir):
    """Every code of every row: missing, unexpected, repeated, unknown and overlapping ids, changed sources, and the contract."""
    s = collected(spark, sf_dir).select("id", "source")
    t = s.where("id > '1'").select("id", F.when(F.col("id") > "e", F.concat("source", F.lit("!"))).otherwise(F.col("source")).alias("own"), F.when(F.col("id").between("58", "68"), F.concat("source", F.lit(" 7 中"))).otherwise(F.col("source")).alias("target")).withColumnRenamed("own", "source")
    more = s.where("id between 'c0' and 'c8'").select("id", "source", F.col("source").alias("target"))
    t = t.unionByName(more).unionByName(more.limit(0).unionByName(spark.createDataFrame([("zz", "z", "z")], "id string, source string, target string")))
    through = s.where("id between '5c' and '7'").select("id").unionByName(spark.createDataFrame([("none",)], "id string"))
    bad = contract.validate(s, t, None, s.where("id between '3' and '60'").select("id"), through)
    return bad.select("id", F.explode("errors").alias("code"))


def lookup_targets(spark, sf_dir):
    s = collected(spark, sf_dir)
    t = s.where("id < '8'").select("pos", "id", F.concat(F.lit("T:"), F.substring("id", 1, 6)).alias("target"))
    t = t.unionByName(s.where("id < '4'").select((F.col("pos") + 1_000_000_000_000).alias("pos"), "id", F.lit("later").alias("target")))
    return segments.lookup(lines(spark, sf_dir).select("pos", "source"), t).select("pos", "target")


def batches(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("pos"), F.col("n_chars").alias("size"))
    got = segments.batches(d, 12, 30_000, ["source"])
    return got.select("source", F.col("pos").alias("doc_id"), "batch")


def resume_pending(spark, sf_dir):
    s = collected(spark, sf_dir)
    states = segments.states(s, s.where("id < '5'").select("id"), s.where("id between '4' and '9'").select("id"))
    return states.agg(*(F.count_if(F.col("state") == x).alias(x) for x in ("reused", "preserved", "pending")))


def passthrough_confirm(spark, sf_dir):
    s = collected(spark, sf_dir)
    entries = s.where("id < '08'").select(F.row_number().over(_by("id")).cast("long").alias("pos"), "id", F.lit("names").alias("reason"), F.lit("ann").alias("confirmed_by"))
    new, bad = segments.confirm_passthrough(entries, s.where("id between '06' and '0c'").select("id"), s, "names", "ann")
    return new.select("pos", "id")


def _by(c):
    from pyspark.sql import Window

    return Window.orderBy(c)


def split_word_scan(spark, sf_dir):
    """Every line, without outer white space, of every document, where its letters go on in the document's text: one row a split."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    segs = lines(spark, sf_dir).select("doc_id", strip(F.col("source")).alias("source")).distinct().select("doc_id", segment_id(F.col("source")).alias("id"), "source")
    got = safety.review(segs, d)
    return got.select("doc_id", "id", "kind", "visible", F.explode_outer("splits").alias("s")).select("doc_id", "id", "kind", "visible", *(F.col(f"s.{c}").alias(c) for c in ("i", "prefix", "suffix", "context")))


def _coverage_pairs(spark, sf_dir):
    """Every non-blank line, and each document's text, normalised once."""
    d = table(spark, sf_dir, "documents").select("doc_id", match_text(F.col("text")).alias("region"))
    return lines(spark, sf_dir).select("doc_id", "pos", match_text(F.col("source")).alias("candidate")), d


def coverage_fastpath(spark, sf_dir):
    """Every line against the text it is from."""
    got = regions.coverage_within(*_coverage_pairs(spark, sf_dir))
    return got.select("doc_id", "pos", F.length("candidate").alias("n"), F.col("region_length").alias("m"), "coverage")


def coverage_full(spark, sf_dir):
    """Whole texts, every line; the two letters in front send pairs to the aligner that would be contained."""
    p, d = _coverage_pairs(spark, sf_dir)
    return regions.coverage_within(p.withColumn("candidate", F.concat(F.lit("zq"), "candidate")), d).select("doc_id", "pos", "coverage")


def blocks(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Lines as blocks, 8 a page, with a heading after the fifth line and a section after the twentieth."""
    rows = lines(spark, sf_dir).withColumn("n", F.col("line_no"))
    text = F.when(F.col("n") == 5, "6 References").when(F.col("n") == 20, "7 Figures").otherwise(F.col("source"))
    b = rows.select("doc_id", F.floor((F.col("n") - 1) / 8).cast("int").alias("page"), F.pmod(F.col("n") - 1, F.lit(8)).cast("int").alias("block_no"), F.lit(0.0).alias("x0"), (F.pmod(F.col("n") - 1, F.lit(8)) * 10.0).alias("y0"), F.lit(100.0).alias("x1"), (F.pmod(F.col("n") - 1, F.lit(8)) * 10.0 + 9).alias("y1"), text.alias("text"))
    margin = b.select("doc_id", "page", F.col("block_no").alias("line_no"), F.lit(5.0).alias("x1"), F.col("y0").alias("top"), F.col("y1").alias("bottom"), F.lit(100.0).alias("page_width"), (F.col("page") * 8 + F.col("block_no")).cast("string").alias("text"))
    return b, margin


def region_slice(spark, sf_dir):
    got = regions.regions(*blocks(spark, sf_dir))
    return got.select("doc_id", "heading_page", F.length("region").alias("characters"), F.size("numbers").alias("numbers"), F.sha2("region", 256).alias("sha"))


def region_review(spark, sf_dir):
    b, margin = blocks(spark, sf_dir)
    s = lines(spark, sf_dir).select("doc_id", "pos", F.lit("x").alias("id"), "source")
    return regions.review(s, regions.regions(b, margin)).select("doc_id", "pos", "automatic", "coverage")


def _pages(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    page = li.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page")).agg(F.min("l_quantity").alias("q"), F.min("l_discount").alias("d"), F.min("l_tax").alias("t"), F.count("*").cast("int").alias("n"))
    zero = F.lit(0.0)
    a = page.select("doc_id", "page", F.array(zero, zero, F.col("q"), F.lit(9.0)).alias("media_box"), F.array(zero, zero, F.col("q"), F.lit(9.0)).alias("crop_box"), F.col("n").alias("images"), (F.col("n") + 3).alias("vectors"), F.lit("").alias("text"))
    b = page.select("doc_id", "page", F.array(zero, zero, F.col("q") + F.col("d") * 2, F.lit(9.0)).alias("media_box"), F.array(zero, zero, F.col("q"), F.lit(9.0)).alias("crop_box"), F.col("n").alias("images"), (F.col("n") + F.when(F.col("t") > 0.06, 2).otherwise(3)).cast("int").alias("vectors"), F.when(F.col("t") == 0, F.lit("see {v9} </STYLE>")).otherwise(F.lit("ok")).alias("text"), (F.col("t") + 0.005).alias("nonwhite"))
    return a, b.where("not (page = 3 and doc_id % 2 = 0)")


def page_pair_diff(spark, sf_dir):
    got = pagediff.inspect(*_pages(spark, sf_dir))
    return got.select("doc_id", "n_errors", F.array_join("errors", ",").alias("errors"))


def _drawings(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.min("l_discount").alias("d"), F.min("l_tax").alias("t"))
    bbox = F.array(F.col("d") * 1.005, F.col("t") * 1.005, F.col("d") * 10.015, F.lit(1.0))
    return li.select(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.col("l_orderkey").alias("ord"), bbox.alias("bbox"), F.col("d").alias("area"))


def missing_drawings(spark, sf_dir):
    a = _drawings(spark, sf_dir)
    return pagediff.missing_drawings(a, a.where("ord % 5 <> 0")).select("doc_id", "page", "ord")


def vector_repair(spark, sf_dir):
    a, b = _pages(spark, sf_dir)
    change = b.select("doc_id", "page", F.col("crop_box").alias("rect"), F.lit("").alias("text"), "images", "vectors")
    return pagediff.verify_vector_repair(a.select("doc_id", "page", F.col("crop_box").alias("rect"), "text", "images", "vectors"), change.withColumn("vectors", F.col("vectors") + F.when(F.col("page") == 2, 2).otherwise(0))).select("doc_id", F.array_join("violations", ",").alias("violations"), "changed")


def outside_words(spark, sf_dir):
    w = _drawings(spark, sf_dir).select("doc_id", "page", F.col("bbox")[0].alias("x0"), F.col("bbox")[1].alias("y0"), (F.col("bbox")[0] + 0.02).alias("x1"), (F.col("bbox")[1] + 0.02).alias("y1"), F.col("ord").cast("string").alias("word"))
    got = pagediff.outside_words(w, (0.0, 0.0, 0.05, 0.04))
    return got.select("doc_id", "page", F.size("signature").alias("n"), F.col("signature")[0]["x0"].alias("x0"), F.col("signature")[0]["word"].alias("word"))


def missing_glyphs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    have = spark.createDataFrame([(chr(c),) for c in range(32, 127)], "character string")
    got = pagediff.missing_glyphs(d.select(F.col("doc_id").alias("id"), "text"), have)
    return got.select(F.col("id").alias("doc_id"), F.array_join("missing", "").alias("missing"))


def _cases(spark, sf_dir):
    return pairs(spark, sf_dir).select(F.col("id").alias("pos"), "source", F.col("source").alias("reference"), "target")


def eval_report(spark, sf_dir):
    return contract.evaluate(_cases(spark, sf_dir))


def eval_cases(spark, sf_dir):
    """The same, one row a case."""
    got = contract.evaluated(_cases(spark, sf_dir))
    return got.select(F.col("pos").alias("id"), F.array_join("errors", ",").alias("errors"), "passed", "exact")


REGISTERED = (seg_collect, seg_dup_count, tok_number, tok_abbreviation, tok_unit, tok_formula_style, tok_url, token_counts, contract_errors, contract_summary, contract_summary_all, multiset_missing, glossary_violations, id_closure, validate_rows, lookup_targets, batches, resume_pending, passthrough_confirm, split_word_scan, coverage_fastpath, coverage_full, region_slice, region_review, page_pair_diff, missing_drawings, vector_repair, outside_words, missing_glyphs, eval_report, eval_cases)


def queries() -> dict:
    return {f.__name__: f for f in REGISTERED}
