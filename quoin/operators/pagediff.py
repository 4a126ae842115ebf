"""Paired pages of a source and an output document: boxes, objects, words, drawings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions.text import collapse, rounded
from quoin.functions.tokens import page_placeholders

# How far boxes may differ, in points; the least share of non-white pixels.
BOX = 0.1
LEAST_NONWHITE = 0.01


def boxes_differ(a: Column, b: Column) -> Column:
    return F.exists(F.zip_with(a, b, lambda x, y: F.abs(x - y) > BOX), lambda d: d)


def page_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """Documents whose page counts differ."""
    a = source.groupBy("doc_id").agg(F.count("*").alias("source_pages"))
    b = target.groupBy("doc_id").agg(F.count("*").alias("target_pages"))
    return a.join(b, "doc_id", "full_outer").fillna(0).where("source_pages <> target_pages")


def bbox_key(bbox: Column) -> Column:
    return F.transform(bbox, lambda v: rounded(v, 2))


def missing_drawings(source: DataFrame, target: DataFrame) -> DataFrame:
    """source, target: doc_id, page, ord, bbox, area. Source drawings beyond as many as the target has of the same box: the first in order are matched."""
    a, b = source.withColumn("key", bbox_key(F.col("bbox"))), target.withColumn("key", bbox_key(F.col("bbox")))
    counts = b.groupBy("doc_id", "page", "key").agg(F.count("*").alias("there"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "page", "key").orderBy("ord"))
    return a.withColumn("nth", nth).join(counts, ["doc_id", "page", "key"], "left").where(F.col("nth") > F.coalesce("there", F.lit(0))).drop("nth", "there", "key")


def compare(source: DataFrame, target: DataFrame) -> DataFrame:
    """Pages: doc_id, page, media_box, crop_box, images, vectors, text (target also nonwhite). One row a page that both have, with errors in order; -1 objects means they could not be listed."""
    s = source.select("doc_id", "page", *[F.col(c).alias(f"s_{c}") for c in ("media_box", "crop_box", "images", "vectors")])
    both = s.join(target, ["doc_id", "page"])
    left = page_placeholders(F.col("text"))
    fewer = lambda c: (F.col(f"s_{c}") >= 0) & (F.col(c) < F.col(f"s_{c}"))
    errors = [
        F.when(boxes_differ(F.col("s_media_box"), F.col("media_box")), F.lit("media_box")),
        F.when(boxes_differ(F.col("s_crop_box"), F.col("crop_box")), F.lit("crop_box")),
        F.when(F.size(left) > 0, F.concat(F.lit("placeholders:"), F.array_join(left, "|"))),
        F.when(fewer("images"), F.lit("images_fewer")),
        F.when(fewer("vectors"), F.lit("vectors_fewer")),
        F.when(F.col("nonwhite") < LEAST_NONWHITE, F.lit("blank")),
    ]
    warnings = F.filter(F.array(F.when((F.col("s_images") < 0) | (F.col("images") < 0), F.lit("images_unlisted")), F.when((F.col("s_vectors") < 0) | (F.col("vectors") < 0), F.lit("vectors_unlisted"))), lambda e: e.isNotNull())
    return both.select("doc_id", "page", F.filter(F.array(*errors), lambda e: e.isNotNull()).alias("errors"), warnings.alias("warnings"), F.length("text").alias("characters"))


def inspect(source: DataFrame, target: DataFrame) -> DataFrame:
    """Per document: n_errors, errors (page:code, in page order), with differing page counts first."""
    pages = compare(source, target).select("doc_id", "page", F.posexplode("errors").alias("rule", "code"))
    counts = page_counts(source, target).select("doc_id", F.lit(0).alias("page"), F.lit(0).alias("rule"), F.lit("page_count").alias("code"))
    every = counts.unionByName(pages)
    return every.groupBy("doc_id").agg(F.count("*").alias("n_errors"), F.transform(F.sort_array(F.collect_list(F.struct("page", "rule", "code"))), lambda e: F.concat(e["page"].cast("string"), F.lit(":"), e["code"])).alias("errors"))


def paint_count(ops: DataFrame) -> DataFrame:
    """ops: doc_id, page, op. Stroke and fill operators a page."""
    return ops.groupBy("doc_id", "page").agg(F.count_if(F.col("op").isin("S", "s", "f", "F", "f*", "B", "B*", "b", "b*")).alias("vectors"))


def verify_vector_repair(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pages with rect, text, images, vectors. One row a document: violations, changed pages; a repair must add drawings somewhere and change nothing else."""
    b = before.select("doc_id", "page", *[F.col(c).alias(f"b_{c}") for c in ("rect", "text", "images", "vectors")], F.lit(1).alias("_b"))
    both = b.join(after.withColumn("_a", F.lit(1)), ["doc_id", "page"], "full_outer")
    bad = F.when(F.col("_a").isNull() | F.col("_b").isNull(), "pages").when(boxes_differ(F.col("b_rect"), F.col("rect")), "size").when(~F.col("b_text").eqNullSafe(F.col("text")), "text").when(F.col("b_images") != F.col("images"), "images").when(F.col("vectors") < F.col("b_vectors"), "vectors_fewer")
    by = both.withColumn("bad", bad).groupBy("doc_id").agg(F.sort_array(F.collect_set("bad")).alias("bad"), F.count_if(F.col("vectors") > F.col("b_vectors")).alias("changed"))
    return by.select("doc_id", F.when(F.col("changed") == 0, F.concat("bad", F.array(F.lit("nothing_added")))).otherwise(F.col("bad")).alias("violations"), "changed")


def outside_words(words: DataFrame, rect: tuple[float, float, float, float]) -> DataFrame:
    """Per document and page: the sorted words, with boxes, that do not meet rect."""
    x0, y0, x1, y1 = rect
    meets = (F.greatest(F.col("x0"), F.lit(x0)) < F.least(F.col("x1"), F.lit(x1))) & (F.greatest(F.col("y0"), F.lit(y0)) < F.least(F.col("y1"), F.lit(y1)))
    item = F.struct(*(rounded(F.col(c), 2).alias(c) for c in ("x0", "y0", "x1", "y1")), "word")
    return words.where(~meets).groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(item)).alias("signature"))


def verify_text_repair(before: DataFrame, after: DataFrame, before_words: DataFrame, after_words: DataFrame, page: int, rect: tuple[float, float, float, float], rect_text: DataFrame, replacement: str) -> DataFrame:
    """Pages with rect, text, images, vectors, links, annotations; rect_text: doc_id, text within rect afterwards. One row a document: violations."""
    names = ("rect", "text", "images", "vectors", "links", "annotations")
    b = before.select("doc_id", "page", *[F.col(c).alias(f"b_{c}") for c in names], F.lit(1).alias("_b"))
    both = b.join(after.withColumn("_a", F.lit(1)), ["doc_id", "page"], "full_outer")
    bad = F.when(F.col("_a").isNull() | F.col("_b").isNull(), "pages").when(boxes_differ(F.col("b_rect"), F.col("rect")), "size")
    for c in ("images", "links", "annotations"):
        bad = bad.when(F.col(f"b_{c}") != F.col(c), c)
    bad = bad.when(F.col("vectors") < F.col("b_vectors"), "vectors_fewer").when((F.col("page") != page) & ~F.col("b_text").eqNullSafe(F.col("text")), "other_text")
    found = both.select("doc_id", bad.alias("code"))
    x, y = outside_words(before_words.where(F.col("page") == page), rect), outside_words(after_words.where(F.col("page") == page), rect)
    outside = x.join(y.withColumnRenamed("signature", "other"), ["doc_id", "page"], "full_outer").where(~F.col("signature").eqNullSafe(F.col("other"))).select("doc_id", F.lit("outside_words").alias("code"))
    inside = rect_text.where(collapse(F.col("text")) != collapse(F.lit(replacement))).select("doc_id", F.lit("replacement").alias("code"))
    return found.unionByName(outside).unionByName(inside).groupBy("doc_id").agg(F.sort_array(F.collect_set("code")).alias("violations"))


def missing_glyphs(texts: DataFrame, glyphs: DataFrame) -> DataFrame:
    """texts: id, text; glyphs: character. Characters without a glyph, sorted, per id."""
    chars = texts.select("id", F.explode(F.array_distinct(F.split("text", ""))).alias("character")).where("character <> ''")
    return chars.join(glyphs.select("character").distinct(), "character", "left_anti").groupBy("id").agg(F.sort_array(F.collect_set("character")).alias("missing"))
