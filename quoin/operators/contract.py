"""The content contract between a source text and its target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.functions import tokens as T
from quoin.functions.text import fold, is_blank, let, segment_id

POLICIES = ("preserve", "translate-titles")
#: Fixed value: sources with so many ASCII letters need a CJK character in the target.
LONG_SOURCE = 40


def required(glossary: list[dict]) -> list[dict]:
    return [g for g in glossary if g["required"]]


def glossary_errors(source: Column, target: Column, glossary: list[dict]) -> Column:
    """Terms of a bounded glossary (a dimension held in the plan) whose required target is missing, in its order."""
    terms = required(glossary)
    if not terms:
        return F.array().cast("array<string>")
    table = F.array(*(F.struct(F.lit(g["source"]).alias("source"), F.lit(g["source"].casefold()).alias("s"), F.lit(g["target"].casefold()).alias("t")) for g in terms))
    return F.transform(F.filter(table, lambda g: F.contains(source, g["s"]) & ~F.contains(target, g["t"])), lambda g: F.concat(F.lit("glossary:"), g["source"]))


def errors(source: Column, target: Column, glossary: list[dict] | None = None, require_cjk: bool = True) -> Column:
    """Codes of all violations, in order; a blank target has exactly one."""
    # tokens are used several times and within lambdas, where each use would search the text again
    out = let(F.struct(T.protected(source).alias("s"), T.protected(target).alias("t")), lambda found: _token_errors(found["s"], found["t"]))
    if require_cjk:
        foreign = F.when(T.has_ascii_letters(source, LONG_SOURCE) & ~T.has_cjk(target), F.array(F.lit("cjk_missing"))).otherwise(F.array().cast("array<string>"))
        out = F.concat(out, foreign)
    if glossary and required(glossary):
        out = F.concat(out, let(F.struct(fold(source).alias("s"), fold(target).alias("t")), lambda folded: glossary_errors(folded["s"], folded["t"], glossary)))
    return F.when(is_blank(target), F.array(F.lit("blank"))).otherwise(out)


def _token_errors(s: Column, t: Column) -> Column:
    found = [F.when(~T.same_multiset(s[c], t[c]), F.lit(f"{c}_mismatch")) for c in ("formula", "style", "url", "doi")]
    for c in ("number", "abbreviation", "unit"):
        code = F.lit(f"{c}_missing:")
        found.append(let(F.struct(T.missing(s[c], t[c]).alias("lost"), code.alias("code")), lambda x: F.when(F.size(x["lost"]) > 0, F.concat(x["code"], F.array_join(x["lost"], "|")))))
    found.append(F.when(s["style"] != t["style"], F.lit("style_order")))
    return F.filter(F.array(*found), lambda e: e.isNotNull())


def routed_errors(source: Column, target: Column, glossary: list[dict] | None, policy: str, is_passthrough: Column, is_reference: Column) -> Column:
    """Which rule holds for a row: passthrough and preserved references must equal their source; translated references need no glossary."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy: {policy}")
    same = lambda code: F.when(source == target, F.array().cast("array<string>")).otherwise(F.array(F.lit(code)))
    reference = same("preserved_changed") if policy == "preserve" else errors(source, target)
    return F.when(is_passthrough, same("passthrough_changed")).when(is_reference, reference).otherwise(errors(source, target, glossary))


def duplicate_ids(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def closure(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Ids on one side only: (id, side: missing or unexpected)."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    whole = a.join(b, key, "full_outer").where("_l is null or _r is null")
    return whole.select(key, F.when(F.col("_r").isNull(), F.lit("missing")).otherwise(F.lit("unexpected")).alias("side"))


def unknown_ids(ids: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    return ids.select(key).distinct().join(known.select(key), key, "left_anti")


def overlap(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def flagged(rows: DataFrame, ids: DataFrame | None, name: str) -> DataFrame:
    if ids is None:
        return rows.withColumn(name, F.lit(False))
    return rows.join(ids.select("id").distinct().withColumn(name, F.lit(True)), "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def validate(segments: DataFrame, translations: DataFrame, glossary: list[dict] | None = None, references: DataFrame | None = None, passthrough: DataFrame | None = None, policy: str = "preserve") -> DataFrame:
    """(id, errors) of every violating row or id. segments: id, source; translations: id, source, target."""
    found = [duplicate_ids(segments).select("id", F.array(F.lit("duplicate_segment")).alias("errors")), duplicate_ids(translations).select("id", F.array(F.lit("duplicate_translation")).alias("errors"))]
    found.append(closure(segments, translations).select("id", F.array("side").alias("errors")))
    if passthrough is not None:
        found.append(unknown_ids(passthrough, segments).select("id", F.array(F.lit("unknown_passthrough")).alias("errors")))
        if references is not None:
            found.append(overlap(references, passthrough).select("id", F.array(F.lit("reference_and_passthrough")).alias("errors")))
    pairs = segments.select("id", "source").join(translations.select("id", F.col("source").alias("own_source"), "target"), "id")
    pairs = flagged(flagged(pairs, passthrough, "is_passthrough"), references, "is_reference")
    checks = F.concat(F.when(F.col("id") != segment_id(F.col("source")), F.array(F.lit("id"))).otherwise(F.array().cast("array<string>")), F.when(~F.col("own_source").eqNullSafe(F.col("source")), F.array(F.lit("source"))).otherwise(F.array().cast("array<string>")))
    ruled = routed_errors(F.col("source"), F.coalesce("target", F.lit("")), glossary, policy, F.col("is_passthrough"), F.col("is_reference"))
    found.append(pairs.select("id", F.when(F.size(checks) > 0, checks).otherwise(ruled).alias("errors")).where(F.size("errors") > 0))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def ensure_valid(*args, **kwargs) -> None:
    """Raises with the count and the first violations, by id."""
    bad = validate(*args, **kwargs)
    n = bad.count()
    if n:
        raise ValueError(f"{n} violations: {[(r['id'], r['errors']) for r in bad.orderBy('id').limit(12).collect()]}")


def evaluated(cases: DataFrame, glossary: list[dict] | None = None) -> DataFrame:
    """cases: pos, source, reference, target. They with errors, passed and exact; a case without a target is blank."""
    return cases.withColumn("errors", errors(F.col("source"), F.coalesce("target", F.lit("")), glossary)).withColumn("passed", F.size("errors") == 0).withColumn("exact", F.col("target").eqNullSafe(F.col("reference")))


def evaluate(cases: DataFrame, glossary: list[dict] | None = None) -> DataFrame:
    """cases: pos, source, reference, target. One row: cases, passed, failed, exact."""
    return evaluated(cases, glossary).agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count_if("exact").alias("exact"))
