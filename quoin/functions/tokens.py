"""Protected tokens of a text: extraction, multiset comparison. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quoin.functions.text import SPACE

# What tokens look like, which are left out, and what may trail an identifier.
FORMULA = r"\{v\d+\}"
STYLE = r"<style\s+id=['\"]\d+['\"]>|</style>"
URL = r"https?://[^\s)\]}>,;，。；：！？）】》]+"
DOI = r"\b10\.\d{4,9}/[^\s)\]}>,;，。；：！？）】》]+"
NUMBER = r"(?=[-+−\d])(?<![\dA-Za-z])[-+−]?\d+(?:[.,]\d+)?(?:[eE][-+]?\d+)?"
ABBREVIATION = r"(?=[A-Z])(?<![A-Za-z0-9])(?:[A-Z][A-Z0-9-]{1,})(?![A-Za-z0-9])"
NOT_ABBREVIATIONS = ("ABSTRACT", "KEYWORDS", "REFERENCES")
UNIT = r"(?<![A-Za-z])(?:%|°[CF]?|mm|cm|m|km|Pa|hPa|K|W\s*m-?2|g\s*C\s*m-?2(?:\s*d-?1)?|µmol\s*m-?2\s*s-?1)(?![A-Za-z])"
CJK = "[㐀-鿿]"
TRAILING = ".,;:!?。，、；：！？"
PAGE_PLACEHOLDER = r"\{v\d+\}|<style\s+id=|</style>"

CATEGORIES = ("formula", "style", "url", "doi", "number", "abbreviation", "unit")


def java(pattern: str, ignore_case: bool = False) -> str:
    """The same pattern with Unicode classes; \\s also has the four separators that Java leaves out."""
    out = pattern.replace(r"[^\s", rf"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(rf"[^[{SPACE}]", rf"[^{SPACE}")
    return f"(?{'i' * ignore_case}U){out}"


def _all(x: Column, pattern: str, ignore_case: bool = False) -> Column:
    return F.regexp_extract_all(x, F.lit(java(pattern, ignore_case)), F.lit(0))


def _bare(values: Column) -> Column:
    return F.transform(values, lambda v: F.regexp_replace(v, f"[{TRAILING}]+\\z", ""))


def tokens(x: Column, category: str) -> Column:
    """All tokens of a category, in order, repeats kept."""
    if category == "formula":
        return _all(x, FORMULA)
    if category == "style":
        return _all(x, STYLE, True)
    if category == "url":
        return _bare(_all(x, URL, True))
    if category == "doi":
        # a word character before it is a letter, a number of any kind or an underscore
        return _bare(_all(x, DOI.replace(r"\b", r"(?=1)(?<![\p{L}\p{N}_])"), True))
    if category == "number":
        return _all(x, NUMBER)
    if category == "abbreviation":
        return F.filter(_all(x, ABBREVIATION), lambda v: ~v.isin(*NOT_ABBREVIATIONS))
    if category == "unit":
        return _all(x, UNIT, True)
    raise ValueError(category)


def protected(x: Column) -> Column:
    """A struct of the seven token arrays."""
    return F.struct(*(tokens(x, c).alias(c) for c in CATEGORIES))


def counts(values: Column) -> Column:
    """Distinct tokens in order with how often each occurs: array of struct(token, n)."""
    return F.transform(F.array_distinct(values), lambda k: F.struct(k.alias("token"), F.size(F.filter(values, lambda v: v == k)).alias("n")))


def same_multiset(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def missing(a: Column, b: Column) -> Column:
    """Distinct tokens that a has oftener than b, in a's order."""
    often = lambda arr, k: F.size(F.filter(arr, lambda v: v == k))
    return F.filter(F.array_distinct(a), lambda k: often(a, k) > often(b, k))


def has_cjk(x: Column) -> Column:
    return x.rlike(CJK)


def ascii_letters(x: Column) -> Column:
    return F.regexp_count(x, F.lit("[A-Za-z]"))


def has_ascii_letters(x: Column, n: int) -> Column:
    """Whether there are n at least: looks no further than the n-th."""
    return x.rlike(rf"\A(?:[^A-Za-z]*+[A-Za-z]){{{n}}}")


def page_placeholders(x: Column, first: int = 10) -> Column:
    return F.slice(_all(x, PAGE_PLACEHOLDER, True), 1, first)
