"""Bibliography regions in positioned text, and which segments lie in them."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions.text import is_digits, java_heading, java_section, match_text, rounded, strip, without_line_numbers

# The margin that holds line numbers, and when a segment counts as part of the region.
MARGIN = 0.12
LEAST_CHARACTERS = 80
LEAST_COVERAGE = 0.99
#: Blocks of so many characters or more are bounded only by the end of the text.
CLIP = 12
#: Texts as match_text leaves them; their letters are 1 to 36 of 37, so that CLIP of them are a number of 63 bits.
PLAIN = re.compile("[a-z0-9]*").fullmatch
_LETTERS = np.zeros(256, np.int64)
_LETTERS[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = np.arange(1, 37)
_POWERS = np.array([37**g for g in range(CLIP)], np.int64)[:, None]


def is_heading(x: Column) -> Column:
    return x.rlike(java_heading())


def is_section(x: Column) -> Column:
    return x.rlike(java_section())


def line_numbers(lines: DataFrame) -> DataFrame:
    """lines: doc_id, page, line_no, x1, top, bottom, page_width, text. Those that are digits only, in the left margin."""
    text = strip(F.col("text"))
    return lines.withColumn("text", text).where(is_digits(F.col("text")) & (F.col("x1") <= F.col("page_width") * MARGIN))


def cleaned(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    numbers = line_numbers(lines).groupBy("doc_id", "page").agg(F.collect_set("text").alias("numbers"))
    return blocks.join(numbers, ["doc_id", "page"], "left").withColumn("clean", without_line_numbers(F.col("text"), F.coalesce("numbers", F.array().cast("array<string>"))))


def regions(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """blocks: doc_id, page, block_no, x0, y0, x1, y1, text. Of each document with exactly one heading: doc_id, heading_page, region (blocks from the heading to the next numbered section, joined by line ends), numbers (margin numbers in that stretch, in order)."""
    rows = cleaned(blocks, lines)
    heads = rows.where(is_heading(F.col("clean"))).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("page").alias("heading_page"), F.min("y1").alias("heading_bottom")).where("n = 1").drop("n")
    after = rows.join(heads, "doc_id").where("page > heading_page or (page = heading_page and y0 >= heading_bottom)")
    stop = after.where(is_section(F.col("clean"))).groupBy("doc_id").agg(F.min(F.struct("page", "block_no", "y0")).alias("stop"))
    inside = after.join(stop, "doc_id", "left").where("stop is null or page < stop.page or (page = stop.page and block_no < stop.block_no)")
    text = inside.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "block_no", "text"))), lambda b: b["text"]), "\n").alias("region"))
    numbered = line_numbers(lines).join(heads, "doc_id").join(stop, "doc_id", "left").where("page >= heading_page and (stop is null or page < stop.page or (page = stop.page and top < stop.y0))")
    numbers = numbered.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("page", "line_no", "text"))), lambda b: b["text"]).alias("numbers"))
    none = F.array().cast("array<string>")
    return heads.join(text, "doc_id", "left").join(numbers, "doc_id", "left").select("doc_id", "heading_page", F.coalesce("region", F.lit("")).alias("region"), F.coalesce("numbers", none).alias("numbers"))


def _longest(a: str, b: str, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """The longest common block, the first in a and then in b: as difflib's find_longest_match without junk, by string search."""
    at, to, size, i = alo, blo, 0, alo
    while i + size < ahi:
        j = b.find(a[i : i + size + 1], blo, bhi)
        while j >= 0:
            k = size + 1
            while i + k < ahi and j + k < bhi and a[i + k] == b[j + k]:
                k += 1
            at, to, size = i, j, k
            j = b.find(a[i : i + k + 1], j + 1, bhi) if i + k < ahi else -1
        i += 1
    return at, to, size


def _codes(x: str) -> np.ndarray:
    """The next CLIP letters from each place as a number, blanks beyond the end."""
    letters = _LETTERS[np.frombuffer(x.encode("ascii") + b" " * (CLIP - 1), np.uint8)]
    out = np.zeros(len(x), np.int64)
    for g in range(CLIP):
        out = out * 37 + letters[g : g + len(x)]
    return out


@lru_cache(maxsize=1)
def _sorted_codes(b: str) -> np.ndarray:
    """Made once a region, as its candidates come together."""
    return np.sort(_codes(b))


def _bounds(a: str, b: str) -> list[int]:
    """How long a block from each place of a can be anywhere in b: exactly, where that is less than CLIP. Its next letters agree longest with a neighbour in order."""
    codes, known = _codes(a), _sorted_codes(b)
    at, mine, left = np.searchsorted(known, codes), codes // _POWERS, np.arange(len(a), 0, -1)
    agree = [(known[np.clip(to, 0, len(known) - 1)] // _POWERS == mine).sum(axis=0) for to in (at - 1, at)]
    longest = np.maximum(*agree)
    return np.where(longest < CLIP, np.minimum(longest, left), left).tolist()


def _longest_bounded(a: str, b: str, alo: int, ahi: int, blo: int, bhi: int, most: list[int]) -> tuple[int, int, int]:
    """As _longest, but from the most promising place first, then only from places that may have a longer or an earlier block; bounds are lowered to what is found."""
    some = most[alo:ahi]
    best = max(some)
    first = alo + some.index(best)
    at, to, size = ahi, blo, 0
    for i, top in ((first, best), *enumerate(some, alo)):
        k = (size or 1) if i < at else size + 1
        if top < k or i == at or i + k > ahi:
            continue
        j = b.find(a[i : i + k], blo, bhi)
        if j < 0:
            most[i] = k - 1
            continue
        while j >= 0:
            while i + k < ahi and j + k < bhi and a[i + k] == b[j + k]:
                k += 1
            at, to, size = i, j, k
            j = b.find(a[i : i + k + 1], j + 1, bhi) if i + k < ahi and k < top else -1
        most[i] = size
        if size == best:  # no other has more, and none before has as much
            break
    return at, to, size


def _matched(candidate: str | None, region: str | None) -> float:
    """The share that the blocks of difflib.SequenceMatcher(None, candidate, region, autojunk=False) cover."""
    if not candidate or not region:
        return 0.0
    a, b, found, mid = candidate, region, 0, len(candidate) // 2
    longest, more = _longest, ()
    if len(a) >= CLIP and a[mid : mid + 2 * CLIP] not in b and PLAIN(a) and PLAIN(b):  # neither short nor with a long block, which is found without bounds
        longest, more = _longest_bounded, (_bounds(a, b),)
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        if ahi - alo == 1:
            found += b.find(a[alo], blo, bhi) >= 0
        elif bhi - blo == 1:
            found += a.find(b[blo], alo, ahi) >= 0
        else:
            i, j, k = longest(a, b, alo, ahi, blo, bhi, *more)
            found += k
            if k and alo < i and blo < j:
                todo.append((alo, i, blo, j))
            if k and i + k < ahi and j + k < bhi:
                todo.append((i + k, ahi, j + k, bhi))
    return found / len(candidate)


def coverage(pairs: DataFrame, candidate: str = "candidate", region: str = "region") -> DataFrame:
    """pairs with coverage: the share of the candidate in matching blocks, in order. Only texts of pairs that are not settled by containment go to Python."""

    @F.pandas_udf("double")
    def align(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_matched(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    known = F.when((F.col(candidate) == "") | (F.col(region) == ""), F.lit(0.0)).when(F.contains(region, F.col(candidate)), F.lit(1.0))
    rows = pairs.withColumn("_quick", known)
    rest = lambda c: F.when(F.col("_quick").isNull(), F.col(c))
    return rows.withColumn("coverage", F.coalesce("_quick", align(rest(candidate), rest(region)))).drop("_quick")


def coverage_within(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows: doc_id, candidate and others; known: doc_id, region (one a document, none is empty). rows with coverage and region_length: a document's candidates are put in one row before they meet its region, so that it is never repeated."""
    others = [c for c in rows.columns if c != "doc_id"]

    @F.pandas_udf("array<double>")
    def align(some: pd.Series, region: pd.Series) -> pd.Series:
        return pd.Series([[1.0 if a and b and a in b else _matched(a, b) for a in x] for x, b in zip(some, region, strict=True)])

    by = rows.groupBy("doc_id").agg(F.collect_list(F.struct(*others)).alias("_rows")).join(known.select("doc_id", "region"), "doc_id", "left").withColumn("region", F.coalesce("region", F.lit("")))
    by = by.withColumn("_coverage", align(F.col("_rows")["candidate"], "region")).select("doc_id", F.length("region").alias("region_length"), F.arrays_zip("_rows", "_coverage").alias("_met"))
    each = by.select("doc_id", "region_length", F.explode("_met").alias("_one"))
    return each.select("doc_id", *(F.col(f"_one._rows.{c}").alias(c) for c in others), F.col("_one._coverage").alias("coverage"), "region_length")


def review(segments: DataFrame, found: DataFrame) -> DataFrame:
    """segments: doc_id, pos, id, source; found: regions. Per segment: automatic, coverage (6 digits), matched (characters that count for the region)."""
    numbers = F.coalesce("numbers", F.array().cast("array<string>"))
    rows = segments.select("doc_id", "pos", "id", "source").join(found.select("doc_id", "numbers"), "doc_id", "left")
    got = coverage_within(rows.select("doc_id", "pos", "id", "source", match_text(F.col("source"), numbers).alias("candidate")), found.select("doc_id", match_text(F.col("region"), numbers).alias("region")))
    in_region = (F.length("candidate") >= LEAST_CHARACTERS) & (F.col("region_length") > 0) & (F.col("coverage") >= LEAST_COVERAGE)
    return got.select("doc_id", "pos", "id", "source", (is_heading(F.col("source")) | in_region).alias("automatic"), rounded(F.col("coverage"), 6).alias("coverage"), F.when(in_region, F.rint(F.length("candidate") * F.col("coverage"))).otherwise(F.lit(0.0)).alias("matched"), "region_length")


def covered_share(reviewed: DataFrame) -> DataFrame:
    """Per document: how much of its region the automatic segments account for, at most 1."""
    return reviewed.groupBy("doc_id").agg(F.when(F.max("region_length") > 0, rounded(F.least(F.sum("matched") / F.max("region_length"), F.lit(1.0)), 6)).otherwise(F.lit(0.0)).alias("share"))


def confirm(reviewed: DataFrame, requested: DataFrame, reviewer: str) -> DataFrame:
    """Automatic and requested ids, in segment order; requested ids must exist."""
    if not reviewer.strip():
        raise ValueError("reviewer must be given")
    if not requested.select("id").join(reviewed.select("id"), "id", "left_anti").isEmpty():
        raise ValueError("a requested id is unknown")
    wanted = reviewed.where("automatic").select("id").unionByName(requested.select("id")).distinct()
    return reviewed.join(wanted, "id", "left_semi").select("pos", "id", "automatic").withColumn("rank", F.row_number().over(Window.orderBy("pos")))
