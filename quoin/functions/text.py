"""Column functions on text: identity, white space, case folding, rounding. All native expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space, as a class body for Java patterns.
SPACE = r"\s\x1c-\x1f"
#: Characters at which lines end.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


#: The same characters, one by one.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def let(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x), with x made once however often it is used there."""
    return F.transform(F.array(x), then)[0]


def strip(x: Column) -> Column:
    """Only texts that begin or end with white space are searched for it."""
    outer = F.contains(F.lit(SPACES), F.substring(x, 1, 1)) | F.contains(F.lit(SPACES), F.substring(x, -1, 1))
    return F.when(outer, F.regexp_replace(x, rf"(?U)\A[{SPACE}]+|[{SPACE}]+\z", "")).otherwise(x)


def normalize_text(x: Column) -> Column:
    """One kind of line end, no outer white space."""
    return strip(F.replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))


def segment_id(x: Column) -> Column:
    """SHA-256 of the normalised text, in hex."""
    return F.sha2(normalize_text(x), 256)


def collapse(x: Column) -> Column:
    """Runs of white space become one space."""
    return strip(F.regexp_replace(x, rf"(?U)[{SPACE}]+", " "))


def is_blank(x: Column) -> Column:
    return strip(x) == ""


@lru_cache(maxsize=1)
def _foldings() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    one, to, many = [], [], []
    for c in map(chr, range(sys.maxunicode + 1)):
        if (f := c.casefold()) != c:
            if len(f) == 1:
                one.append(c)
                to.append(f)
            else:
                many.append((c, f))
    return "".join(one), "".join(to), tuple(many)


def _is_odd(c: str) -> bool:
    """Whether a character's folding may not be its lower case, in any locale of the JVM and any later version of Unicode."""
    if c <= "\u052f":
        return c.casefold() != c.lower() or len(c.lower()) > 1 or c in "ΣÌÍĨ" or unicodedata.category(c) in ("Mn", "Cn")
    return c.casefold() != c or c.lower() != c or unicodedata.category(c) == "Cn"


@lru_cache(maxsize=1)
def _odd() -> str:
    """A class of all odd characters but ß; beyond U+052F near ones are joined to one range."""
    ranges: list[list[int]] = []
    for c in range(0x80, sys.maxunicode + 1):
        if chr(c) != "ß" and _is_odd(chr(c)):
            if ranges and c - ranges[-1][1] <= (1 if c <= 0x52F else 96):
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return r"[[^\x00-\x7f]&&[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]]"


def fold(x: Column) -> Column:
    """Full Unicode case folding, by str.casefold: lower case with ß as ss, but for texts with odd characters."""
    return F.when(~x.rlike(_odd()), F.replace(F.lower(F.replace(x, F.lit("I"), F.lit("i"))), F.lit("ß"), F.lit("ss"))).otherwise(_fold_odd(x))


def _fold_odd(x: Column) -> Column:
    """The table comes from str.casefold. Of the characters that fold to several, only those that a text has are replaced."""
    one, to, many = _foldings()
    several = "[" + "".join(c for c, _ in many) + "]"
    table = F.create_map(*(F.lit(y) for pair in many for y in pair))
    found = F.array_distinct(F.regexp_extract_all(x, F.lit(several), F.lit(0)))
    out = F.aggregate(found, F.translate(x, one, to), lambda acc, c: F.replace(acc, c, table[c]))
    return F.when(~x.rlike(several), F.translate(x, one, to)).otherwise(out)


def match_text(x: Column, ignored: Column | None = None) -> Column:
    """For comparison with a region: placeholders gone, folded, letters a-z and digits only, then each ignored token removed in turn."""
    kept = F.regexp_replace(fold(F.regexp_replace(x, r"(?iU)\{v\d+\}", "")), "[^a-z0-9]+", "")
    if ignored is None:
        return kept
    return F.aggregate(F.transform(ignored, fold), kept, lambda acc, k: F.when(k == "", acc).otherwise(F.replace(acc, k, F.lit(""))))


def lines(x: Column) -> Column:
    return F.split(x, LINE_ENDS)


def without_line_numbers(x: Column, numbers: Column) -> Column:
    """Lines stripped and joined by spaces, without blank ones and known line numbers."""
    stripped = F.transform(lines(x), strip)
    return F.array_join(F.filter(stripped, lambda s: (s != "") & ~F.array_contains(numbers, s)), " ")


def rounded(x: Column, digits: int) -> Column:
    """Rounded from the exact binary value, halves to even: as Python rounds."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits)).cast("double")


def spaces_pattern(body: str) -> str:
    return body.replace(r"\s", f"[{SPACE}]")


@lru_cache(maxsize=1)
def digit_class() -> str:
    """All characters that str.isdigit admits, as a class."""
    found = [c for c in range(sys.maxunicode + 1) if chr(c).isdigit()]
    parts, start = [], found[0]
    for a, b in zip(found, [*found[1:], -1], strict=True):
        if b != a + 1:
            parts.append(f"\\x{{{start:x}}}-\\x{{{a:x}}}")
            start = b
    return f"[{''.join(parts)}]"


def is_digits(x: Column) -> Column:
    return x.rlike(rf"\A{digit_class()}+\z")


def pixel_box(bbox: Column, page: Column, image: Column, margin: int = 4) -> Column:
    """A page box (x0, y0, x1, y1) in the pixels of an image of size (width, height), widened by a margin."""
    sx, sy = image[0] / page[0], image[1] / page[1]
    return F.when((page[0] > 0) & (page[1] > 0), F.array(bbox[0] * sx - margin, bbox[1] * sy - margin, bbox[2] * sx + margin, bbox[3] * sy + margin))


def nonwhite_ratio(histogram: Column, white: int = 248) -> Column:
    """Share of pixels darker than `white`, from a histogram of 256 grey values."""
    total = F.aggregate(histogram, F.lit(0).cast("double"), lambda a, v: a + v)
    bright = F.aggregate(F.slice(histogram, white + 1, 256 - white), F.lit(0).cast("double"), lambda a, v: a + v)
    return F.when(total > 0, 1 - bright / total)


# What headings look like.
HEADING = r"^\s*(?:\d+\s+)?REFERENCES?(?:\s+\d+)?\s*$"
SECTION = r"^\s*\d+\s+[A-Za-z][A-Za-z ]{0,80}\s*$"


def whole(pattern: str) -> str:
    """A Java pattern that must match the whole text, ignoring case."""
    return r"(?iU)\A" + spaces_pattern(pattern.strip("^$")) + r"\z"


def java_heading() -> str:
    return whole(HEADING)


def java_section() -> str:
    return whole(SECTION)
