"""Tokenisers, hashes and cleaning expressions; all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """A row for each newline-separated line of a text column, as `line`."""
    return df.select(*keep, F.explode(F.split(text, "\n")).alias("line"))


def words_space(line: Column) -> Column:
    """Pieces between white space, case and a leading empty piece kept, trailing empties dropped; none for a blank, non-empty line."""
    cut = F.regexp_replace(line, r"\s+$", "")
    return F.when((F.length(line) > 0) & (cut == ""), F.array().cast("array<string>")).otherwise(F.split(cut, r"\s+"))


def words_of_lines(text: Column) -> Column:
    """The pieces of `words_space` of all newline-separated lines of a text."""
    return F.flatten(F.transform(F.split(text, "\n"), words_space))


def words(text: Column) -> Column:
    """Lower-case runs of ASCII word characters."""
    return F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != "")


def words_clean(text: Column) -> Column:
    """Lower-case words after everything but a-z, 0-9 and space became a space."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "), r"\s+"), lambda w: w != "")


def words_strip(text: Column) -> Column:
    """White-space pieces in lower case without other than a-z and 0-9; a piece may become empty and stays."""
    pieces = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.transform(pieces, lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9]", ""))


def java_hash(text: Column) -> Column:
    """The 32-bit string hash s[0]*31^(n-1) + ... + s[n-1], for characters of the basic plane."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    top = F.lit(1 << 31)
    return F.aggregate(points, F.lit(0).cast("bigint"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit((1 << 32) - 1)), lambda h: F.when(h >= top, h - F.lit(1 << 32)).otherwise(h))


def java_hash_of(text: str) -> int:
    """The same on the driver."""
    h = 0
    for c in text:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def hash_u32(value: Column) -> Column:
    """A uniform number from 0 to 2^32 - 1, the same in every engine: the first 8 hex digits of the MD5 of the text."""
    return F.conv(F.substring(F.md5(value.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")


def unit_value(cell: Column) -> tuple[Column, Column]:
    """The number in a cell like `12%` or `1.5x`, and its kind: percent, factor or raw."""
    kind = F.when(cell.contains("%"), "percent").when(cell.contains("x"), "factor").otherwise("raw")
    return F.regexp_replace(cell, "[%x]", "").try_cast("double"), kind


def system_class(label: Column, marks: tuple[tuple[str, str], ...], other: str) -> Column:
    """The class of the first mark that the lower-case label contains."""
    out = None
    for mark, name in marks:
        test = F.lower(label).contains(mark)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(other)
