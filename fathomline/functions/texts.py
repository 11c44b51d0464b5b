"""Text functions as columns: lines, counts, hashes and set similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def physical_lines(text: Column) -> Column:
    """Lines by ``\\n``, so a final break adds one; an empty text has none."""
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, "\n", -1)))


def code_lines(masked: Column) -> Column:
    """Lines that hold something but white space, comments being masked before."""
    return F.size(F.filter(F.split(masked, "\n", -1), lambda x: x.rlike(r"\S")))


def text_lines(text: Column) -> Column:
    """Lines without their ends; the empty line after a final break is not one."""
    parts = F.split(text, "\n", -1)
    whole = F.when(F.endswith(text, F.lit("\n")), F.slice(parts, F.lit(1), F.size(parts) - 1)).when(text == "", F.slice(parts, 1, 0)).otherwise(parts)
    return F.transform(whole, lambda x: F.regexp_replace(x, r"\r\z", ""))


def lines(files: DataFrame, *keep: str) -> DataFrame:
    """One row per text line: path, line (from 1), line_text and the kept columns."""
    return files.select("path", *keep, F.posexplode(text_lines(F.col("text"))).alias("pos", "line_text")).select(
        "path", *keep, (F.col("pos") + 1).alias("line"), "line_text"
    )


def line_slice(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last (from 1), joined again."""
    return F.array_join(F.slice(F.split(text, "\n", -1), first, F.greatest(last - first + 1, F.lit(0))), "\n")


def overlapping_count(text: Column, pattern: str) -> Column:
    """Occurrences of a literal, overlapping ones included; none of the empty literal."""
    if not pattern:
        return F.lit(0)
    return F.regexp_count(text, F.lit("(?=" + java_quote(pattern) + ")"))


def java_quote(literal: str) -> str:
    return r"\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E"


def plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, F.lit(one)).otherwise(F.lit(many))


def trigrams(text: Column) -> Column:
    """Distinct three-character windows of the text with two blanks at either end."""
    padded = F.concat(F.lit("  "), text, F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 units of a text."""
    code = lambda c: F.ascii(c).cast("long")
    # a character beyond the basic plane counts as its two surrogates
    units = F.flatten(
        F.transform(
            F.filter(F.split(text, ""), lambda c: c != ""),
            lambda c: F.when(code(c) < 65536, F.array(code(c))).otherwise(
                F.array(F.shiftright(code(c) - 65536, 10) + 0xD800, (code(c) - 65536).bitwiseAND(F.lit(0x3FF)) + 0xDC00)
            ),
        )
    )
    step = lambda h, u: (h.bitwiseXOR(u) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(units, F.lit(2166136261).cast("long"), step)


def fraction(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), 3)
