"""Historic dates.  They stay strings of any year and compare as strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

_YEAR = r"(?<![\p{L}\p{N}_])(\d{3,4})(?![\p{L}\p{N}_])"


def _first(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def _span(a: Column, b: Column) -> Column:
    return F.struct(F.concat(a, F.lit("-01-01")).alias("start"), F.concat(b, F.lit("-12-31")).alias("end"))


def parse_date(c: Column) -> Column:
    """(start, end) by ordered rules, both NULL where none applies.

    ISO/any with a slash; years with a slash; two years around an en dash or a spaced hyphen; an ISO date; a year.
    """
    text = strip(c)
    none = F.struct(F.lit(None).cast("string").alias("start"), F.lit(None).cast("string").alias("end"))
    slash = F.split(text, "/")
    left, right = strip(F.get(slash, F.lit(0))), strip(F.get(slash, F.lit(1)))
    has_slash = F.contains(text, F.lit("/"))
    dash = F.when(F.contains(text, F.lit("–")), F.split(text, "–")).when(F.contains(text, F.lit(" - ")), F.split(text, " - "))
    a, b = _first(F.get(dash, F.lit(0)), _YEAR), _first(F.get(dash, F.lit(1)), _YEAR)
    year = _first(text, _YEAR)
    return (
        F.when(c.isNull() | c.isin("Unknown", "", "null"), none)
        .when(has_slash & left.rlike(r"^\d{4}-\d{2}-\d{2}"), F.struct(left.alias("start"), right.alias("end")))
        .when(has_slash & left.rlike(r"^\d{3,4}") & right.rlike(r"^\d{3,4}"), _span(left, right))
        .when((F.size(dash) == 2) & a.isNotNull() & b.isNotNull(), _span(a, b))
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.struct(text.alias("start"), text.alias("end")))
        .when(year.isNotNull(), _span(year, year))
        .otherwise(none)
    )


def century(start: Column) -> Column:
    """'11th century' of a date string; a three-digit year has a hyphen in its first four characters and gives NULL."""
    year = F.substring(start, 1, 4).try_cast("int")
    return F.when(year.isNotNull(), F.concat(F.floor((year - 1) / 100).cast("int") + 1, F.lit("th century")))


def extract_year(c: Column) -> Column:
    """The first four digits, if they lie in -500 to 2000."""
    year = _first(c, r"(\d{4})").try_cast("int")
    return F.when(year.between(-500, 2000), year)


def strip_zeros(c: Column) -> Column:
    bare = F.regexp_replace(c, "^0+", "")
    return F.when((F.length(c) > 4) & c.startswith("0"), F.when(bare.startswith("-"), F.concat(F.lit("0"), bare)).otherwise(bare)).otherwise(c)


def strip_zeros_range(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("/")), F.array_join(F.transform(F.split(c, "/"), strip_zeros), "/")).otherwise(strip_zeros(c))


def period_class(c: Column) -> Column:
    """By digits anywhere in a century's text."""
    return F.when(c.rlike("10|11|12"), "early_medieval").when(c.rlike("13|14|15"), "late_medieval").when(c.rlike("16|17|18"), "early_modern").otherwise("unknown")


def graph_period(c: Column) -> Column:
    """(start_year, end_year, century) of ``a/b``; NULL unless both are whole numbers."""
    parts = F.split(c, "/")
    a, b = strip(F.get(parts, F.lit(0))).try_cast("int"), strip(F.get(parts, F.lit(1))).try_cast("int")
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("start_year"), b.alias("end_year"), F.concat(F.expr("0") + F.floor(a / 100).cast("int") + 1, F.lit("th")).alias("century")))


def donation_year(c: Column) -> Column:
    return _first(c, r"(?<![\p{L}\p{N}_])((?:18|19|20)\d{2})(?![\p{L}\p{N}_])").try_cast("int")


def timestamp(c: Column) -> Column:
    return F.try_to_timestamp(c)
