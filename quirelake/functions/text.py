"""String expressions; everything is a Column unless it says that it is a pandas UDF."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def strip(c: Column) -> Column:
    """All white space off both ends, not only spaces."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def strip_set(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def normalise_space(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def words(c: Column) -> Column:
    """White-space tokens, empty ones dropped."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def multi_replace(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other."""
    return reduce(lambda out, p: F.replace(out, F.lit(p[0]), F.lit(p[1])), pairs, c)


def truncate(c: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def nonempty(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def not_blank(c: Column) -> Column:
    return c.isNotNull() & (strip(c) != "")


def contains_any(c: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in parts])


def clean_popup(c: Column) -> Column:
    """Control characters but tab and line ends out, quotes as entities, CRLF to LF, runs of blanks to one, stripped."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    c = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), r"[ \t]+", " ")
    c = F.replace(F.replace(c, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#39;"))
    return strip(c)


def direction(c: Column) -> Column:
    """'rtl' where a Hebrew or Arabic letter occurs."""
    return F.when(c.rlike("[֐-׿؀-ۿݐ-ݿ]"), "rtl").otherwise("ltr")


def hebrew_letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^֐-׿]", ""))


def title_case(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def roman_to_int(c: Column) -> Column:
    """Subtractive Roman numerals read from the right; NULL for anything else."""
    upper = F.upper(strip(c))
    value = lambda x: F.when(x == "I", 1).when(x == "V", 5).when(x == "X", 10).when(x == "L", 50).when(x == "C", 100).when(x == "D", 500).otherwise(1000)
    total = F.aggregate(
        F.reverse(F.split(upper, "")),
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("last")),
        lambda s, x: F.struct((s["total"] + F.when(value(x) < s["last"], -value(x)).otherwise(value(x))).alias("total"), value(x).alias("last")),
        lambda s: s["total"],
    )
    return F.when(upper.rlike("^[IVXLCDM]+$"), total)


def page_number(c: Column) -> Column:
    """(number, label): digits, else a Roman numeral, else 0 with the text as label."""
    text = strip(c)
    number = F.when(text.rlike("^[0-9]+$"), text.try_cast("int")).otherwise(roman_to_int(text))
    return F.struct(F.coalesce(number, F.lit(0)).alias("number"), F.when(number.isNull(), text).alias("label"))


def page_doc_id(stem: Column, number: Column, label: Column | None = None) -> Column:
    """``stem_p007``; a page without a number is named by its label, blanks as underscores."""
    named = F.format_string("%s_p%03d", stem, number)
    if label is None:
        return named
    return F.when((number == 0) & label.isNotNull(), F.concat(stem, F.lit("_p"), F.replace(label, F.lit(" "), F.lit("_")))).otherwise(named)


def file_page_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?i)page[_-](\d+)", 1), F.lit("")).try_cast("int")


def fenced_json(c: Column) -> Column:
    """The body of a ```json or ``` block, else the text itself."""
    body = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return strip(F.when(body != "", body).otherwise(c))


def editor_name(c: Column) -> Column:
    return F.replace(c, F.lit("Editor: "), F.lit(""))


def widest_image(urls: Column) -> Column:
    """Of IIIF addresses the one with the largest ``/W,/`` size."""
    width = lambda u: F.coalesce(F.nullif(F.regexp_extract(u, r"/(\d+),/", 1), F.lit("")).try_cast("int"), F.lit(-1))
    return F.element_at(F.array_sort(urls, lambda a, b: width(b) - width(a)), 1)


def directory_name(c: Column) -> Column:
    """A model name as a folder name."""
    return F.regexp_replace(F.translate(c, "/:. ", "____"), r"[^A-Za-z0-9_-]", "")


def prompt(template: str, *columns: Column) -> Column:
    return F.format_string(template, *columns)


@F.pandas_udf(StringType())
def ascii_fold(s: pd.Series) -> pd.Series:
    """Latin letters without their combining marks; other scripts keep theirs."""

    def fold(x: str | None) -> str | None:
        if x is None or x.isascii():
            return x
        out = []
        for ch in x:
            parts = unicodedata.normalize("NFKD", ch)
            out.append("".join(p for p in parts if not unicodedata.combining(p)) if parts[0].isascii() else ch)
        return "".join(out)

    return s.map(fold, na_action="ignore")


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def hebrew_normalise(c: Column) -> Column:
    """NFKC, points and accents out, what is not Hebrew to a space."""
    return strip(F.regexp_replace(F.regexp_replace(nfkc(c), "[֑-ׇ]", ""), "[^֐-׿]+", " "))
