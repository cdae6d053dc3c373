"""Expressions that derive the fields of a document record.

Ordered dictionaries are ARRAY<STRUCT<k,v>>, since first and last matches depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dates, fixed_values
from .text import contains_any, nonempty, not_blank, strip, strip_set

NO_DESCRIPTION = "No description available"


def _key_has(*parts: str):
    return lambda e: reduce(lambda a, b: a | b, [F.contains(F.lower(e["k"]), F.lit(p)) for p in parts])


def first_value(kv: Column, *parts: str) -> Column:
    """Value of the first entry whose key contains one of the parts and whose value is not empty."""
    return F.get(F.filter(kv, lambda e: _key_has(*parts)(e) & nonempty(e["v"])), F.lit(0))["v"]


def last_value(kv: Column, part: str, *earlier: str) -> Column:
    """Value of the last entry whose key contains ``part`` and none of the parts that an earlier branch takes."""
    fits = lambda e: _key_has(part)(e) & nonempty(e["v"]) & (~_key_has(*earlier)(e) if earlier else F.lit(True))
    return F.try_element_at(F.filter(kv, fits), F.lit(-1))["v"]


def number_in(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\d.]", "").try_cast("double")


def completeness(*, description: Column, has_id: Column, has_date: Column, transcriptions: Column, lines: Column, translations: Column, images: Column, category: Column, language: Column, relations: Column, notes: Column, url: Column) -> Column:
    """Twelve weighted tests over ten, at most one; counts are sizes, ``lines`` the non-empty transcription lines."""
    point = lambda test, weight: F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    total = (
        point(F.length(strip(description)) > 10, 1.0)
        + point(has_id, 1.0)
        + point(has_date, 1.0)
        + point(transcriptions > 0, 2.0)
        + point((transcriptions > 0) & (lines > 10), 0.5)
        + point(translations > 0, 1.0)
        + point(images > 0, 1.0)
        + point(nonempty(category), 1.0)
        + point(nonempty(language) & (language != "Unknown"), 0.5)
        + point(relations > 0, 0.5)
        + point(nonempty(notes), 0.5)
        + point(nonempty(url), 0.5)
    )
    return F.least(total / 10, F.lit(1.0))


def quality_bucket(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.6, "medium").when(score >= 0.4, "low").otherwise("minimal")


def metadata_quality(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.6, "medium").otherwise("low")


def _classes(c: Column, classes: list[tuple[str, list[str]]]) -> Column:
    return reduce(lambda out, x: out.when(contains_any(c, x[1]), x[0]), classes[1:], F.when(contains_any(c, classes[0][1]), classes[0][0]))


def document_type(description: Column, category: Column | None = None, summary: Column | None = None) -> Column:
    """The category, else the first keyword class of the description, else of the summary."""
    found = let(F.lower(description), lambda c: _classes(c, fixed_values.TYPE_KEYWORDS))
    if summary is not None:
        found = F.coalesce(found, _classes(F.lower(summary), [(x, [x]) for x in fixed_values.SUMMARY_TYPES]))
    return found if category is None else F.coalesce(F.nullif(category, F.lit("")), found)


def title_type(title: Column) -> Column:
    return _classes(F.lower(title), fixed_values.TITLE_KEYWORDS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: expressions are trees, and a use of one is a copy of it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def shelf_mark_for_match(mark: Column) -> Column:
    """Ordered rewrites, then the lettered series."""
    text = strip(mark)
    for old, new in fixed_values.SHELF_MARK_REWRITES:
        text = F.replace(text, F.lit(old), F.lit(new))
    letters = "".join(fixed_values.SERIES_LETTERS)

    def series(t: Column) -> Column:
        letter = F.regexp_extract(t, f"^Manchester(?:[^:]*:\\s*)([{letters}]) ", 1)
        return F.when(t.rlike("^Manchester[: ]") & (letter != ""), F.concat(F.lit("Gaster "), letter)).otherwise(t)

    return let(text, series)


def paris_series(mark: Column) -> Column:
    rest = strip_set(F.replace(F.replace(strip(mark), F.lit("Paris"), F.lit("")), F.lit("AIU"), F.lit("")), " ,:")
    roman = F.regexp_extract(rest, "^([IVX]+)", 1)
    return F.when(roman != "", F.concat(F.lit("Series "), roman))


def shelf_mark_mapping(mark: Column, prefixes: list[tuple] | None = None, paris_collection: str | None = None) -> Column:
    """(institution, collection, sub_collection): the longest prefix wins; Paris marks are filled first."""
    rows = sorted(prefixes or fixed_values.SHELF_MARK_PREFIXES, key=lambda r: -len(r[0]))
    text = lambda x: F.lit(x).cast("string")
    names = ("prefix", "institution", "collection", "sub_collection")
    table = F.array(*[F.struct(*[text(v).alias(n) for n, v in zip(names, r)]) for r in rows])
    found = let(shelf_mark_for_match(mark), lambda c: F.get(F.filter(table, lambda e: F.startswith(c, e["prefix"])), F.lit(0)))
    paris = F.contains(mark, F.lit("Paris")) | F.contains(mark, F.lit("AIU"))
    return let(
        found,
        lambda f: F.struct(
            F.when(paris, text(fixed_values.PARIS_INSTITUTION)).otherwise(f["institution"]).alias("institution"),
            F.coalesce(F.when(paris, text(paris_collection)), f["collection"]).alias("collection"),
            F.coalesce(F.when(paris, paris_series(mark)), f["sub_collection"]).alias("sub_collection"),
        ),
    )


def source_format(kv: Column, relations: Column) -> Column:
    """By a namespaced key; else by related people, places or works."""
    tei = F.exists(F.coalesce(kv, F.array().cast("array<struct<k:string,v:string>>")), lambda e: F.contains(e["k"], F.lit("tei-c.org")))
    return F.when(tei, "cambridge").when(relations > 0, "princeton").otherwise("cambridge")


def temporal_info(date: Column, kv: Column) -> Column:
    """(date_start, date_end, date_display, date_certainty, century) of the date fields and the metadata."""
    candidates = F.transform(F.array(*[F.lit(k) for k in ("datetime_attr", "standard_date", "hebrew_date")]), lambda k: F.get(F.filter(date, lambda e: e["k"] == k), F.lit(0))["v"])
    parsed = F.transform(candidates, lambda v: F.struct(v.alias("v"), dates.parse_date(v).alias("p")))
    own = F.get(F.filter(parsed, lambda x: x["p"]["start"].isNotNull() | x["p"]["end"].isNotNull()), F.lit(0))
    tei = F.transform(F.filter(kv, _key_has("date")), lambda e: dates.parse_date(e["v"]))
    tei = F.get(F.filter(tei, lambda p: p["start"].isNotNull() | p["end"].isNotNull()), F.lit(0))

    def info(x: Column) -> Column:
        own, tei = x["own"], x["tei"]
        start = F.when(tei.isNotNull(), tei["start"]).otherwise(own["p"]["start"])
        return F.struct(
            start.alias("date_start"),
            F.when(tei.isNotNull(), tei["end"]).otherwise(own["p"]["end"]).alias("date_end"),
            own["v"].alias("date_display"),
            F.when(tei.isNotNull(), "high").when(own.isNotNull(), "probable").otherwise("uncertain").alias("date_certainty"),
            dates.century(start).alias("century"),
        )

    return let(F.struct(own.alias("own"), tei.alias("tei")), info)


def script_type(language: Column) -> Column:
    pairs = list(fixed_values.SCRIPTS.items())
    chain = reduce(lambda out, p: out.when(language == p[0], p[1]), pairs[1:], F.when(language == pairs[0][0], pairs[0][1]))
    return F.when(nonempty(language), chain.otherwise("other"))


def language_name(code: Column) -> Column:
    pairs = list(fixed_values.LANGUAGE_NAMES.items())
    return reduce(lambda out, p: out.when(code == p[0], p[1]), pairs[1:], F.when(code == pairs[0][0], pairs[0][1])).otherwise(fixed_values.OTHER_LANGUAGE)


def language_info(language: Column, kv: Column | None = None) -> Column:
    """(main_language, other_languages, script_type); attributes of a text-language key override the field."""
    main = F.when(nonempty(language) & (language != "Unknown"), F.lower(language))
    others = F.lit(None).cast("array<string>")
    if kv is not None:
        keys = F.transform(F.filter(kv, lambda e: _key_has("textlang")(e) & _key_has("mainlang")(e) & nonempty(e["v"])), lambda e: e["k"])
        pick = lambda p: F.try_element_at(F.filter(F.transform(keys, lambda k: F.regexp_extract(k, p, 1)), lambda x: x != ""), F.lit(-1))
        main = F.coalesce(pick(r"'mainLang':\s*'([^']*)'"), main)
        others = F.filter(F.split(pick(r"'otherLangs':\s*'([^']*)'"), r"[,\s]+"), lambda x: x != "")
    return F.struct(main.alias("main_language"), others.alias("other_languages"), script_type(main).alias("script_type"))


def physical_info(kv: Column) -> Column:
    """(material, condition, extent, height, width): an entry belongs to the first branch its key fits, the last entry of a branch wins."""
    number = lambda part, *earlier: F.try_element_at(F.filter(F.transform(F.filter(kv, lambda e: _key_has(part)(e) & ~_key_has(*earlier)(e)), lambda e: number_in(e["v"])), lambda x: x.isNotNull()), F.lit(-1))
    return F.struct(
        last_value(kv, "support").alias("material"),
        last_value(kv, "condition", "support").alias("condition"),
        last_value(kv, "extent", "support", "condition").alias("extent"),
        number("height", "support", "condition", "extent").alias("height"),
        number("width", "support", "condition", "extent", "height").alias("width"),
    )


def physical_info_json(notes: Column) -> Column:
    """(material, height, width, extent) of a JSON side field; anything else gives NULLs."""
    field = lambda name: F.nullif(F.get_json_object(notes, f"$.{name}"), F.lit(""))
    sides = F.split(field("dimensions"), "×")
    number = lambda i: F.get(F.split(strip(F.get(sides, F.lit(i))), r"\s+"), F.lit(0)).try_cast("double")
    whole = (F.size(sides) == 2) & number(0).isNotNull() & number(1).isNotNull()
    return F.struct(field("material").alias("material"), F.when(whole, number(0)).alias("height"), F.when(whole, number(1)).alias("width"), F.concat(field("rows"), F.lit(" lines")).alias("extent"))


def institutional_info(mapped: Column, kv: Column, url: Column, mark: Column) -> Column:
    """(institution, repository): the mapping, then metadata, then the address; an unmapped mark overrides the rest."""
    lower = F.lower(url)
    by_url = lambda i: reduce(lambda out, r: out.when(contains_any(lower, r[0]), F.lit(r[i]).cast("string")), fixed_values.URL_INSTITUTIONS[1:], F.when(contains_any(lower, fixed_values.URL_INSTITUTIONS[0][0]), fixed_values.URL_INSTITUTIONS[0][i]))
    by_mark = lambda i: F.when(mapped.isNull(), reduce(lambda out, r: out.when(contains_any(mark, r[0]), r[i]), fixed_values.MARK_INSTITUTIONS[1:], F.when(contains_any(mark, fixed_values.MARK_INSTITUTIONS[0][0]), fixed_values.MARK_INSTITUTIONS[0][i])))
    repository = F.get(F.filter(kv, lambda e: _key_has("repository")(e) & ~_key_has("institution")(e) & nonempty(e["v"])), F.lit(0))["v"]
    return F.struct(F.coalesce(by_mark(1), mapped, first_value(kv, "institution"), by_url(1)).alias("institution"), F.coalesce(by_mark(2), repository, by_url(2)).alias("repository"))


def person_name(c: Column) -> Column:
    """Without parentheses and life dates."""
    return strip_set(F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)", ""), r"\d{4}-\d{4}", ""), " ,")


def named_entities(people: Column, places: Column, kv: Column) -> Column:
    """(people, places): names in order without repeats, with editors and authors of the metadata."""
    names = F.filter(F.transform(F.filter(kv, lambda e: _key_has("editor", "author")(e) & nonempty(e["v"])), lambda e: person_name(e["v"])), nonempty)
    return F.struct(F.array_distinct(F.concat(people, names)).alias("people"), F.array_distinct(places).alias("places"))


def full_text(description: Column, kv: Column, lines: Column, translations: Column, notes: Column) -> Column:
    """Description, first title, first summary, lines, translations and notes, by single spaces."""
    return F.array_join(
        F.filter(
            F.concat(
                F.array(F.when(description != NO_DESCRIPTION, description), first_value(kv, "title"), first_value(kv, "summary")),
                F.filter(lines, nonempty), F.filter(translations, not_blank), F.array(notes),
            ),
            nonempty,
        ),
        " ",
    )


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def coordinate(c: Column) -> Column:
    """The degree sign as a point, minutes dropped, cut at seconds: a splice, not a conversion."""
    return strip(F.get(F.split(F.replace(F.replace(c, F.lit("°"), F.lit(".")), F.lit("′"), F.lit("")), "″"), F.lit(0))).try_cast("double")


def clean_description(c: Column) -> Column:
    return strip(F.replace(c, F.lit("Description"), F.lit("")))


def image_list(base: Column, count: Column) -> Column:
    """One entry per page: file name, side and order."""
    side = lambda i: F.when(i == 1, "recto").when(i == 2, "verso").otherwise(F.concat(F.lit("page_"), i))
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.struct(F.format_string("%s-000-%05d.jpg", base, i).alias("name"), side(i).alias("side"), i.alias("image_order"))))


def file_extension(c: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(c, r"\.([a-zA-Z0-9]+)(?:\?|$)", 1), F.lit("")))


def transcription_level(lines: Column) -> Column:
    return F.when(lines == 0, "none").when(lines < 5, "minimal").when(lines < 15, "partial").otherwise("complete")


def bounding_box(vertices: Column) -> Column:
    xs, ys = F.transform(vertices, lambda v: v["x"]), F.transform(vertices, lambda v: v["y"])
    return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("width"), (F.array_max(ys) - F.array_min(ys)).alias("height"))
