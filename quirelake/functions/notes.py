"""Line-wise notes, descriptions and transcription lists as structured fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dates
from .text import nonempty, not_blank, strip

#: Words of a description that name a document type, in the order in which they are reported.
DESCRIPTION_TYPES = ["letter", "contract", "marriage", "divorce", "legal", "religious", "prayer", "poem", "medical", "business", "court", "fragment", "ketubba", "responsa", "talmud", "bible", "commentary", "liturgy", "magical"]


def _last(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def _there(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull())


def notes_record(notes: Column) -> Column:
    """Location, class mark, provenance and donors of a notes field, and what they tell; a later line of a kind wins.

    (physical_location, institution, library, classmark, collection, provenance, donation_year, collection_type,
    donors, donor_details, donor_surnames); absent fields are NULL.
    """
    lines = F.filter(F.transform(F.split(strip(notes), "\n"), strip), lambda x: x != "")
    rest = lambda name: F.transform(F.filter(lines, lambda x: x.startswith(name)), lambda x: strip(F.replace(x, F.lit(name), F.lit(""))))
    has = lambda x, part: F.contains(F.lower(x), F.lit(part))
    places, marks, origins, gifts = (rest(n) for n in ("Location:", "Classmark:", "Provenance:", "Donated by:"))
    institution = lambda x: F.when(has(x, "cambridge"), "cambridge").when(has(x, "princeton"), "princeton").when(has(x, "oxford"), "oxford").when(has(x, "british library"), "british_library").otherwise("other")
    library = lambda x: F.when((institution(x) == "cambridge") & has(x, "university library"), "cambridge_university_library").when(institution(x) == "british_library", "british_library")
    by_mark = lambda x: F.when(x.startswith("T-S"), "taylor_schechter").when(x.startswith("Or."), "oriental").when(x.startswith("Add."), "additional").otherwise("other")
    # lines in order: every class mark tells a collection, a provenance only one
    tell = F.filter(lines, lambda x: x.startswith("Classmark:") | (x.startswith("Provenance:") & has(x, "taylor-schechter")))
    collection = F.transform(tell, lambda x: F.when(x.startswith("Provenance:"), "taylor_schechter").otherwise(by_mark(strip(F.replace(x, F.lit("Classmark:"), F.lit(""))))))

    pattern = r"^([^,]+),\s*([^,]+),?\s*(\d{4}-\d{4})?"

    def details(text: Column) -> Column:
        parts = F.filter(F.transform(F.split(text, ";"), strip), lambda p: p.rlike(pattern))
        return F.transform(
            parts,
            lambda p: F.struct(
                strip(F.regexp_extract(p, pattern, 1)).alias("surname"), strip(F.regexp_extract(p, pattern, 2)).alias("first_names"), F.nullif(F.regexp_extract(p, pattern, 3), F.lit("")).alias("dates")
            ),
        )

    donors = F.filter(F.transform(gifts, details), lambda d: F.size(d) > 0)
    surnames = F.transform(F.flatten(donors), lambda d: F.lower(d["surname"]))
    return F.struct(
        _last(places).alias("physical_location"),
        F.when(F.size(places) > 0, institution(_last(places))).alias("institution"),
        _last(_there(F.transform(places, library))).alias("library"),
        _last(marks).alias("classmark"),
        _last(collection).alias("collection"),
        _last(origins).alias("provenance"),
        _last(_there(F.transform(origins, lambda x: dates.donation_year(x).cast("string")))).alias("donation_year"),
        F.when(F.exists(origins, lambda x: has(x, "genizah collection")), "genizah").alias("collection_type"),
        _last(gifts).alias("donors"),
        _last(donors).alias("donor_details"),
        F.when(F.size(surnames) > 0, surnames).alias("donor_surnames"),
    )


def description_fields(description: Column) -> Column:
    """(description, has_description, document_types, primary_document_type): the leading word Description goes."""
    clean = F.when(description.startswith("Description"), strip(F.substring(description, 12, 1 << 30))).otherwise(description)
    words = F.split(strip(F.lower(clean)), r"\s+")
    found = F.filter(F.array(*[F.lit(x) for x in DESCRIPTION_TYPES]), lambda x: F.array_contains(words, x))
    there = nonempty(description)
    return F.struct(
        F.when(there, clean).alias("description"),
        F.coalesce(there, F.lit(False)).alias("has_description"),
        F.when(there & (F.size(found) > 0), found).alias("document_types"),
        F.when(there, F.get(found, F.lit(0))).alias("primary_document_type"),
    )


def transcription_summary(sections: Column) -> Column:
    """(texts, full_text, count, total_lines, editors, completeness) of an array of (name, lines); an unnamed one has no editor."""
    lines = F.flatten(F.transform(sections, lambda s: F.filter(F.coalesce(s["lines"], F.array().cast("array<string>")), nonempty)))
    n = F.size(lines)
    return F.struct(
        lines.alias("texts"),
        F.array_join(lines, " ").alias("full_text"),
        F.size(sections).alias("count"),
        n.alias("total_lines"),
        F.transform(F.filter(sections, lambda s: s["name"].isNotNull()), lambda s: s["name"]).alias("editors"),
        F.when(n == 0, "none").when(n < 5, "minimal").when(n < 15, "partial").otherwise("complete").alias("completeness"),
    )


def multilingual_text(description: Column, text: Column, translation: Column) -> Column:
    """Labelled lines for an embedding model; absent parts are skipped."""
    return F.concat_ws("\n", *[F.when(not_blank(c), F.concat(F.lit(f"{label}: "), c)) for label, c in (("Description", description), ("Text", text), ("Translation", translation))])


def model_input(text: Column, most: int = 77) -> Column:
    """What a text encoder is given: the first characters."""
    return F.substring(text, 1, most)


def few(values: Column, n: int = 5) -> Column:
    """The first ``n`` of a list, for a report."""
    return F.slice(values, 1, n)


def megabytes(size: Column) -> Column:
    return size / F.lit(1048576.0)


def rate(part: Column, whole: Column) -> Column:
    """A hit rate or a throughput; 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def perplexity(n: Column, wanted: int = 30) -> Column:
    """What a neighbour embedding of ``n`` points can use: as wanted, less for few points."""
    return F.when(n <= 30, F.greatest(F.lit(1), F.floor(n / 3).cast("int"))).otherwise(F.lit(wanted))
