"""Raw records to the canonical document, and the document to a search document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, document
from ..functions.text import nonempty, not_blank, strip, truncate

KV = "array<struct<k:string,v:string>>"
SECTION = "array<struct<name:string,kind:string,lines:array<struct<k:string,v:string>>>>"
#: Column renames of the older record layout.
LEGACY = {"images": "image_urls", "other_info": "miscellaneous_info", "orig_url": "original_url"}


def renamed(df: DataFrame, allowed: set[str]) -> DataFrame:
    """Legacy names replaced; a column outside ``allowed`` is an error."""
    out = df.withColumnsRenamed({k: v for k, v in LEGACY.items() if k in df.columns})
    unknown = sorted(set(out.columns) - allowed)
    if unknown:
        raise ValueError(f"unknown record fields: {', '.join(unknown)}")
    return out


def text_lines(text: Column) -> Column:
    """Lines of a text with their number; blank ones are dropped, numbers stay."""
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).cast("string").alias("k"), strip(x).alias("v")))
    return F.filter(numbered, lambda e: e["v"] != "")


def keyed_sections(transcriptions: Column) -> Column:
    """map<key, multi-line text> as sections ``Transcription {key}``."""
    entries = F.map_entries(transcriptions)
    return F.transform(entries, lambda e: F.struct(F.concat(F.lit("Transcription "), e["key"]).alias("name"), F.lit("map").alias("kind"), text_lines(e["value"]).alias("lines")))


def section_lines(sections: Column) -> Column:
    """Non-empty lines of all sections."""
    return F.filter(F.flatten(F.transform(sections, lambda s: F.transform(s["lines"], lambda e: e["v"]))), nonempty)


def map_line_count(sections: Column) -> Column:
    """Only lines of keyed sections earn the completeness bonus."""
    return F.size(section_lines(F.filter(sections, lambda s: s["kind"] == "map")))


def translations_with_order(translations: Column) -> Column:
    numbered = F.transform(translations, lambda x, i: F.struct(F.concat(F.lit("translation_"), i + 1).alias("k"), x.alias("v")))
    return F.filter(numbered, lambda e: not_blank(e["v"]))


def nested_transcriptions(marks: Column) -> Column:
    """map<mark, map<line, text>> as map<mark, text>: lines by number, those without one last, blank ones dropped."""
    number = lambda e: F.coalesce(e["key"].try_cast("int"), F.lit(2147483647))
    joined = F.transform_values(
        marks, lambda _, lines: F.array_join(F.transform(F.filter(F.array_sort(F.map_entries(lines), lambda a, b: number(a) - number(b)), lambda e: not_blank(e["value"])), lambda e: e["value"]), "\n")
    )
    return F.map_filter(joined, lambda _, v: not_blank(v))


def derived(df: DataFrame, prefixes: list[tuple] | None = None, paris_collection: str | None = None) -> DataFrame:
    """Documents with everything derived: mapping, dates, language, physical data, institution, names, type, quality.

    Expects doc_id, shelf_mark, description, language, original_url, miscellaneous_info, document_category (strings),
    image_urls, translations (arrays of strings), transcriptions (SECTION), date and full_metadata (KV),
    related_people, related_places (arrays with a name), bibliography (array).
    """
    c = F.col
    size = lambda x: F.coalesce(F.nullif(F.size(c(x)), F.lit(-1)), F.lit(0))
    df = df.withColumn("description", document.clean_description(c("description")))
    df = df.withColumn("__map", document.shelf_mark_mapping(c("shelf_mark"), prefixes, paris_collection))
    for field in ("institution", "collection", "sub_collection"):
        df = df.withColumn(field, F.coalesce(c(field), c("__map")[field]) if field in df.columns else c("__map")[field])
    names = lambda x: F.transform(F.coalesce(c(x), F.array().cast(df.schema[x].dataType)), lambda e: e["name"])
    score = document.completeness(
        description=c("description"), has_id=nonempty(c("doc_id")) | nonempty(c("shelf_mark")), has_date=size("date") > 0, transcriptions=size("transcriptions"), lines=map_line_count(c("transcriptions")), translations=size("translations"),
        images=size("image_urls"), category=c("document_category"), language=c("language"), relations=size("related_people") + size("related_places"), notes=c("miscellaneous_info"), url=c("original_url"),
    )
    return df.withColumns(
        {
            "temporal": document.temporal_info(c("date"), c("full_metadata")), "language_info": document.language_info(c("language"), c("full_metadata")), "physical": document.physical_info(c("full_metadata")), "physical_notes": document.physical_info_json(c("miscellaneous_info")),
            "institutional": document.institutional_info(c("institution"), c("full_metadata"), c("original_url"), c("shelf_mark")), "entities": document.named_entities(names("related_people"), names("related_places"), c("full_metadata")),
            "source_collection": document.source_format(c("full_metadata"), size("related_people") + size("related_places") + size("bibliography")),
            "document_type": document.document_type(c("description"), c("document_category"), document.first_value(c("full_metadata"), "summary")),
            "completeness_score": score, "content_quality": document.quality_bucket(score), "lines": section_lines(c("transcriptions")),
            "full_text": document.full_text(c("description"), c("full_metadata"), section_lines(c("transcriptions")), c("translations"), c("miscellaneous_info")),
        }
    ).drop("__map")


def search_document(df: DataFrame) -> DataFrame:
    """``derived`` rows as flat search documents; dates normalised, absent fields NULL (dropped by JSON writers)."""
    c = F.col
    main = F.coalesce(F.when(c("language") != "Unknown", F.lower("language")), F.when(c("language_info.main_language").isNotNull(), document.language_name(c("language_info.main_language"))))
    return df.select(
        "doc_id", "shelf_mark", "description", "document_type", F.col("content_quality"), "completeness_score", "source_collection", "institution", "collection", "sub_collection",
        F.col("institutional.repository").alias("repository"), main.alias("main_language"), F.col("language_info.other_languages").alias("other_languages"), F.col("language_info.script_type").alias("script_type"),
        dates.strip_zeros(c("temporal.date_start")).alias("date_start"), dates.strip_zeros(c("temporal.date_end")).alias("date_end"), dates.strip_zeros_range(c("temporal.date_display")).alias("date_display"), F.col("temporal.century").alias("century"),
        F.col("temporal.date_certainty").alias("date_certainty"), F.coalesce("physical.material", "physical_notes.material").alias("material"), F.coalesce("physical.height", "physical_notes.height").alias("height"),
        F.coalesce("physical.width", "physical_notes.width").alias("width"), F.col("physical.condition").alias("condition"), F.coalesce("physical.extent", "physical_notes.extent").alias("extent"),
        F.col("entities.people").alias("people"), F.col("entities.places").alias("places"), "full_text", "lines", translations_with_order(c("translations")).alias("translations"), "image_urls",
        (F.size("image_urls") > 0).alias("has_images"), (F.size("lines") > 0).alias("has_transcriptions"), (F.size("translations") > 0).alias("has_translations"), F.try_element_at("image_urls", F.lit(1)).alias("primary_image_url"), "original_url", "bibliography",
        document.cache_key(c("doc_id"), c("shelf_mark"), c("description"), F.array_join("lines", "|"), F.try_element_at("image_urls", F.lit(1))).alias("embedding_key"),
    )


def representation(parts: list[tuple[str, Column, int | None]]) -> Column:
    """Labelled lines ``Label: text``; absent parts skipped, long ones cut."""
    return F.concat_ws("\n", *[F.when(not_blank(text), F.concat(F.lit(f"{label}: "), text if most is None else truncate(text, most))) for label, text, most in parts])


def coerced(column: Column, ddl: str, required: str) -> Column:
    """A JSON array as structs; elements without the required field are dropped."""
    return F.filter(F.from_json(column, ddl), lambda e: e[required].isNotNull())
