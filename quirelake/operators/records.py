"""Raw JSON records to the canonical document columns that ``normalize.derived`` takes, and pages to page documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import document
from ..functions.text import nonempty, not_blank, page_doc_id, page_number, strip
from .normalize import KV, SECTION, keyed_sections, nested_transcriptions

TEI = "{http://www.tei-c.org/ns/1.0}"
_PERSON = "array<struct<name:string,role:string,url:string,uncertain:boolean,key:string>>"
_WORK = "array<struct<citation:string,location:string,relations:array<string>,url:string>>"
_JOINS = "struct<joinedManuscripts:array<struct<shelfmark:string,index:int,source:string>>,mainShelfmark:string,source:string,metadata:struct<pageUrl:string,extractedAt:string,extractionMethod:string>>"


def _text(record: Column, name: str) -> Column:
    return F.get_json_object(record, f"$.{name}")


def _array(record: Column, name: str, ddl: str = "array<string>") -> Column:
    return F.coalesce(F.from_json(_text(record, name), ddl), F.array().cast(ddl))


def entries(json: Column) -> Column:
    """A JSON object as ordered key-value pairs."""
    pairs = F.map_entries(F.from_json(json, "map<string,string>"))
    return F.transform(pairs, lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))).cast(KV)


def _entries_or_none(json: Column) -> Column:
    return F.coalesce(entries(json), F.array().cast(KV))


def sections(json: Column) -> Column:
    """A list of ``{name, lines}`` whose lines are an object, a list or a text; the kind is kept."""

    def section(x: Column) -> Column:
        lines = F.get_json_object(x, "$.lines")
        start = F.substring(strip(lines), 1, 1)
        listed = F.transform(F.from_json(lines, "array<string>"), lambda v, i: F.struct((i + 1).cast("string").alias("k"), v.alias("v")))
        whole = F.when(nonempty(lines), F.array(F.struct(F.lit("1").alias("k"), lines.alias("v"))))
        return F.struct(
            F.get_json_object(x, "$.name").alias("name"),
            F.when(start == "{", "map").when(start == "[", "list").otherwise("text").alias("kind"),
            F.coalesce(F.when(start == "{", entries(lines)).when(start == "[", listed.cast(KV)).otherwise(whole.cast(KV)), F.array().cast(KV)).alias("lines"),
        )

    return F.coalesce(F.transform(F.from_json(json, "array<string>"), section), F.array()).cast(SECTION)


def tei_documents(df: DataFrame, record: str = "record") -> DataFrame:
    """Catalogue records with namespaced metadata; their language field is not used."""
    r = F.col(record)
    none = F.lit(None).cast("string")
    return df.withColumns(
        {
            "doc_id": _text(r, "doc_id"), "shelf_mark": _text(r, "shelf_mark"), "description": F.coalesce(_text(r, "description"), F.lit("")), "language": F.lit("Unknown"), "original_url": _text(r, "original_url"),
            "miscellaneous_info": _text(r, "miscellaneous_info"), "document_category": _text(r, "document_category"), "image_urls": _array(r, "image_urls"), "translations": _array(r, "translations"), "transcriptions": sections(_text(r, "transcriptions")),
            "date": _entries_or_none(_text(r, "date")), "full_metadata": F.coalesce(entries(_text(r, "full_metadata_info")), _entries_or_none(_text(r, "full_metadata"))), "image_metadata": _array(r, "image_metadata", "array<map<string,string>>"),
            "related_people": _array(r, "related_people", _PERSON), "related_places": _array(r, "related_places", _PERSON), "bibliography": _array(r, "bibliography", _WORK), "attribution_url": none, "joins_data": F.from_json(none, _JOINS),
        }
    ).drop(record)


def linked_documents(df: DataFrame, record: str = "record", key: str | None = None) -> DataFrame:
    """Records keyed by id: transcriptions and translations as objects or lists, notes as text or object."""
    r = F.col(record)
    t, n = _text(r, "transcriptions"), _text(r, "translations")
    is_object = lambda c: F.substring(strip(c), 1, 1) == "{"
    keyed = F.filter(keyed_sections(F.map_filter(F.from_json(t, "map<string,string>"), lambda _, v: not_blank(v))), lambda s: F.size(s["lines"]) > 0)
    own = F.coalesce(_text(r, "doc_id"), F.col(key)) if key else _text(r, "doc_id")
    return df.withColumns(
        {
            "doc_id": own, "shelf_mark": _text(r, "shelf_mark"), "description": F.coalesce(_text(r, "description"), F.lit("")), "language": F.coalesce(_text(r, "language"), F.lit("Unknown")), "original_url": _text(r, "original_url"),
            "miscellaneous_info": F.coalesce(_text(r, "miscellaneous_info"), F.nullif(_text(r, "other_info"), F.lit("{}"))), "document_category": F.lit(None).cast("string"), "image_urls": _array(r, "images"),
            "translations": F.when(is_object(n), F.filter(F.map_values(F.from_json(n, "map<string,string>")), not_blank)).otherwise(_array(r, "translations")), "transcriptions": F.when(is_object(t), keyed.cast(SECTION)).otherwise(sections(t)),
            "date": _entries_or_none(_text(r, "date")), "full_metadata": F.array().cast(KV), "image_metadata": F.array().cast("array<map<string,string>>"), "related_people": F.filter(_array(r, "related_people", _PERSON), lambda e: e["name"].isNotNull()),
            "related_places": F.filter(_array(r, "related_places", _PERSON), lambda e: e["name"].isNotNull()), "bibliography": F.filter(_array(r, "bibliography", _WORK), lambda e: e["citation"].isNotNull()),
            "attribution_url": F.coalesce(F.nullif(_text(r, "attribution_url"), F.lit("")), _text(r, "collection_attribution_url")), "joins_data": F.from_json(_text(r, "joins_data"), _JOINS),
            "collection": _text(r, "collection"), "sub_collection": _text(r, "sub_collection"),
        }
    ).drop(record)


def _metadata(kv: Column, name: str) -> Column:
    return F.get(F.filter(kv, lambda e: (e["k"] == name) & nonempty(e["v"])), F.lit(0))["v"]


def adapter_fields(kv: Column, doc_id: Column, mark: Column, date: Column, language: Column) -> Column:
    """Shelf mark, description, dating, place, material, provenance, script and languages of a namespaced record.

    Languages are sorted, since their order is not defined otherwise.
    """
    real = lambda c: F.when(c != document.NO_DESCRIPTION, c)
    title = F.nullif(F.regexp_extract(_metadata(kv, "title"), r"\((.*?)\)", 1), F.lit(""))
    provenance = _metadata(kv, f"{TEI}provenance")
    listed = F.transform(F.split(_metadata(kv, f"{TEI}textLang"), ","), lambda x: strip(x))
    languages = F.array_distinct(F.filter(F.concat(F.array(F.when(language != "Unknown", language)), F.coalesce(listed, F.array().cast("array<string>"))), nonempty))
    return F.struct(
        strip(F.coalesce(_metadata(kv, f"{TEI}idno"), F.nullif(mark, F.lit("")), title, doc_id, F.lit("UNKNOWN"))).alias("shelf_mark"),
        F.coalesce(real(_metadata(kv, "description")), real(_metadata(kv, f"{TEI}summary")), real(_metadata(kv, f"{TEI}msDesc"))).alias("description"),
        F.coalesce(F.nullif(date, F.lit("")), _metadata(kv, f"{TEI}origDate")).alias("dating"),
        F.coalesce(_metadata(kv, f"{TEI}origPlace"), F.when(F.contains(provenance, F.lit("Fustat")), "Fustat")).alias("place"),
        F.coalesce(_metadata(kv, f"{TEI}material"), _metadata(kv, f"{TEI}support")).alias("material"),
        provenance.alias("provenance"),
        F.array_compact(F.array(_metadata(kv, f"{TEI}scriptNote"))).alias("script"),
        F.when(F.size(languages) > 0, F.sort_array(languages)).otherwise(F.array(F.lit("Unknown"))).alias("languages"),
        document.title_type(_metadata(kv, "title")).alias("document_type"),
    )


def holding(mapped: Column, source: Column, mark: Column, collection: Column) -> Column:
    """(institution, collection, sub_collection) of the relational load; one source has names of its own."""
    own = (F.lower(source) == "rylands") | mark.startswith("Manchester:")
    return F.struct(
        F.when(own, "Rylands").otherwise(F.coalesce(mapped, F.lit("Unknown"))).alias("institution"),
        F.when(own, "Friedberger Collection").otherwise(F.coalesce(collection, F.lit("Unknown"))).alias("collection"),
        F.when(mark.startswith("MS-TS-"), F.nullif(F.split_part(mark, F.lit("-"), F.lit(3)), F.lit(""))).alias("sub_collection"),
    )


def source_records(df: DataFrame, order: str) -> DataFrame:
    """Upsert on (source_name, source_id): the latest address, mark, metadata and quality; the first document and flag.

    source_id is the record's id, else its shelf mark, else a hash of the record.
    """
    o = F.col(order)
    own = F.coalesce(F.nullif("doc_id", F.lit("")), F.nullif("shelf_mark", F.lit("")), F.sha2(F.to_json(F.struct(*[F.col(c) for c in df.columns if c != order])), 256))
    latest, first = [c for c in ("original_url", "shelf_mark", "metadata", "metadata_quality") if c in df.columns], [c for c in ("document_id", "is_primary", "scraped_at") if c in df.columns]
    return df.withColumn("source_id", own).groupBy("source_name", "source_id").agg(*[F.max_by(c, o).alias(c) for c in latest], *[F.min_by(c, o).alias(c) for c in first])


def page_documents(pages: DataFrame, stem: Column) -> DataFrame:
    """Structured pages as page documents: number, id, first mark, transcriptions by mark, text."""
    c = F.col
    number = page_number(F.get(c("extracted_page_number"), F.lit(0)).cast("string"))
    marks = F.map_keys("shelf_marks_mentioned")
    kept = pages.withColumn("__n", number)
    return kept.select(
        page_doc_id(stem, c("__n.number"), c("__n.label")).alias("doc_id"), c("__n.number").alias("page_number"), F.get(marks, F.lit(0)).alias("shelf_mark"), marks.alias("shelf_marks_mentioned"),
        nested_transcriptions(c("transcriptions")).alias("transcriptions"), "footnotes", "summary", "classification", F.coalesce("full_main_text", F.lit("")).alias("full_main_text"),
    )


def page_text(df: DataFrame) -> Column:
    """Summary, main text, transcriptions and notes of a page, for embedding."""
    joined = F.array_join(F.map_values("transcriptions"), "\n")
    return F.concat_ws("\n", F.when(not_blank(F.col("summary")), F.concat(F.lit("Summary: "), "summary")), F.when(not_blank(F.col("full_main_text")), F.concat(F.lit("Text: "), "full_main_text")), F.when(not_blank(joined), F.concat(F.lit("Transcriptions: "), joined)))


def page_search_document(df: DataFrame, metadata: DataFrame) -> DataFrame:
    """Page documents with their book's title, authors and subjects, as flat search documents."""
    from .pages import with_constant

    book = metadata.select("title", "authors", "subjects", "publisher", "publication_date")
    return with_constant(df, book).withColumn("full_text_content", page_text(df)).withColumn("embedding_key", document.cache_key(F.lit("biblio"), F.lit(""), F.col("doc_id"), F.lit(""), F.coalesce("shelf_mark", F.lit(""))))
