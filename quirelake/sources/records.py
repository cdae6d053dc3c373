"""Record containers, structured pages, graph CSVs, embeddings and folder listings as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAPH_FILES: dict[str, str] = {
    "documents": "pgpid int, url string, shelfmark string, multifragment string, side string, region string, type string, description string, doc_date_original string, doc_date_calendar string, doc_date_standard string, inferred_date_display string, inferred_date_standard string, inferred_date_rationale string, inferred_date_notes string, language_note string, scholarship_records string, initial_entry string, last_modified string, input_by string, library string, collection string, has_transcription string, has_translation string, iiif_urls string, fragment_urls string, languages_primary string, languages_secondary string, tags string",
    "fragments": "shelfmark string, is_multifragment string, url string, iiif_url string, created string, last_modified string, provenance_display string, provenance string, material_support string, shelfmarks_historic string, collection string, collection_name string, collection_abbrev string, library string, library_abbrev string, pgpids string",
    "people": "name string, name_variants string, gender string, social_roles string, auto_date_range string, manual_date_range string, description string, tags string, related_people_count string, family_traces_roots_to string, home_base string, occasional_trips_to string, related_documents_count string, url string",
    "places": "name string, name_variants string, is_region string, coordinates string, geographic_area string, notes string, related_documents_count string, related_people_count string, related_events_count string, url string",
    "sources": "citation string, source_type string, authors string, title string, journal_book string, volume string, issue string, year int, place_published string, publisher string, edition string, other_info string, page_range string, languages string, url string, notes string, num_footnotes int",
    "footnotes": "document_id int, source string, location string, doc_relation string, emendations string, notes string, url string, content string",
}
STRUCTURED_PAGE = (
    "shelf_marks_mentioned map<string,string>, footnotes map<string,string>, transcriptions map<string,map<string,string>>, extracted_page_number array<int>, summary string, classification string, full_main_text string, "
    "metadata struct<page_number:int,pdf_name:string,processed_at:string,model_used:string,provider:string,processing_mode:string>, _corrupt_record string"
)
OCR_RESULTS = (
    "pdf_path string, total_pages int, processed_pages int, images_dir string, pages array<struct<page_number:int,ocr_result:struct<full_text:string,text_blocks:array<struct<text:string,confidence:double,bounding_box:struct<x:int,y:int,width:int,height:int>>>,page_text:string,confidence_score:double,language_hints:array<string>>,"
    "image_path:string,image_size:struct<width:double,height:double>,error:string>>, processing_info map<string,string>"
)


def container_records(value: Column) -> Column:
    """The records of one JSON container as an array of JSON texts.

    A list under ``documents``; a single record if it has a record's own fields; a list as it is; else the values of
    an object whose keys are ids, bookkeeping keys left out; anything else is empty.
    """
    documents = F.from_json(F.get_json_object(value, "$.documents"), "array<string>")
    fields = F.from_json(value, "map<string,string>")
    entries = F.filter(F.map_entries(fields), lambda e: ~e["key"].startswith("scraping_metadata") & ~e["key"].startswith("metadata_analysis"))
    keyed = F.transform(entries, lambda e: e["value"])
    single = F.get_json_object(value, "$.doc_id").isNotNull() | F.get_json_object(value, "$.shelf_mark").isNotNull() | F.get_json_object(value, "$.images").isNotNull()
    start = F.substring(F.ltrim(value), 1, 1)
    return F.when(start == "[", F.from_json(value, "array<string>")).when(documents.isNotNull(), documents).when(single, F.array(value)).when(start == "{", keyed).otherwise(F.array().cast("array<string>"))


def read_containers(spark: SparkSession, paths: list[str], glob: str = "*.json", resume_from: int = 0) -> DataFrame:
    """(file_path, file_rank, ordinal, record) of all containers, files ranked as given; ``resume_from`` skips that many of each file."""
    parts = []
    for rank, path in enumerate(paths):
        text = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
        rows = text.select(F.col("_metadata.file_path").alias("file_path"), F.posexplode(container_records(F.col("value"))).alias("ordinal", "record"))
        parts.append(rows.select("file_path", F.lit(rank).alias("file_rank"), "ordinal", "record").where(F.col("ordinal") >= resume_from))
    return reduce(DataFrame.unionByName, parts)


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that exist, in order; on any file system that Spark reads."""
    out = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            out.append(p)
    return out


def read_structured_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pages in order, unreadable files) of all ``*_structured.json`` below a folder."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*_structured.json", recursiveFileLookup=True)
    parsed = F.from_json("value", STRUCTURED_PAGE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = files.select(parsed.alias("p"), F.col("_metadata.file_path").alias("file_path")).select("p.*", "file_path")
    good = rows.where("_corrupt_record is null").drop("_corrupt_record").dropDuplicates(["file_path"])
    return good.orderBy(F.coalesce("metadata.page_number", F.lit(0)), "file_path"), rows.where("_corrupt_record is not null").select("file_path", "_corrupt_record")


def read_ocr_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OCR_RESULTS).json(path, multiLine=True)


def read_book_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row; authors and subjects as arrays whatever they were."""
    as_list = lambda c: F.filter(F.transform(F.coalesce(F.from_json(c, "array<string>"), F.split(c, ",")), lambda x: F.trim(x)), lambda x: x != "")
    raw = spark.read.text(path, wholetext=True)
    field = lambda *names: F.coalesce(*[F.get_json_object("value", f"$.{n}") for n in names])
    return raw.select(
        *[field(n).alias(n) for n in ("title", "publication_date", "publisher", "description", "language", "collection", "notes")], field("isbn", "ISBN").alias("isbn"), as_list(field("authors", "author")).alias("authors"), as_list(field("subjects", "subject_keywords", "keywords")).alias("subjects")
    )


def read_graph_csvs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The six graph tables; a missing file is an error."""
    paths = {n: f"{folder}/{n}.csv" for n in GRAPH_FILES}
    missing = sorted(set(paths.values()) - set(existing(spark, list(paths.values()))))
    if missing:
        raise FileNotFoundError(", ".join(missing))
    return {n: spark.read.schema(s).csv(paths[n], header=True, multiLine=True, escape='"', mode="PERMISSIVE") for n, s in GRAPH_FILES.items()}


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table's first column with ``embed`` in its name, as ``embedding`` of unit length; other columns stay."""
    from ..functions.vectors import l2_normalise

    df = spark.read.parquet(path)
    column = next((c for c in df.columns if "embed" in c.lower()), None)
    if column is None:
        raise ValueError("no column whose name contains 'embed'")
    return df.withColumn("embedding", l2_normalise(F.col(column)))


def listing(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, folder, name, length) of the files below a folder; contents are not read."""
    options = {"recursiveFileLookup": "true"} | ({"pathGlobFilter": glob} if glob else {})
    files = spark.read.format("binaryFile").options(**options).load(path).select("path", "length")
    return files.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "length")


def metadata_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("name").rlike(r"(_metadata|_meta)\.json$|^meta\.json$"))


def structured_folders(files: DataFrame, suffix: str) -> DataFrame:
    """Folders with the suffix that hold a structured page."""
    return files.where(F.col("name").endswith("_structured.json") & F.col("folder").endswith(suffix)).groupBy("folder").agg(F.count("*").alias("pages"))


def image_folders(files: DataFrame, folders: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """(folder, image_folder): ``{base}_images`` beside a folder, else any ``*_images``, else ``images``; with pictures in it."""
    pictures = files.where(F.lower("name").rlike(r"\.(jpe?g|png)$")).select(F.col("folder").alias("image_folder")).distinct().withColumn("parent", F.regexp_replace("image_folder", "/[^/]*$", ""))
    base = F.regexp_replace("folder", "(" + "|".join(suffixes) + ")$", "")
    rows = folders.select("folder", F.regexp_replace("folder", "/[^/]*$", "").alias("parent"), base.alias("base")).join(pictures, "parent")
    rank = F.when(F.col("image_folder") == F.concat("base", F.lit("_images")), 1).when(F.col("image_folder").endswith("_images"), 2).when(F.col("image_folder").endswith("/images"), 3)
    return rows.withColumn("rank", rank).where("rank is not null").groupBy("folder").agg(F.min_by("image_folder", F.struct("rank", "image_folder")).alias("image_folder"))


def tasks(files: DataFrame, suffix: str, image_suffixes: tuple[str, ...]) -> DataFrame:
    """(metadata_path, folder, pages, image_folder): each metadata file with the structured folders under its folder."""
    meta = metadata_files(files).select(F.col("path").alias("metadata_path"), F.col("folder").alias("parent"))
    folders = structured_folders(files, suffix).withColumn("parent", F.regexp_replace("folder", "/[^/]*$", ""))
    return meta.join(folders, "parent").join(image_folders(files, folders.select("folder"), image_suffixes), "folder", "left").select("metadata_path", "folder", "pages", "image_folder")
