"""Records, pages, graph tables and batches written to files in their outside formats and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pages, records
from ..sources import exchange, sinks
from ..sources import records as sources
from ..streaming import microbatch
from .archive_queries import literal
from .registry import Tables, query

C = F.col
#: Records of one container file.
CONTAINER = 200


def _record(*fields) -> F.Column:
    return F.to_json(F.struct(*fields))


@query("""SELECT doc_id::VARCHAR AS doc_id, 'Unknown' AS language, coalesce(source, '') AS description, 'https://x/' || doc_id AS original_url, 1 AS images, (doc_id // 200)::VARCHAR AS file FROM documents""")
def container_records(t: Tables) -> DataFrame:
    """Containers ``{"documents": [...]}`` of bounded size, read as catalogue records."""
    folder = exchange.scratch_folder(t.spark, "containers")
    url = F.concat(F.lit("https://x/"), C("doc_id"))
    one = _record(C("doc_id").cast("string").alias("doc_id"), C("source").alias("description"), url.alias("original_url"), F.array(F.concat(url, F.lit(".jpg"))).alias("image_urls"))
    boxes = t.documents.select(F.floor(C("doc_id") / CONTAINER).cast("string").alias("box"), one.alias("r")).groupBy("box").agg(F.concat(F.lit('{"documents":['), F.array_join(F.collect_list("r"), ","), F.lit("]}")).alias("value"))
    boxes.repartition("box").write.partitionBy("box").text(folder + "/in")
    raw = sources.read_containers(t.spark, [folder + "/in"], glob="*.txt")
    rows = records.tei_documents(raw)
    return rows.select("doc_id", "language", "description", "original_url", F.size("image_urls").alias("images"), F.regexp_extract("file_path", "box=([0-9]+)", 1).alias("file"))


@query("""SELECT 'D' || doc_id AS doc_id, coalesce(lang, 'Unknown') AS language, coalesce(source, '') AS description, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::INTEGER AS lines FROM documents""")
def linked_records(t: Tables) -> DataFrame:
    """Records keyed by id whose transcriptions are an object of texts."""
    body = F.create_map(F.lit("a"), C("text"))
    record = F.to_json(F.struct(F.concat(F.lit("D"), C("doc_id")).alias("doc_id"), C("lang").alias("language"), C("source").alias("description"), body.alias("transcriptions")))
    rows = records.linked_documents(t.documents.select(record.alias("record")))
    lines = F.size(F.flatten(F.transform("transcriptions", lambda s: s["lines"])))
    return rows.select("doc_id", "language", "description", lines.alias("lines"))


@query("""SELECT 'documents' AS name, count(*) AS n FROM orders UNION ALL SELECT 'fragments', count(*) FROM part UNION ALL SELECT 'people', count(*) FROM customer UNION ALL SELECT 'places', count(*) FROM nation UNION ALL SELECT 'sources', count(*) FROM supplier UNION ALL SELECT 'footnotes', count(*) FROM supplier""")
def graph_csv_tables(t: Tables) -> DataFrame:
    """The six tables of the graph load as CSV files with headers, quotes and line ends inside fields."""
    folder = exchange.scratch_folder(t.spark, "graph")
    quoted = F.lit('with "quotes",\nand a line end')
    rows = {
        "documents": t.orders.select(C("o_orderkey").cast("int").alias("pgpid"), C("o_orderpriority").alias("type"), quoted.alias("description")), "fragments": t.part.select(C("p_name").alias("shelfmark"), quoted.alias("provenance")), "people": t.customer.select(C("c_name").alias("name"), quoted.alias("description")),
        "places": t.nation.select(C("n_name").alias("name")), "sources": t.supplier.select(C("s_name").alias("citation"), F.lit(1900).alias("year")), "footnotes": t.supplier.select(C("s_suppkey").cast("string").alias("document_id"), quoted.alias("content")),
    }
    for name, schema in sources.GRAPH_FILES.items():
        have = rows[name]
        full = have.select(*[C(c) if c in have.columns else F.lit(None).cast(kind).alias(c) for c, kind in (x.split() for x in schema.split(", "))])
        full.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(f"{folder}/{name}.csv")
    out = None
    for name, df in sources.read_graph_csvs(t.spark, folder).items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


ANNOTATIONS = [{"image": "a.jpg", "ground_truth": "first line"}, {"image": "", "ground_truth": "x"}, {"image": "b.jpg"}, {"image": "c.jpg", "ground_truth": "  "}, "no object", {"image_path": "d.png", "text": "שלום"}, None]


@query("""SELECT * FROM (VALUES (0, 'a.jpg', 'first line', true), (1, '', 'x', false), (2, 'b.jpg', NULL, false), (3, 'c.jpg', '  ', false), (4, NULL, NULL, false), (5, 'd.png', 'שלום', true), (6, NULL, NULL, false)) t(entry, image, text, kept)""")
def annotation_rows(t: Tables) -> DataFrame:
    import json

    folder = exchange.scratch_folder(t.spark, "annotations")
    t.spark.createDataFrame([(json.dumps(ANNOTATIONS, ensure_ascii=False),)], "value string").coalesce(1).write.text(folder + "/in")
    good, bad = exchange.read_annotations(t.spark, folder + "/in")
    rows = good.select("entry", "image", "text", F.lit(True).alias("kept"))
    field = lambda n: F.get_json_object("value", f"$.{n}")
    return rows.unionByName(bad.select("entry", field("image").alias("image"), field("ground_truth").alias("text"), F.lit(False).alias("kept")))


@query("""SELECT page_id AS page_number, html AS full_text FROM pages WHERE html IS NOT NULL""")
def ocr_page_map(t: Tables) -> DataFrame:
    """OCR results of bounded size as JSON files, read to a text for each page."""
    folder = exchange.scratch_folder(t.spark, "ocr")
    page = F.struct(C("page_id").cast("int").alias("page_number"), F.struct(C("html").alias("full_text")).alias("ocr_result"))
    files = t.pages.select(F.floor(C("page_id") / CONTAINER).alias("f"), page.alias("p")).groupBy("f").agg(F.collect_list("p").alias("pages"))
    files.select(C("f").cast("string").alias("pdf_path"), "pages").write.json(folder + "/in")
    results = t.spark.read.schema(sources.OCR_RESULTS).json(folder + "/in")
    return exchange.ocr_page_texts(results).select(C("page_number").cast("long").alias("page_number"), "full_text")


@query("""SELECT 'scan_' || page_id // 200 AS pdf_path, page_id AS page_number, md5(html) AS text_md5 FROM pages WHERE trim(html) <> '' AND page_id % 200 >= 3""")
def pages_worth_a_call(t: Tables) -> DataFrame:
    rows = t.pages.select(F.concat(F.lit("scan_"), F.floor(C("page_id") / CONTAINER)).alias("pdf_path"), (C("page_id") % CONTAINER).cast("int").alias("page_number"), C("html").alias("full_text"), "page_id")
    return pages.usable(rows, 3).select("pdf_path", C("page_id").alias("page_number"), F.md5("full_text").alias("text_md5"))


@query("""SELECT 'customer' AS name, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer UNION ALL SELECT 'orders', count(*), sum(o_orderkey)::BIGINT FROM orders""")
def tables_written(t: Tables) -> DataFrame:
    folder = exchange.scratch_folder(t.spark, "tables")
    sinks.write_tables({"customer": t.customer, "orders": t.orders}, folder)
    read = lambda n, k: t.spark.read.parquet(f"{folder}/{n}").agg(F.count("*").alias("n"), F.sum(k).alias("keys")).select(F.lit(n).alias("name"), "n", "keys")
    return read("customer", "c_custkey").unionByName(read("orders", "o_orderkey"))


@query("""SELECT event_id, event_type, 'é "' || user_id AS note FROM events""")
def jsonl_appended(t: Tables) -> DataFrame:
    """Two appends of line-wise JSON; text beyond ASCII and quotes come back unchanged."""
    folder = exchange.scratch_folder(t.spark, "lines") + "/out"
    rows = t.events.select("event_id", "event_type", F.concat(F.lit('é "'), "user_id").alias("note"))
    sinks.write_jsonl(rows.where("event_id % 2 = 0"), folder)
    sinks.write_jsonl(rows.where("event_id % 2 = 1"), folder, append=True)
    return exchange.read_batches(t.spark, folder, "event_id long, event_type string, note string").drop("batch")


@query("""SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS characters FROM documents GROUP BY lang""")
def page_files_written(t: Tables) -> DataFrame:
    folder = exchange.scratch_folder(t.spark, "pages") + "/out"
    sinks.write_pages(t.documents.select("doc_id", "n_chars", C("lang").alias("pdf_name")), folder)
    return t.spark.read.schema("doc_id long, n_chars long, pdf_name string").json(folder).groupBy(C("pdf_name").alias("lang")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("characters"))


@query("""SELECT doc_id, lang FROM documents WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id)""")
def work_left(t: Tables) -> DataFrame:
    return sinks.work_left(t.documents.select("doc_id", "lang"), t.embeddings.select(C("vec_id").alias("doc_id")).distinct(), "doc_id")


@query("""SELECT * FROM (VALUES ('before', 'not_started', 0), ('after', 'completed', (SELECT count(*) FROM events)), ('more', 'in_progress', (SELECT count(*) FROM events))) t(moment, state, rows)""")
def ingest_status(t: Tables) -> DataFrame:
    folder = exchange.scratch_folder(t.spark, "status")
    state = lambda moment, expected: microbatch.status(t.spark, f"{folder}/state", f"{folder}/batches", expected).select(F.lit(moment).alias("moment"), "state", "rows")
    before = state("before", None)
    t.events.write.parquet(f"{folder}/arrivals")
    microbatch.ingest(t.spark, f"{folder}/arrivals", t.events.schema, f"{folder}/batches", f"{folder}/state")
    return before.unionByName(state("after", None)).unionByName(state("more", t.events.count() + 1))


STAGES = [("written", True), ("missing", False)]


@query(f"""SELECT * FROM (VALUES {", ".join(f"({literal(n)}, {literal(d)})" for n, d in STAGES)}) t(stage, done)""")
def stages_done(t: Tables) -> DataFrame:
    folder = exchange.scratch_folder(t.spark, "stages")
    t.nation.write.parquet(f"{folder}/written")
    return t.spark.createDataFrame([(n, microbatch.stage_done(t.spark, f"{folder}/{n}")) for n, _ in STAGES], "stage string, done boolean")
