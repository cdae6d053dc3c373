"""Merges, upserts, audits, views and micro-batches on the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import relational, resolve
from ..sources.exchange import scratch_folder
from ..streaming import microbatch
from .registry import Tables, query

C = F.col


@query("""WITH g AS (SELECT source || ':' || lang AS k, doc_id, text, row_number() OVER (PARTITION BY source, lang ORDER BY length(text) DESC, doc_id) AS r FROM documents)
    SELECT k, min(doc_id) AS base_id, max(CASE WHEN r = 1 THEN text END) AS text, count(*) AS merged_records, count(*)::INTEGER AS images FROM g GROUP BY k""")
def dedup_merge_by_key(t: Tables) -> DataFrame:
    rows = t.documents.select(F.concat("source", F.lit(":"), "lang").alias("k"), C("doc_id").alias("o"), C("doc_id").alias("base_id"), "text", F.array(C("doc_id").cast("string")).alias("images"))
    # an image list per key is only as long as the key has different ids: here it is counted, not kept
    merged = rows.groupBy("k").agg(F.min_by("base_id", "o").alias("base_id"), resolve.longest(C("text"), C("o")).alias("text"), F.count("*").alias("merged_records"), F.count_distinct(F.element_at("images", 1)).cast("int").alias("images"))
    return merged


@query("""SELECT o_custkey, count(*) AS merged_records, min(o_orderkey) AS base_id, list(o_orderpriority ORDER BY o_orderkey) AS priorities FROM orders GROUP BY o_custkey""")
def merge_record_groups(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", C("o_orderkey").alias("base_id"), C("o_orderstatus").alias("text"), F.array("o_orderpriority").alias("images"), F.array("o_orderpriority").alias("priorities"))
    return resolve.merge_group(rows, "o_custkey", "o_orderkey", "text", "images", ["priorities"]).select("o_custkey", "merged_records", "base_id", "priorities")


@query("""SELECT p_brand, p_name FROM (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_partkey) AS r FROM part) WHERE r = 1""")
def merge_longest_wins(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(resolve.longest(C("p_name"), C("p_partkey")).alias("p_name"))


@query("""SELECT o_custkey, min_by(p, o_orderkey) AS priority FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS p FROM orders) WHERE p IS NOT NULL GROUP BY o_custkey
    UNION ALL SELECT o_custkey, NULL FROM orders GROUP BY o_custkey HAVING count_if(o_orderstatus = 'F') = 0""")
def merge_first_nonnull(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(resolve.first_nonempty(F.when(C("o_orderstatus") == "F", C("o_orderpriority")), C("o_orderkey")).alias("priority"))


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1""")
def upsert_last_wins(t: Tables) -> DataFrame:
    return resolve.last_writer_wins(t.events.select("user_id", "event_id", "event_type", "value"), ["user_id"], ["event_id"])


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r = 1""")
def insert_ignore_first_wins(t: Tables) -> DataFrame:
    return resolve.first_writer_wins(t.events.select("user_id", "event_id", "event_type", "value"), ["user_id"], ["event_id"])


_RECORDS = """SELECT o_custkey AS k, o_orderkey AS o, o_orderstatus AS transcription, CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date_start,
    strftime(o_orderdate, '%Y-%m-%d') AS date_display, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0 THEN year(o_orderdate) END AS y, o_totalprice AS c FROM orders"""


@query(f"""WITH r AS ({_RECORDS}), k AS (SELECT k, min(o) FILTER (WHERE y IS NOT NULL) AS o0, max(c) AS completeness, count(*) AS records FROM r GROUP BY k)
    SELECT k.k, records, completeness, (SELECT y FROM r WHERE r.k = k.k AND r.o = k.o0)::INTEGER AS year, (SELECT max_by(date_display, o) FROM r WHERE r.k = k.k AND date_start IS NOT NULL AND (k.o0 IS NULL OR r.o <= k.o0)) AS date_text FROM k""")
def canonical_merge(t: Tables) -> DataFrame:
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    has = C("o_orderkey") % 4 != 0
    rows = t.orders.select(
        C("o_custkey").alias("k"), C("o_orderkey").alias("o"), C("o_orderstatus").alias("transcription"), C("o_orderpriority").alias("translation"), C("o_orderpriority").alias("description"), F.when(has, d).alias("date_start"), d.alias("date_display"),
        F.when((C("o_orderkey") % 3 == 0) & has, F.year("o_orderdate")).alias("year"), C("o_orderstatus").alias("language"), C("o_orderstatus").alias("material"), C("o_orderstatus").alias("condition"), F.array(C("o_orderstatus")).alias("joins"),
        F.lit(1).alias("image_count"), C("o_totalprice").alias("completeness"),
    )
    return resolve.canonical_records(rows, "k", "o").select("k", "records", "completeness", "year", "date_text")


@query("""SELECT c_nationkey, e.k, max_by(e.v, o) AS v FROM (SELECT c_nationkey, c_custkey AS o, unnest([{'k': 'segment', 'v': c_mktsegment}, {'k': 'name', 'v': c_name}]) AS e FROM customer) GROUP BY ALL""")
def metadata_last_nonempty(t: Tables) -> DataFrame:
    entry = lambda k, c: F.struct(F.lit(k).alias("k"), C(c).alias("v"))
    rows = t.customer.select("c_nationkey", "c_custkey", F.array(entry("segment", "c_mktsegment"), entry("name", "c_name")).alias("kv"))
    return resolve.metadata_merge(rows, "c_nationkey", "c_custkey", "kv").select("c_nationkey", F.explode("kv").alias("e")).select("c_nationkey", "e.k", "e.v")


@query("""WITH v AS (SELECT p_partkey AS document, p_brand AS variant, 0 AS pos, 'normalized' AS kind FROM part UNION ALL SELECT p_partkey, p_name, 1, CASE WHEN p_name = p_type THEN 'join' ELSE 'database' END FROM part UNION ALL SELECT p_partkey, p_type, 2, 'join' FROM part)
    SELECT document, variant, kind FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY document, pos) AS r FROM v) WHERE r = 1""")
def variants_explode(t: Tables) -> DataFrame:
    rows = t.part.select(C("p_partkey").alias("document"), "p_brand", "p_name", "p_type", C("p_partkey").alias("o"))
    return resolve.variants(rows, "document", C("p_brand"), C("p_name"), F.array("p_type"), F.lit(None).cast("string"), "o")


@query("""SELECT document, source, image_order, url FROM (SELECT o_custkey AS document, o_orderstatus AS source, i AS image_order, CASE i WHEN 1 THEN o_orderpriority ELSE o_orderkey::VARCHAR END AS url, row_number() OVER (PARTITION BY o_custkey, o_orderstatus, i ORDER BY o_orderkey DESC) AS r FROM orders, (VALUES (1), (2)) x(i)) WHERE r = 1""")
def image_order_explode(t: Tables) -> DataFrame:
    rows = t.orders.select(C("o_custkey").alias("document"), C("o_orderstatus").alias("source"), F.array("o_orderpriority", C("o_orderkey").cast("string")).alias("urls"), C("o_orderkey").alias("o"))
    return resolve.images(rows, "document", "source", "urls", "o")


@query("""SELECT c_custkey AS document_id, (SELECT list(o_orderstatus || ':' || o_orderkey ORDER BY o_orderstatus, o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS sources, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS total_images FROM customer""")
def view_documents_complete(t: Tables) -> DataFrame:
    orders = t.orders.withColumnRenamed("o_custkey", "document_id")
    records = orders.select("document_id", C("o_orderstatus").alias("source_name"), C("o_orderkey").alias("source_id"))
    variants = orders.select("document_id", C("o_orderpriority").alias("variant_shelf_mark"), C("o_orderstatus").alias("kind"))
    view = relational.documents_view(t.customer.withColumnRenamed("c_custkey", "document_id"), records, variants, orders)
    parsed = F.from_json("sources", "array<struct<source_name:string,source_id:long>>")
    return view.select("document_id", F.transform(parsed, lambda x: F.concat(x["source_name"], F.lit(":"), x["source_id"])).alias("sources"), "total_images")


@query("""SELECT s_suppkey AS source_id, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R') AS mention_count, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS chunk_count,
    (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_linestatus <> 'O') AS embedded_chunks FROM supplier""")
def view_bibliography_mentions(t: Tables) -> DataFrame:
    lines = t.lineitem.select(C("l_suppkey").alias("source_id"), "l_returnflag", (C("l_linestatus") == "O").alias("needs_embedding"))
    view = relational.sources_view(t.supplier.withColumnRenamed("s_suppkey", "source_id"), lines.where("l_returnflag = 'R'"), lines)
    return view.select("source_id", "mention_count", "chunk_count", "embedded_chunks")


@query("""SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS image_count, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) > 0 AS has_images FROM orders""")
def image_count_recompute(t: Tables) -> DataFrame:
    return relational.with_image_counts(t.orders, t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey").select("o_orderkey", "image_count", "has_images")


@query("""SELECT 'lineitem-orders' AS reference, count(*) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'orders-customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'labels-documents', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def fk_audit(t: Tables) -> DataFrame:
    row = lambda name, df: df.agg(F.count("*").alias("orphans")).select(F.lit(name).alias("reference"), "orphans")
    return (
        row("lineitem-orders", relational.orphans(t.lineitem, "l_orderkey", t.orders, "o_orderkey"))
        .unionByName(row("orders-customer", relational.orphans(t.orders, "o_custkey", t.customer, "c_custkey")))
        .unionByName(row("labels-documents", relational.orphans(t.labels, "doc_id", t.documents, "doc_id")))
    )


@query("""SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def unique_audit(t: Tables) -> DataFrame:
    return relational.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("""SELECT l_returnflag, count(*) AS violations FROM lineitem WHERE NOT l_discount BETWEEN 0 AND 0.05 GROUP BY l_returnflag""")
def check_audit(t: Tables) -> DataFrame:
    return relational.outside(t.lineitem, "l_discount", 0.0, 0.05).groupBy("l_returnflag").agg(F.count("*").alias("violations"))


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""")
def cascade_delete(t: Tables) -> DataFrame:
    return relational.cascade(t.orders, "o_custkey", t.customer.where("c_acctbal >= 0"), "c_custkey").select("o_orderkey", "o_custkey")


@query("""SELECT event_type, count(*) AS events FROM events WHERE event_id >= 100 GROUP BY event_type""")
def resume_from(t: Tables) -> DataFrame:
    return microbatch.resume(t.events, "event_id", 100).groupBy("event_type").agg(F.count("*").alias("events"))


@query("""SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def event_windows(t: Tables) -> DataFrame:
    return microbatch.windowed_counts(t.events, "ts", ["event_type"]).withColumn("window_start", C("window_start").cast("timestamp_ntz"))


def _ingested(t: Tables) -> str:
    """``events`` taken in through the micro-batch path; the folder of batches."""
    root = scratch_folder(t.spark, "stream")
    # a file source wants a folder: a single file is read through its parent with a name filter
    events = t.events
    events.write.parquet(f"{root}/arrivals")
    microbatch.ingest(t.spark, f"{root}/arrivals", events.schema, f"{root}/batches", f"{root}/state", lambda df: df.withColumn("value2", C("value") * 2))
    return f"{root}/batches"


@query("""SELECT event_type, count(*) AS n, round(sum(value * 2), 2) AS total FROM events GROUP BY event_type""")
def stream_microbatch_index(t: Tables) -> DataFrame:
    return t.spark.read.parquet(_ingested(t)).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value2"), 2).alias("total"))


@query("""SELECT user_id, count(*) AS n FROM (SELECT DISTINCT event_id, user_id FROM events) GROUP BY user_id""")
def batch_consolidate(t: Tables) -> DataFrame:
    return microbatch.consolidate(t.spark, _ingested(t), "event_id").groupBy("user_id").agg(F.count("*").alias("n"))
