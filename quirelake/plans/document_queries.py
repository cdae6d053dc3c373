"""Document normalisation on ``documents``, ``pages``, ``orders``, ``events``, ``part`` and ``customer``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, document, notes, text
from ..functions.fixed_values import TYPE_KEYWORDS
from ..operators import normalize, training, viz
from .registry import Tables, query

C = F.col


def _score(t: Tables) -> DataFrame:
    """``documents`` with a completeness score: what a text holds stands in for the fields of a record."""
    x = C("text")
    lines = F.size(F.filter(F.split(x, "\n"), text.nonempty))
    score = document.completeness(
        description=x, has_id=C("doc_id").isNotNull(), has_date=x.rlike("[0-9]{4}"), transcriptions=lines, lines=lines, translations=F.when(C("lang") != "en", 1).otherwise(0), images=F.when(F.contains(x, F.lit("http")), 1).otherwise(0),
        category=C("document_type"), language=C("lang"), relations=F.when(F.contains(x, F.lit("@")), 1).otherwise(0), notes=F.when(F.contains(x, F.lit("|")), "table"), url=C("source"),
    )
    return t.documents.withColumn("document_type", document.document_type(x)).withColumn("completeness", score)


_TYPE_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{name}'" for name, words in TYPE_KEYWORDS) + " END"
_SCORE_SQL = f"""
    SELECT *, {_TYPE_SQL} AS document_type, least((
        (CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 10 THEN 1.0 ELSE 0 END) + (CASE WHEN doc_id IS NOT NULL THEN 1.0 ELSE 0 END) + (CASE WHEN regexp_matches(text, '[0-9]{{4}}') THEN 1.0 ELSE 0 END)
        + (CASE WHEN lines > 0 THEN 2.0 ELSE 0 END) + (CASE WHEN lines > 10 THEN 0.5 ELSE 0 END) + (CASE WHEN lang <> 'en' THEN 1.0 ELSE 0 END) + (CASE WHEN contains(text, 'http') THEN 1.0 ELSE 0 END)
        + (CASE WHEN {_TYPE_SQL} IS NOT NULL THEN 1.0 ELSE 0 END) + (CASE WHEN lang <> '' AND lang <> 'Unknown' THEN 0.5 ELSE 0 END) + (CASE WHEN contains(text, '@') THEN 0.5 ELSE 0 END)
        + (CASE WHEN contains(text, '|') THEN 0.5 ELSE 0 END) + (CASE WHEN source <> '' THEN 0.5 ELSE 0 END)) / 10, 1.0)::DOUBLE AS completeness
    FROM (SELECT *, len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS lines FROM documents)
"""


@query("SELECT doc_id, coalesce(lang, 'Unknown') AS language, source AS source_collection, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS description, length(text)::INTEGER AS length, length(text) > 0 AS has_text, contains(text, 'http') AS has_links, contains(text, chr(10)) AS has_lines FROM documents")
def doc_normalize_fields(t: Tables) -> DataFrame:
    x = C("text")
    return t.documents.select(
        "doc_id", F.coalesce("lang", F.lit("Unknown")).alias("language"), C("source").alias("source_collection"), text.truncate(x, 100).alias("description"), F.length(x).alias("length"), (F.length(x) > 0).alias("has_text"),
        F.contains(x, F.lit("http")).alias("has_links"), F.contains(x, F.lit("\n")).alias("has_lines"),
    )


@query(f"SELECT doc_id, round(completeness, 6) AS completeness FROM ({_SCORE_SQL})")
def completeness_score(t: Tables) -> DataFrame:
    return _score(t).select("doc_id", F.round("completeness", 6).alias("completeness"))


@query(f"""SELECT content_quality, document_type, count(*) AS documents, round(avg(completeness), 6) AS avg_completeness FROM (
    SELECT coalesce(document_type, 'none') AS document_type, completeness, CASE WHEN completeness >= 0.8 THEN 'high' WHEN completeness >= 0.6 THEN 'medium' WHEN completeness >= 0.4 THEN 'low' ELSE 'minimal' END AS content_quality FROM ({_SCORE_SQL}))
    GROUP BY ALL""")
def content_quality(t: Tables) -> DataFrame:
    rows = _score(t).select(document.quality_bucket(C("completeness")).alias("content_quality"), F.coalesce("document_type", F.lit("none")).alias("document_type"), "completeness")
    return rows.groupBy("content_quality", "document_type").agg(F.count("*").alias("documents"), F.round(F.avg("completeness"), 6).alias("avg_completeness"))


@query(f"SELECT doc_id, {_TYPE_SQL} AS document_type FROM documents")
def document_type_infer(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", document.document_type(C("text")).alias("document_type"))


@query("SELECT page_id, CASE WHEN contains(lower(html), 'letter') THEN 'letter' WHEN contains(lower(html), 'legal') OR contains(lower(html), 'contract') THEN 'legal' WHEN contains(lower(html), 'liturgical') OR contains(lower(html), 'prayer') THEN 'liturgical' WHEN contains(lower(html), 'literary') OR contains(lower(html), 'poem') THEN 'literary' WHEN contains(lower(html), 'list') THEN 'list' END AS title_type FROM pages")
def title_type_infer(t: Tables) -> DataFrame:
    return t.pages.select("page_id", document.title_type(C("html")).alias("title_type"))


@query("SELECT doc_id, lower(lang) AS main_language, CASE WHEN lang IS NULL OR lang = '' THEN NULL ELSE 'other' END AS script_type, CASE lang WHEN 'heb' THEN 'Hebrew' WHEN 'jrb' THEN 'Judeo-Arabic' WHEN 'arb' THEN 'Arabic' WHEN 'ara' THEN 'Aramaic' ELSE 'Other' END AS language_name FROM documents")
def language_info(t: Tables) -> DataFrame:
    info = document.language_info(C("lang"))
    return t.documents.select("doc_id", info["main_language"].alias("main_language"), info["script_type"].alias("script_type"), document.language_name(C("lang")).alias("language_name"))


@query("SELECT page_id, CASE WHEN contains(lower(url), 'cambridge') THEN 'Cambridge University' WHEN contains(lower(url), 'princeton') THEN 'Princeton University' WHEN contains(lower(url), 'penn') THEN 'University of Pennsylvania' END AS institution, regexp_extract(url, '^https?://([^/]+)', 1) AS host, nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS record_id FROM pages")
def institution_infer(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    info = document.institutional_info(none, F.lit(None).cast(normalize.KV), C("url"), F.lit(""))
    return t.pages.select("page_id", info["institution"].alias("institution"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.nullif(F.regexp_extract("url", "/([0-9]+)", 1), F.lit("")).alias("record_id"))


PREFIXES = [("S", "House S", "General", None), ("SMALL", "House S", "Small formats", None), ("ST", "House S", "Standard formats", "Stock"), ("P", "House P", "Promotions", None), ("ECON", "House E", "Economy", "Low price")]


@query("""WITH p(prefix, institution, collection, sub_collection) AS (VALUES ('S', 'House S', 'General', NULL), ('SMALL', 'House S', 'Small formats', NULL), ('ST', 'House S', 'Standard formats', 'Stock'), ('P', 'House P', 'Promotions', NULL), ('ECON', 'House E', 'Economy', 'Low price'))
    SELECT p_partkey, institution, collection, sub_collection FROM (SELECT p_partkey, institution, collection, sub_collection, row_number() OVER (PARTITION BY p_partkey ORDER BY length(prefix) DESC) AS r FROM part LEFT JOIN p ON starts_with(p_type, prefix)) WHERE r = 1""")
def shelfmark_prefix_map(t: Tables) -> DataFrame:
    m = document.shelf_mark_mapping(C("p_type"), PREFIXES)
    return t.part.select("p_partkey", *[m[x].alias(x) for x in ("institution", "collection", "sub_collection")])


_DATE_TEXT = """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || '/' || strftime(o_orderdate, '%Y') || '-12-31' WHEN 2 THEN '0' || (year(o_orderdate) - 1100)::VARCHAR || '/' || (year(o_orderdate) - 1000)::VARCHAR
    WHEN 3 THEN 'ca. ' || year(o_orderdate)::VARCHAR || ' - ' || (year(o_orderdate) + 3)::VARCHAR WHEN 4 THEN 'about ' || (year(o_orderdate) - 1100)::VARCHAR WHEN 5 THEN 'Unknown' ELSE '11th century' END AS d FROM orders"""


def _dates(t: Tables) -> DataFrame:
    """``orders`` with their date written in seven ways."""
    d, y = F.date_format("o_orderdate", "yyyy-MM-dd"), F.year("o_orderdate")
    kind = C("o_orderkey") % 7
    form = (
        F.when(kind == 0, d).when(kind == 1, F.concat(d, F.lit("/"), y, F.lit("-12-31"))).when(kind == 2, F.concat(F.lit("0"), y - 1100, F.lit("/"), y - 1000)).when(kind == 3, F.concat(F.lit("ca. "), y, F.lit(" - "), y + 3))
        .when(kind == 4, F.concat(F.lit("about "), y - 1100)).when(kind == 5, "Unknown").otherwise("11th century")
    )
    return t.orders.select("o_orderkey", form.alias("d"))


_PARSED = f"""SELECT o_orderkey, d, CASE WHEN d = 'Unknown' THEN NULL WHEN contains(d, '/') AND regexp_matches(d, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN split_part(d, '/', 1) WHEN contains(d, '/') THEN split_part(d, '/', 1) || '-01-01'
        WHEN regexp_matches(d, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN d WHEN regexp_matches(d, '\\b[0-9]{{3,4}}\\b') THEN regexp_extract(d, '\\b([0-9]{{3,4}})\\b', 1) || '-01-01' END AS date_start,
    CASE WHEN d = 'Unknown' THEN NULL WHEN contains(d, '/') AND regexp_matches(d, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN split_part(d, '/', 2) WHEN contains(d, '/') THEN split_part(d, '/', 2) || '-12-31'
        WHEN contains(d, ' - ') THEN regexp_extract(split_part(d, ' - ', 2), '\\b([0-9]{{3,4}})\\b', 1) || '-12-31' WHEN regexp_matches(d, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN d WHEN regexp_matches(d, '\\b[0-9]{{3,4}}\\b') THEN regexp_extract(d, '\\b([0-9]{{3,4}})\\b', 1) || '-12-31' END AS date_end
    FROM ({_DATE_TEXT})"""


@query(f"""SELECT o_orderkey, date_start, date_end, CASE WHEN length(date_start) > 4 AND starts_with(date_start, '0') THEN regexp_replace(date_start, '^0+', '') ELSE date_start END AS indexed_start,
    CASE WHEN TRY_CAST(substr(date_start, 1, 4) AS INTEGER) IS NOT NULL THEN (((TRY_CAST(substr(date_start, 1, 4) AS INTEGER) - 1) // 100) + 1)::VARCHAR || 'th century' END AS century FROM ({_PARSED})""")
def temporal_parse(t: Tables) -> DataFrame:
    rows = _dates(t).select("o_orderkey", dates.parse_date(C("d")).alias("p"))
    return rows.select("o_orderkey", C("p.start").alias("date_start"), C("p.end").alias("date_end"), dates.strip_zeros(C("p.start")).alias("indexed_start"), dates.century(C("p.start")).alias("century"))


@query(f"SELECT o_orderkey, CASE WHEN y BETWEEN -500 AND 2000 THEN y END AS year FROM (SELECT o_orderkey, TRY_CAST(nullif(regexp_extract(d, '([0-9]{{4}})', 1), '') AS INTEGER) AS y FROM ({_DATE_TEXT}))")
def year_extract(t: Tables) -> DataFrame:
    return _dates(t).select("o_orderkey", dates.extract_year(C("d")).alias("year"))


@query("""SELECT period, count(*) AS orders FROM (SELECT CASE WHEN regexp_matches(c, '10|11|12') THEN 'early_medieval' WHEN regexp_matches(c, '13|14|15') THEN 'late_medieval' WHEN regexp_matches(c, '16|17|18') THEN 'early_modern' ELSE 'unknown' END AS period
    FROM (SELECT (o_orderkey % 21)::VARCHAR || 'th century' AS c FROM orders)) GROUP BY period""")
def period_classify(t: Tables) -> DataFrame:
    text_of = F.concat((C("o_orderkey") % 21).cast("string"), F.lit("th century"))
    return t.orders.select(dates.period_class(text_of).alias("period")).groupBy("period").agg(F.count("*").alias("orders"))


@query("""SELECT o_orderkey, TRY_CAST(split_part(d, '/', 1) AS INTEGER) AS start_year, TRY_CAST(split_part(d, '/', 2) AS INTEGER) AS end_year, (TRY_CAST(split_part(d, '/', 1) AS INTEGER) // 100 + 1)::VARCHAR || 'th' AS century FROM (SELECT o_orderkey, year(o_orderdate)::VARCHAR || '/' || (year(o_orderdate) + 1)::VARCHAR AS d FROM orders)""")
def graph_period(t: Tables) -> DataFrame:
    p = dates.graph_period(F.concat(F.year("o_orderdate"), F.lit("/"), F.year("o_orderdate") + 1))
    return t.orders.select("o_orderkey", p.alias("p")).select("o_orderkey", "p.start_year", "p.end_year", "p.century")


@query("SELECT doc_id, concat_ws(' ', nullif(text, ''), nullif(lang, ''), nullif(source, '')) AS full_text FROM documents")
def full_text_concat(t: Tables) -> DataFrame:
    kv = F.array(F.struct(F.lit("title").alias("k"), C("lang").alias("v")), F.struct(F.lit("summary").alias("k"), C("source").alias("v")))
    none = F.array().cast("array<string>")
    return t.documents.select("doc_id", document.full_text(C("text"), kv, none, none, F.lit(None).cast("string")).alias("full_text"))


@query("SELECT doc_id, concat_ws(chr(10), 'Language: ' || lang, 'Text: ' || CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || '...' ELSE text END, 'Source: ' || source) AS representation FROM documents")
def text_representation(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", normalize.representation([("Language", C("lang"), None), ("Text", C("text"), 1000), ("Source", C("source"), None)]).alias("representation"))


@query("SELECT doc_id, sha256(doc_id::VARCHAR || '|' || source || '|' || text) AS cache_key, md5(text) AS text_key FROM documents")
def embedding_cache_key(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", document.cache_key(C("doc_id").cast("string"), C("source"), C("text")).alias("cache_key"), F.md5(C("text")).alias("text_key"))


@query("SELECT event_id, (props->>'$.k')::INTEGER AS k, props->>'$.absent' AS absent FROM events")
def json_props_extract(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.get_json_object("props", "$.absent").alias("absent"))


@query("""SELECT c_custkey, 'Hall ' || c_mktsegment AS physical_location, 'other' AS institution, c_name AS classmark, 'other' AS collection, 'bought in ' || (1850 + c_custkey % 100) AS provenance, (1850 + c_custkey % 100)::VARCHAR AS donation_year, 'Donor, A' AS donors FROM customer""")
def misc_info_parse(t: Tables) -> DataFrame:
    text = F.concat(F.lit("Location: Hall "), C("c_mktsegment"), F.lit("\nClassmark: "), C("c_name"), F.lit("\nProvenance: bought in "), F.lit(1850) + C("c_custkey") % 100, F.lit("\nDonated by: Donor, A"))
    rows = t.customer.select("c_custkey", notes.notes_record(text).alias("n"))
    return rows.select("c_custkey", *[f"n.{c}" for c in ("physical_location", "institution", "classmark", "collection", "provenance", "donation_year", "donors")])


@query("""SELECT p_partkey, p_type AS material, CASE WHEN p_partkey % 3 <> 0 THEN p_size::DOUBLE END AS height, CASE WHEN p_partkey % 3 <> 0 THEN (p_size + 1)::DOUBLE END AS width, p_size::VARCHAR || ' lines' AS extent FROM part""")
def physical_info_parse(t: Tables) -> DataFrame:
    size = F.when(C("p_partkey") % 3 == 0, "folio").otherwise(F.concat(C("p_size"), F.lit(".00 × "), C("p_size") + 1, F.lit(".00 mm")))
    notes = F.to_json(F.struct(C("p_type").alias("material"), size.alias("dimensions"), C("p_size").alias("rows")))
    return t.part.select("p_partkey", document.physical_info_json(notes).alias("p")).select("p_partkey", "p.material", "p.height", "p.width", "p.extent")


@query("""SELECT s_suppkey, s_name AS name FROM supplier""")
def named_entities(t: Tables) -> DataFrame:
    raw = F.concat(C("s_name"), F.lit(" (Trader), "), F.lit("1847-1915"))
    kv = F.array(F.struct(F.lit("editor").alias("k"), raw.alias("v")))
    none = F.array().cast("array<string>")
    return t.supplier.select("s_suppkey", F.explode(document.named_entities(none, none, kv)["people"]).alias("name"))


@query("""SELECT n_nationkey, (n_nationkey::VARCHAR || '.' || (10 + n_nationkey)::VARCHAR)::DOUBLE AS latitude FROM nation""")
def coordinate_parse(t: Tables) -> DataFrame:
    raw = F.concat(C("n_nationkey"), F.lit("°"), C("n_nationkey") + 10, F.lit("′ ″N"))
    return t.nation.select("n_nationkey", document.coordinate(raw).alias("latitude"))


@query("""SELECT p_partkey, format('{}-000-{:05d}.jpg', p_name, i) AS image_name, CASE i WHEN 1 THEN 'recto' WHEN 2 THEN 'verso' ELSE 'page_' || i::VARCHAR END AS side, i::INTEGER AS image_order FROM (SELECT p_partkey, p_name, unnest(range(1, p_size % 5 + 1)) AS i FROM part)""")
def image_list(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.explode(document.image_list(C("p_name"), C("p_size") % 5)).alias("x"))
    return rows.select("p_partkey", C("x.name").alias("image_name"), "x.side", "x.image_order")


@query("""SELECT page_id, lower(nullif(regexp_extract(url, '\\.([a-zA-Z0-9]+)(\\?|$)', 1), '')) AS extension, regexp_extract(url, '^(https?)://', 1) AS scheme FROM pages""")
def file_extensions(t: Tables) -> DataFrame:
    return t.pages.select("page_id", document.file_extension(C("url")).alias("extension"), F.regexp_extract("url", "^(https?)://", 1).alias("scheme"))


@query("""SELECT conv_id, turn, CASE WHEN n = 0 THEN 'none' WHEN n < 5 THEN 'minimal' WHEN n < 15 THEN 'partial' ELSE 'complete' END AS level, n AS lines FROM (SELECT conv_id, turn, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::INTEGER AS n FROM conversations)""")
def transcription_levels(t: Tables) -> DataFrame:
    n = F.size(normalize.text_lines(C("text")))
    return t.conversations.select("conv_id", "turn", document.transcription_level(n).alias("level"), n.alias("lines"))


@query("""SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS description, length(text)::INTEGER AS transcription_length, CASE WHEN contains(text, 'http') THEN 12 ELSE 8 END AS marker_size, contains(text, 'http') AS has_image, length(text) > 0 AS has_transcription, 'ltr' AS direction, n_chars::DOUBLE AS x, length(text)::DOUBLE AS y FROM documents""")
def viz_frame(t: Tables) -> DataFrame:
    image = F.when(F.contains("text", F.lit("http")), "link")
    return viz.chart_frame(t.documents, "doc_id", C("n_chars").cast("double"), F.length("text").cast("double"), C("text"), C("text"), image).drop("popup")


@query("""SELECT label, count(*) AS documents FROM (SELECT CASE WHEN i AND x THEN 'Complete' WHEN i THEN 'Image Only' WHEN x THEN 'Transcription Only' ELSE 'Incomplete' END AS label FROM (SELECT contains(text, 'http') AS i, length(text) > 500 AS x FROM documents)) GROUP BY label""")
def completeness_label(t: Tables) -> DataFrame:
    label = viz.completeness_label(F.contains("text", F.lit("http")), F.length("text") > 500)
    return t.documents.select(label.alias("label")).groupBy("label").agg(F.count("*").alias("documents"))


@query("""SELECT doc_id, 'Transcribe this document in ' || lang || '.' AS prompt, text AS target FROM documents WHERE regexp_replace(text, '\\s+', '', 'g') <> ''""")
def training_examples(t: Tables) -> DataFrame:
    return training.examples(t.documents, "doc_id", F.lit(None).cast("string"), C("lang"), C("text"))


@query("""SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_replace(line, '\\s+', '', 'g') <> '' AND NOT starts_with(line, 'Edition:') GROUP BY line""")
def tokenizer_corpus(t: Tables) -> DataFrame:
    return training.tokenizer_corpus(t.documents, "text").groupBy("line").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, CASE WHEN row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= floor(count(*) OVER (PARTITION BY c_nationkey) * 0.8) THEN 'train' ELSE 'validation' END AS split FROM customer""")
def train_split(t: Tables) -> DataFrame:
    return training.positional_split(t.customer, "c_nationkey", "c_custkey").select("c_custkey", "split")


@query("""SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS moving_average FROM events""")
def step_moving_average(t: Tables) -> DataFrame:
    return training.moving_average(t.events, "user_id", "event_id", "value", 5).select("event_id", F.round("moving_average", 6).alias("moving_average"))
