"""Record fields, addresses, text functions and nested search, on whole tables or on rows that hold every branch of a rule.

A rule whose input no table holds is stated on ``VALUES`` rows: the same rows go to the plan and to the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, document, images, notes, text
from ..operators import clusters, evaluate, index, relational, search, training
from ..sources import exchange
from .registry import Tables, query
from .search_queries import FIELDS, TEXT, _bm25

C = F.col


def literal(value) -> str:
    """A Python value as DuckDB SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, dict):
        return "{" + ", ".join(f"'{k}': {literal(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ", ".join(map(literal, value)) + "]"
    return "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    return f"t({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + ")"


NOTES = [
    (1, "Location: Cambridge University Library\nClassmark: T-S 8J22.25\nProvenance: Taylor-Schechter Genizah Collection, given in 1898\nDonated by: Schechter, Solomon (Prof), 1847-1915; Taylor, Charles, 1840-1908; Nobody"),
    (2, "  Location: Trinity College, Cambridge \n\nClassmark: Or.1080 J1\nProvenance: bought 1923 and 2001\nDonated by: Lewis, Agnes"),
    (3, "Location: Princeton, a British Library loan\nClassmark: Add.3430\nDonated by: ;  ; x"),
    (4, "Location: Bodleian, Oxford\nClassmark: MS Heb. c 1"),
    (5, "Location: The British Library\nProvenance: Genizah Collection, number 18981"),
    (6, "Location: Elsewhere\nProvenance: taylor-schechter\nClassmark: Or.1\nDonated by: A, B, 1900-1950"),
    (7, "Location: Cambridge University Library\nLocation: Oxford\nClassmark: Or.2\nProvenance: Taylor-Schechter 1901\nProvenance: unknown\nDonated by: C, D\nDonated by: none"),
    (8, ""),
    (9, None),
    (10, "Remark: Location: nowhere\nDonation of 1899"),
]
_REST = lambda name: f"list_transform(list_filter(lines, lambda x: starts_with(x, '{name}')), lambda x: trim(replace(x, '{name}', '')))"
_INSTITUTION = "CASE WHEN contains(lower(x), 'cambridge') THEN 'cambridge' WHEN contains(lower(x), 'princeton') THEN 'princeton' WHEN contains(lower(x), 'oxford') THEN 'oxford' WHEN contains(lower(x), 'british library') THEN 'british_library' ELSE 'other' END"
_GIFT = "'^([^,]+),\\s*([^,]+),?\\s*(\\d{4}-\\d{4})?'"


@query(f"""WITH {values(NOTES, "id, notes")},
    l AS (SELECT id, list_filter(list_transform(string_split(trim(notes, ' ' || chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM t),
    p AS (SELECT id, lines, {_REST("Location:")} AS loc, {_REST("Classmark:")} AS cm, {_REST("Provenance:")} AS pr, {_REST("Donated by:")} AS dn FROM l),
    g AS (SELECT *, list_filter(list_transform(dn, lambda d: list_transform(list_filter(list_transform(string_split(d, ';'), lambda y: trim(y)), lambda y: regexp_matches(y, {_GIFT})), lambda y: [trim(regexp_extract(y, {_GIFT}, 1)), trim(regexp_extract(y, {_GIFT}, 2)), regexp_extract(y, {_GIFT}, 3)])), lambda d: len(d) > 0) AS gifts FROM p)
    SELECT id, loc[-1] AS physical_location, list_transform(loc, lambda x: {_INSTITUTION})[-1] AS institution,
        list_filter(list_transform(loc, lambda x: CASE {_INSTITUTION} WHEN 'cambridge' THEN CASE WHEN contains(lower(x), 'university library') THEN 'cambridge_university_library' END WHEN 'british_library' THEN 'british_library' END), lambda x: x IS NOT NULL)[-1] AS library,
        cm[-1] AS classmark,
        list_transform(list_filter(lines, lambda x: starts_with(x, 'Classmark:') OR (starts_with(x, 'Provenance:') AND contains(lower(x), 'taylor-schechter'))), lambda x: CASE WHEN starts_with(x, 'Provenance:') OR starts_with(trim(replace(x, 'Classmark:', '')), 'T-S') THEN 'taylor_schechter' WHEN starts_with(trim(replace(x, 'Classmark:', '')), 'Or.') THEN 'oriental' WHEN starts_with(trim(replace(x, 'Classmark:', '')), 'Add.') THEN 'additional' ELSE 'other' END)[-1] AS collection,
        pr[-1] AS provenance, list_filter(list_transform(pr, lambda x: regexp_extract(x, '\\b((18|19|20)\\d{{2}})\\b', 1)), lambda x: x <> '')[-1] AS donation_year,
        CASE WHEN len(list_filter(pr, lambda x: contains(lower(x), 'genizah collection'))) > 0 THEN 'genizah' END AS collection_type, dn[-1] AS donors,
        array_to_string(list_transform(gifts[-1], lambda d: array_to_string(d, '|')), ';') AS donor_details, CASE WHEN len(gifts) > 0 THEN array_to_string(list_transform(flatten(gifts), lambda d: lower(d[1])), ',') END AS donor_surnames
    FROM g""")
def notes_record(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame(NOTES, "id int, notes string").select("id", notes.notes_record(C("notes")).alias("n")).select("id", "n.*")
    shown = F.array_join(F.transform("donor_details", lambda d: F.concat_ws("|", d["surname"], d["first_names"], F.coalesce(d["dates"], F.lit("")))), ";")
    return rows.withColumns({"donor_details": shown, "donor_surnames": F.array_join("donor_surnames", ",")})


DESCRIPTIONS = [(1, "Description A legal Letter and a contract"), (2, "fragment of a poem."), (3, "Descriptionbible commentary"), (4, ""), (5, None), (6, "Magical  letters\tletter")]
_TYPES = literal(notes.DESCRIPTION_TYPES)


@query(f"""WITH {values(DESCRIPTIONS, "id, raw")},
    c AS (SELECT id, raw, CASE WHEN starts_with(raw, 'Description') THEN trim(substr(raw, 12)) ELSE raw END AS d FROM t),
    f AS (SELECT *, list_filter({_TYPES}, lambda x: list_contains(regexp_split_to_array(lower(d), '\\s+'), x)) AS found FROM c)
    SELECT id, nullif(d, '') AS description, coalesce(raw <> '', false) AS has_description, CASE WHEN len(found) > 0 THEN array_to_string(found, ',') END AS document_types, CASE WHEN raw <> '' THEN found[1] END AS primary_document_type FROM f""")
def description_fields(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame(DESCRIPTIONS, "id int, raw string").select("id", notes.description_fields(C("raw")).alias("d")).select("id", "d.*")
    return rows.withColumn("document_types", F.array_join("document_types", ","))


@query("""WITH s AS (SELECT conv_id, count(*)::INTEGER AS sections, flatten(list(coalesce(list_filter(string_split(text, chr(10)), lambda x: x <> ''), []) ORDER BY turn)) AS lines, array_to_string(list(role ORDER BY turn) FILTER (role IS NOT NULL), ',') AS editors FROM conversations GROUP BY conv_id)
    SELECT conv_id, sections, len(lines)::INTEGER AS total_lines, editors, md5(array_to_string(lines, ' ')) AS text_md5, CASE WHEN len(lines) = 0 THEN 'none' WHEN len(lines) < 5 THEN 'minimal' WHEN len(lines) < 15 THEN 'partial' ELSE 'complete' END AS completeness FROM s""")
def transcription_summary(t: Tables) -> DataFrame:
    turns = F.sort_array(F.collect_list(F.struct("turn", C("role").alias("name"), F.split("text", "\n").alias("lines"))))
    rows = t.conversations.groupBy("conv_id").agg(turns.alias("s")).select("conv_id", notes.transcription_summary(C("s")).alias("x"))
    return rows.select("conv_id", C("x.count").alias("sections"), "x.total_lines", F.array_join("x.editors", ",").alias("editors"), F.md5("x.full_text").alias("text_md5"), "x.completeness")


PICTURES = [
    (1, [{"k": "Side", "v": "Recto"}, {"k": "Page", "v": "1r"}, {"k": "Width", "v": "10.9"}, {"k": "height_mm", "v": "many"}, {"k": "Height", "v": "20"}]),
    (2, [{"k": "label", "v": "folio 2 VERSO"}, {"k": "folio", "v": "2"}]),
    (3, [{"k": "x", "v": "y"}]),
    (4, [{"k": "width", "v": "-3"}, {"k": "page no", "v": "7"}, {"k": "inside", "v": "A"}]),
]
_FIRST_ENTRY = lambda test: f"list_filter(m, lambda e: {test})[1].v"
_SIZE = lambda n: f"list_filter(list_transform(list_filter(m, lambda e: contains(lower(e.k), '{n}')), lambda e: trunc(try_cast(e.v AS DOUBLE))::INTEGER), lambda x: x IS NOT NULL)[1]"


@query(f"""WITH {values(PICTURES, "id, m")} SELECT id, lower({_FIRST_ENTRY("contains(lower(e.k), 'side') OR contains(lower(e.v), 'recto') OR contains(lower(e.v), 'verso')")}) AS side,
    {_FIRST_ENTRY("contains(lower(e.k), 'folio') OR contains(lower(e.k), 'page')")} AS folio, ({_SIZE("width")})::VARCHAR AS width, ({_SIZE("height")})::VARCHAR AS height FROM t""")
def image_probes(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame([(i, [(e["k"], e["v"]) for e in m]) for i, m in PICTURES], "id int, m array<struct<k:string,v:string>>")
    return rows.select("id", images.image_side(C("m")).alias("side"), images.image_folio(C("m")).alias("folio"), images.image_dimension(C("m"), "width").cast("string").alias("width"), images.image_dimension(C("m"), "height").cast("string").alias("height"))


ALIGNED = [(1, ["a.jpg", "b.jpg", "c.jpg"], ["x", "y"]), (2, ["d.png"], ["p", "q"]), (3, ["e.tif"], None)]


@query(f"""WITH {values(ALIGNED, "id, urls, meta")}, u AS (SELECT id, meta, unnest(urls) AS url, generate_subscripts(urls, 1) AS image_order FROM t) SELECT id, image_order::INTEGER AS image_order, url, meta[image_order] AS metadata FROM u""")
def image_metadata_aligned(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame(ALIGNED, "id int, urls array<string>, meta array<string>")
    return rows.select("id", F.explode(images.aligned_images(C("urls"), C("meta"))).alias("x")).select("id", "x.image_order", "x.url", "x.metadata")


ADDRESSES = [
    (1, "https://images.example.org/view/MS-TS-AS-00012-00034/1-000-00001"), (2, "https://images.example.org/MS-TS-NS-00012-00034-000-00002.jpg"), (3, "https://images.example.org/view/MS-TS-AS-00012-00034"), (4, "https://elsewhere.example.org/x.png"),
    (5, "/1-000-00001"), (6, None),
]
_MARK = "regexp_extract(url, 'MS-[A-Z]+-[A-Z]+-\\d{5}-\\d{5}')"
_FULL = f"coalesce(CASE WHEN contains(url, '/1-000-00001') THEN nullif({_MARK}, '') || '-' || nullif(regexp_extract(url, '/(\\d+-\\d{{3}}-\\d{{5}})', 1), '') END, nullif(regexp_extract(url, 'MS-[A-Z]+-[A-Z]+-\\d{{5}}-\\d{{5}}-\\d{{3}}-\\d{{5}}'), ''))"


@query(f"""WITH {values(ADDRESSES, "id, url")} SELECT id, nullif({_MARK}, '') AS shelf_mark, {_FULL} AS full_id, 'https://store.example.org/raw/' || {_FULL} || '.jpg' AS stored, coalesce(nullif(regexp_extract(url, 'MS-TS-AS-\\d{{5}}-\\d{{5}}'), ''), 'unknown-shelfmark') AS series FROM t""")
def address_ids(t: Tables) -> DataFrame:
    u = C("url")
    rows = t.spark.createDataFrame(ADDRESSES, "id int, url string")
    return rows.select("id", images.mark_in(u).alias("shelf_mark"), images.full_id_in(u).alias("full_id"), images.stored_address(u, "https://store.example.org/raw").alias("stored"), images.series_mark(u).alias("series"))


RECORDS = [
    (1, "T-S 1", "a/b", "i", None, None, "r"), (2, "", "MS-X/7", "i", None, None, "r"), (3, None, "plain", "i", None, None, "r"), (4, None, "", "idno 4", "https://x/MS-TS-AS-00001-00002", "j", "r"),
    (5, None, None, None, "https://x/MS-TS-AS-00001-00002", "j", "r"), (6, None, None, "", "https://x/", "joined", "r"), (7, None, None, None, None, None, "raw"), (8, None, None, None, None, None, ""),
]


@query(f"""WITH {values(RECORDS, "id, mark, doc_id, idno, url, joined, raw_id")} SELECT id, coalesce(nullif(mark, ''), split_part(nullif(doc_id, ''), '/', 1), nullif(idno, ''), nullif({_MARK}, ''), joined, nullif(raw_id, '')) AS shelf_mark FROM t""")
def record_marks(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame(RECORDS, "id int, mark string, doc_id string, idno string, url string, joined string, raw_id string")
    return rows.select("id", images.record_mark(C("mark"), C("doc_id"), C("idno"), C("url"), C("joined"), C("raw_id")).alias("shelf_mark"))


@query("""SELECT doc_id, md5(trim(text, ' .,')) AS bare, md5(replace(replace(text, 'the', 'THE'), 'THE ', '_')) AS replaced, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '...' ELSE text END AS short,
    len(list_filter(regexp_split_to_array(text, '[\\x09-\\x0D ]+'), lambda x: x <> ''))::INTEGER AS words, upper(lang[1]) || lower(lang[2:]) || ' ' || upper(source[1]) || lower(source[2:]) AS title,
    regexp_replace(translate(lang || '/' || source || ':v1.0 (x)', '/:. ', '____'), '[^A-Za-z0-9_-]', '', 'g') AS folder, source AS editor, 'Read ' || source || ' in ' || lang AS prompt, substr(text, 1, 77) AS model_input,
    concat_ws(chr(10), 'Description: ' || nullif(trim(source), ''), 'Text: ' || CASE WHEN lang = 'en' THEN lang END, 'Translation: ' || CASE WHEN doc_id % 2 = 0 THEN lang END) AS labelled FROM documents""")
def text_functions(t: Tables) -> DataFrame:
    x, lang, source = C("text"), C("lang"), C("source")
    return t.documents.select(
        "doc_id", F.md5(text.strip_set(x, " .,")).alias("bare"), F.md5(text.multi_replace(x, [("the", "THE"), ("THE ", "_")])).alias("replaced"), text.truncate(x, 40).alias("short"), F.size(text.words(x)).alias("words"),
        text.title_case(F.concat(lang, F.lit("_"), source)).alias("title"), text.directory_name(F.concat(lang, F.lit("/"), source, F.lit(":v1.0 (x)"))).alias("folder"), text.editor_name(F.concat(F.lit("Editor: "), source)).alias("editor"),
        text.prompt("Read %s in %s", source, lang).alias("prompt"), notes.model_input(x).alias("model_input"), notes.multilingual_text(source, F.when(lang == "en", lang), F.when(C("doc_id") % 2 == 0, lang)).alias("labelled"),
    )


#: Label, and what becomes of it: number, label kept, id.
PAGE_LABELS = [("12", 12, None, "book_p012"), (" 7 ", 7, None, "book_p007"), ("xiv", 14, None, "book_p014"), ("MCMXC", 1990, None, "book_p1990"), ("front cover", 0, "front cover", "book_pfront_cover"), ("0", 0, None, "book_p000"), ("iiz", 0, "iiz", "book_piiz")]


@query(f"""WITH {values(PAGE_LABELS, "raw, number, label, doc_id")} SELECT * FROM t""")
def page_labels(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame([(r[0],) for r in PAGE_LABELS], "raw string").withColumn("n", text.page_number(C("raw")))
    return rows.select("raw", "n.number", "n.label", text.page_doc_id(F.lit("book"), C("n.number"), C("n.label")).alias("doc_id"))


#: Date text, and what the rules make of it: period of a century, first and last year, donation year.
DATE_TEXTS = [("11th century", "early_medieval", None, None, None), ("1401/1499", "late_medieval", 1401, 1499, None), ("given 1899, 1901", "early_modern", None, None, 1899), ("900/x", "unknown", None, None, None), ("0932/0941", "unknown", 932, 941, None), ("91899", "early_modern", None, None, None)]


@query(f"""WITH {values(DATE_TEXTS, "raw, period, start_year, end_year, donation_year")} SELECT raw, period, start_year::VARCHAR AS start_year, end_year::VARCHAR AS end_year, donation_year::VARCHAR AS donation_year FROM t""")
def date_rules(t: Tables) -> DataFrame:
    c = C("raw")
    rows = t.spark.createDataFrame([(r[0],) for r in DATE_TEXTS], "raw string").withColumn("g", dates.graph_period(c))
    return rows.select("raw", dates.period_class(c).alias("period"), C("g.start_year").cast("string").alias("start_year"), C("g.end_year").cast("string").alias("end_year"), dates.donation_year(c).cast("string").alias("donation_year"))


@query("""SELECT event_id, coalesce(epoch(try_cast(CASE WHEN event_id % 5 = 0 THEN 'no date' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP)), -1)::BIGINT AS entered, CASE WHEN event_type = 'error' THEN 1735689600 ELSE epoch(date_trunc('second', ts))::BIGINT END AS updated FROM events""")
def time_stamps(t: Tables) -> DataFrame:
    seconds = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    rows = t.events.withColumn("updated_at", F.date_trunc("second", C("ts").cast("timestamp")))
    rows = relational.stamped(rows, C("event_type") == "error", "2025-01-01 00:00:00")
    entered = dates.timestamp(F.when(C("event_id") % 5 == 0, "no date").otherwise(seconds))
    return rows.select("event_id", F.coalesce(F.unix_seconds(entered), F.lit(-1)).alias("entered"), F.unix_seconds("updated_at").alias("updated"))


MODELS = [("text-small", 384, "idx_small"), ("text-large", 1024, "idx_large"), ("image", 768, "idx_image")]


@query(f"""WITH {values(MODELS, "model_name, dimensions, index_name")} SELECT model_name, dimensions, index_name, sha256(model_name) AS model_id FROM t""")
def model_seed_rows(t: Tables) -> DataFrame:
    return relational.embedding_models(t.spark, MODELS)


@query("""SELECT lang, count(*) AS documents, count_if(length(trim(text)) > 10)::BIGINT AS with_truth, count_if(n_chars >= 4000)::BIGINT AS high, count_if(n_chars >= 3000 AND n_chars < 4000)::BIGINT AS medium FROM documents GROUP BY lang""")
def truth_and_quality(t: Tables) -> DataFrame:
    quality = document.metadata_quality(C("n_chars") / 5000)
    return t.documents.groupBy("lang").agg(F.count("*").alias("documents"), F.count_if(evaluate.has_truth("text")).alias("with_truth"), F.count_if(quality == "high").alias("high"), F.count_if(quality == "medium").alias("medium"))


@query("""SELECT p_partkey, p_type FROM part WHERE trim(CASE WHEN p_partkey % 3 = 0 THEN '  ' ELSE p_type END) <> ''""")
def blank_marks_skipped(t: Tables) -> DataFrame:
    return t.part.where(text.not_blank(F.when(C("p_partkey") % 3 == 0, "  ").otherwise(C("p_type")))).select("p_partkey", "p_type")


@query("""SELECT doc_id, len(y)::INTEGER AS numbers, array_to_string(y[1:5], ',') AS first_numbers FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS y FROM documents) WHERE len(y) > 0 ORDER BY doc_id LIMIT 5""")
def first_with_lists(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.regexp_extract_all("text", F.lit("([0-9]+)"), F.lit(1)).alias("y")).where(F.size("y") > 0)
    return exchange.first_rows(rows, ["doc_id"], 5).select("doc_id", F.size("y").alias("numbers"), F.array_join(notes.few(C("y")), ",").alias("first_numbers"))


@query("""SELECT source, count_if(length(text) > 0)::BIGINT AS has_full_text, count_if(NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id))::BIGINT AS needs_embedding FROM documents GROUP BY source""")
def partial_index_predicates(t: Tables) -> DataFrame:
    done = t.embeddings.select(C("vec_id").alias("doc_id"), F.lit(True).alias("done")).distinct()
    rows = t.documents.join(done, "doc_id", "left")
    return rows.groupBy("source").agg(F.count_if(text.nonempty(C("text"))).alias("has_full_text"), F.count_if(C("done").isNull()).alias("needs_embedding"))


@query("""SELECT doc_id, nullif(n_chars % 97, 0) AS score FROM documents ORDER BY score DESC NULLS LAST, doc_id LIMIT 100""")
def top_nulls_last(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.nullif(C("n_chars") % 97, F.lit(0)).alias("score")).orderBy(F.desc_nulls_last("score"), "doc_id").limit(100)


@query("""SELECT lang, count(*) AS n, round(avg(n_chars % 100 / 100.0), 6) AS avg_similarity, min(n_chars % 100 / 100.0)::DOUBLE AS min_similarity, max(n_chars % 100 / 100.0)::DOUBLE AS max_similarity, round(avg(length(source)), 6) AS avg_pred_length, round(avg(length(text)), 6) AS avg_target_length FROM documents GROUP BY lang""")
def evaluation_summary(t: Tables) -> DataFrame:
    rows = t.documents.withColumn("similarity", C("n_chars") % 100 / 100.0)
    out = evaluate.length_summary(rows, ["lang"], "similarity", "source", "text")
    return out.withColumns({c: F.round(c, 6) for c in ("avg_similarity", "avg_pred_length", "avg_target_length")})


@query("""WITH c AS (SELECT vec_id % 4 AS cluster, label::VARCHAR AS category, count(*) AS n FROM embeddings WHERE vec_id % 4 <> 2 GROUP BY ALL),
    s AS (SELECT cluster, sum(n)::BIGINT AS total, array_to_string(list(category || ':' || n ORDER BY category), ',') AS categories, list(category ORDER BY n DESC, category)[1] AS dominant, max(n) / sum(n) AS purity FROM c GROUP BY cluster)
    SELECT r.range AS cluster, coalesce(total, 0)::BIGINT AS total, coalesce(categories, '') AS categories, dominant, coalesce(purity, 0)::DOUBLE AS purity FROM range(5) r LEFT JOIN s ON r.range = s.cluster""")
def cluster_categories(t: Tables) -> DataFrame:
    rows = t.embeddings.where("vec_id % 4 <> 2").select((C("vec_id") % 4).alias("cluster"), C("label").cast("string").alias("category"))
    out = clusters.category_counts(rows, "cluster", "category", 5)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("categories")), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")
    return out.withColumn("categories", shown)


@query("""SELECT array_to_string(list_sort(list_filter(['1-URGENT', 'NONE', '5-LOW'], lambda x: NOT list_contains(a, x))), ',') AS missing, array_to_string(list_sort(list_filter(a, lambda x: x NOT IN ('1-URGENT', 'NONE', '5-LOW'))), ',') AS unexpected FROM (SELECT list(DISTINCT o_orderpriority) AS a FROM orders)""")
def category_checks(t: Tables) -> DataFrame:
    return clusters.category_checks(t.orders, "o_orderpriority", ["1-URGENT", "NONE", "5-LOW"]).select(F.array_join("missing", ",").alias("missing"), F.array_join("unexpected", ",").alias("unexpected"))


@query("""SELECT label, i::INTEGER AS i, round(avg(v::DOUBLE), 6) AS value FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY label, i""")
def mean_vectors(t: Tables) -> DataFrame:
    rows = clusters.mean_vector(t.embeddings, "label", "embedding")
    return rows.select("label", F.posexplode("mean").alias("i", "value")).withColumn("value", F.round("value", 6))


@query("""SELECT source, round(sum(strlen(text)) / 1048576.0, 6) AS mb, round(count_if(lang = 'en') / count(*), 6) AS hit_rate, 0.0::DOUBLE AS empty_rate, CASE WHEN count(*) <= 30 THEN greatest(1, count(*) // 3) ELSE 30 END::INTEGER AS perplexity FROM documents GROUP BY source""")
def run_rates(t: Tables) -> DataFrame:
    rows = t.documents.groupBy("source").agg(F.sum(F.octet_length("text")).alias("b"), F.count_if(C("lang") == "en").alias("hits"), F.count("*").alias("n"))
    return rows.select("source", F.round(notes.megabytes(C("b")), 6).alias("mb"), F.round(notes.rate(C("hits"), C("n")), 6).alias("hit_rate"), notes.rate(C("n"), F.lit(0)).alias("empty_rate"), notes.perplexity(C("n")).cast("int").alias("perplexity"))


@query("""SELECT CASE WHEN ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 1000 < 900 THEN 'train' ELSE 'validation' END AS split, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY 1""")
def random_split(t: Tables) -> DataFrame:
    return training.hashed_split(t.documents, "doc_id", 0.9).groupBy("split").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


_DAY = "(900 + doc_id % 900)::VARCHAR || '-01-01'"
_FULL_WHERE = f"lang = 'en' AND {_DAY} >= '1100-01-01' AND {_DAY} <= '990-01-01' AND len(string_split(text, chr(10))) > 1 AND n_chars / (n_chars + 1000) >= 0.3"


def _filterable(t: Tables) -> DataFrame:
    lines = F.split("text", "\n")
    return t.documents.withColumns({"main_language": C("lang"), "date_start": F.concat((900 + C("doc_id") % 900).cast("string"), F.lit("-01-01")), "transcriptions": F.slice(lines, 2, 1 << 30), "completeness_score": C("n_chars") / (C("n_chars") + 1000)})


@query(_bm25(_FULL_WHERE) + ", n AS (SELECT count(*) AS total, max(score) AS m FROM lex) SELECT lex.doc_id AS id, round(score, 6) AS score, source, total, round(m, 6) AS max_score FROM lex JOIN documents ON lex.doc_id = documents.doc_id, n ORDER BY score DESC, lex.doc_id LIMIT 50")
def search_filtered_full(t: Tables) -> DataFrame:
    docs = _filterable(t).where(search.filters(language="en", date_from="1100-01-01", date_to="990-01-01", has_transcriptions=True, min_completeness=0.3))
    found = index.hits(search.lexical(docs, "doc_id", FIELDS, TEXT), docs.select("doc_id", "source"), "doc_id", 50)
    return found.select("id", F.round("score", 6).alias("score"), C("source.source").alias("source"), "total", F.round("max_score", 6).alias("max_score"))


@query(_bm25() + " SELECT doc_id AS doc, round(score, 6) AS score FROM lex ORDER BY lex.score DESC, doc_id LIMIT 100")
def search_indexed(t: Tables) -> DataFrame:
    built = index.build_index(t.documents, "doc_id", [f for f, _ in FIELDS], exchange.scratch_folder(t.spark, "index"))
    return search.top(index.lexical_indexed(t.spark, built, FIELDS, TEXT), 100).withColumn("score", F.round("score", 6))


@query("""SELECT DISTINCT conv_id FROM conversations WHERE role = 'user' AND list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+'), 'the')""")
def search_nested(t: Tables) -> DataFrame:
    nested = t.conversations.groupBy("conv_id").agg(F.collect_list(F.struct("role", "text")).alias("turns"))
    return index.nested(nested, "turns", lambda e: (e["role"] == "user") & index.has_term(e["text"], "the")).select("conv_id")


@query("""WITH p AS (SELECT p_partkey, string_split(p_name || ' ' || p_type, ' ') AS w FROM part) SELECT p_partkey, list_has_any(w, ['ECONOMY', 'cold']) AS either, list_has_all(w, ['ECONOMY', 'cold']) AS both, list_contains(w, 'widget') AS widget FROM p""")
def search_arrays(t: Tables) -> DataFrame:
    w = F.split(F.concat_ws(" ", "p_name", "p_type"), " ")
    return t.part.select("p_partkey", index.mentions(w, ["ECONOMY", "cold"]).alias("either"), index.mentions(w, ["ECONOMY", "cold"], every=True).alias("both"), F.array_contains(w, "widget").alias("widget"))


@query("""SELECT doc_id, len(list_distinct(w))::INTEGER AS tokens FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+') AS w FROM documents) WHERE list_has_all(w, ['and', 'the'])""")
def search_tokens(t: Tables) -> DataFrame:
    return index.token_column(t.documents, "text").where(index.token_match(C("tokens"), "the and")).select("doc_id", F.size("tokens").alias("tokens"))


@query("""SELECT 'batch_' || floor((row_number() OVER (ORDER BY doc_id) - 1) / 100)::BIGINT || '_run1' AS batch, doc_id, lang FROM documents""")
def jsonl_batches(t: Tables) -> DataFrame:
    folder = exchange.scratch_folder(t.spark, "jsonl") + "/batches"
    exchange.write_batches(t.documents.select("doc_id", "lang"), folder, "doc_id", 100, "run1")
    return t.spark.read.schema("doc_id long, lang string, batch string").json(folder).select("batch", "doc_id", "lang")


@query("""SELECT source, count(*) AS total_pages, count_if(length(trim(coalesce(text, ''))) > 0)::BIGINT AS pages_with_text, coalesce(sum(length(text)), 0)::BIGINT AS characters, printf('page_%03d_structured.json', (min(doc_id) % 1000)::INTEGER) AS first_page FROM documents GROUP BY source""")
def page_summaries(t: Tables) -> DataFrame:
    first = t.documents.groupBy("source").agg(exchange.page_file((F.min("doc_id") % 1000).cast("int")).alias("first_page"))
    return exchange.page_summary(t.documents, "source", "text").join(first, "source")


@query("""SELECT doc_id, '{"doc_id":' || doc_id || ',"lang":"' || lang || '"' || CASE WHEN n_chars % 2 = 0 THEN ',"size":' || n_chars ELSE '' END || '}' AS export FROM documents""")
def export_rows(t: Tables) -> DataFrame:
    rows = t.documents.withColumn("size", F.when(C("n_chars") % 2 == 0, C("n_chars")))
    return rows.select("doc_id", exchange.export_row(rows, ["doc_id", "lang", "size", "absent"]).alias("export"))


TARGETS = [("/a/b.json", "/a/b_text.txt"), ("/a/folder", "/a/folder/extracted_text.txt"), ("/a/folder/", "/a/folder/extracted_text.txt"), ("x.jsonl", "x.jsonl/extracted_text.txt")]


@query(f"""WITH {values(TARGETS, "path, target")} SELECT * FROM t""")
def text_targets(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(p,) for p, _ in TARGETS], "path string").select("path", exchange.text_target(C("path")).alias("target"))


@query("""SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS around FROM events""")
def context_window(t: Tables) -> DataFrame:
    near = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-2, 2)
    return t.events.select("user_id", "event_id", F.round(F.avg("value").over(near), 6).alias("around"))
