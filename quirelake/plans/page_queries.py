"""Pages of literature: ``conversations`` are books, their turns pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import pages
from .registry import Tables, query

C = F.col


def _joined(t: Tables) -> DataFrame:
    structured = t.conversations.select("conv_id", C("turn").alias("page_number"))
    ocr = t.conversations.where("role <> 'system'").select("conv_id", C("turn").alias("page_number"), C("text").alias("full_text"))
    return pages.rejoin(structured, ocr, ["conv_id", "page_number"])


@query("SELECT conv_id, turn AS page_number, CASE WHEN role <> 'system' THEN text ELSE '' END AS full_main_text, role <> 'system' AS found FROM conversations")
def page_ocr_rejoin(t: Tables) -> DataFrame:
    return _joined(t)


@query("SELECT count(*) AS pages, count_if(role <> 'system')::BIGINT AS matched, count_if(role = 'system')::BIGINT AS missing FROM conversations")
def page_rejoin_stats(t: Tables) -> DataFrame:
    return pages.rejoin_stats(_joined(t))


_ROMAN_TEXT = "CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 500)::VARCHAR WHEN 1 THEN ['i','iv','XII','xxxix','MCMXC','xl','CDXLIV'][(o_orderkey % 7 + 1)::INTEGER] WHEN 2 THEN 'plate ' || (o_orderkey % 9)::VARCHAR ELSE ' ' || (o_orderkey % 50)::VARCHAR || ' ' END"
_ROMAN_VALUES = "CASE upper(l) WHEN 'I' THEN 1 WHEN 'IV' THEN 4 WHEN 'XII' THEN 12 WHEN 'XXXIX' THEN 39 WHEN 'MCMXC' THEN 1990 WHEN 'XL' THEN 40 WHEN 'CDXLIV' THEN 444 END"


def _labels(t: Tables) -> DataFrame:
    o = C("o_orderkey")
    roman = F.element_at(F.array(*[F.lit(x) for x in ("i", "iv", "XII", "xxxix", "MCMXC", "xl", "CDXLIV")]), (o % 7 + 1).cast("int"))
    raw = F.when(o % 4 == 0, (o % 500).cast("string")).when(o % 4 == 1, roman).when(o % 4 == 2, F.concat(F.lit("plate "), o % 9)).otherwise(F.concat(F.lit(" "), o % 50, F.lit(" ")))
    return t.orders.select("o_orderkey", raw.alias("raw"))


@query(f"SELECT o_orderkey, coalesce(TRY_CAST(l AS INTEGER), {_ROMAN_VALUES}, 0)::INTEGER AS number, CASE WHEN TRY_CAST(l AS INTEGER) IS NULL AND {_ROMAN_VALUES} IS NULL THEN l END AS label FROM (SELECT o_orderkey, trim({_ROMAN_TEXT}) AS l FROM orders)")
def page_number_parse(t: Tables) -> DataFrame:
    return _labels(t).select("o_orderkey", text.page_number(C("raw")).alias("p")).select("o_orderkey", "p.number", "p.label")


@query(f"SELECT o_orderkey, ({_ROMAN_VALUES})::INTEGER AS value FROM (SELECT o_orderkey, trim({_ROMAN_TEXT}) AS l FROM orders)")
def roman_to_int(t: Tables) -> DataFrame:
    return _labels(t).select("o_orderkey", text.roman_to_int(C("raw")).alias("value"))


@query(f"""SELECT o_orderkey, CASE WHEN n = 0 AND NOT regexp_matches(l, '^[0-9]+$') THEN 'book_p' || replace(l, ' ', '_') ELSE 'book_p' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END END AS page_id
    FROM (SELECT o_orderkey, l, coalesce(TRY_CAST(l AS INTEGER), {_ROMAN_VALUES}, 0) AS n FROM (SELECT o_orderkey, trim({_ROMAN_TEXT}) AS l FROM orders))""")
def page_doc_id(t: Tables) -> DataFrame:
    rows = _labels(t).select("o_orderkey", text.page_number(C("raw")).alias("p"))
    return rows.select("o_orderkey", text.page_doc_id(F.lit("book"), C("p.number"), C("p.label")).alias("page_id"))


@query("""SELECT conv_id, turn, nullif(regexp_extract(f, '(?i)page[_-](\\d+)', 1), '')::INTEGER AS page FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Page_' || turn || '.png' WHEN 1 THEN 'x-page-00' || turn || '.jpg' ELSE 'scan' || turn END AS f FROM conversations)""")
def file_page_number(t: Tables) -> DataFrame:
    name = F.when(C("turn") % 3 == 0, F.concat(F.lit("Page_"), "turn", F.lit(".png"))).when(C("turn") % 3 == 1, F.concat(F.lit("x-page-00"), "turn", F.lit(".jpg"))).otherwise(F.concat(F.lit("scan"), "turn"))
    return t.conversations.select("conv_id", "turn", text.file_page_number(name).alias("page"))


_WORD = "[A-Z][a-z]{7,}"


@query(f"""SELECT mark, list_sort(list(DISTINCT turn)) AS pages FROM (SELECT unnest(regexp_extract_all(text, '{_WORD}')) AS mark, turn FROM conversations) GROUP BY mark""")
def shelfmark_patterns(t: Tables) -> DataFrame:
    rows = t.conversations.select(F.regexp_extract_all("text", F.lit(f"({_WORD})"), F.lit(1)).alias("marks"), "turn")
    return pages.mark_pages(rows, "marks", "turn")


@query(f"""WITH m AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_WORD}')) AS mark FROM conversations WHERE role = 'user'), x AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_WORD}')) AS mark FROM conversations WHERE role = 'assistant')
    SELECT mark, 'mentioned' AS side FROM m WHERE mark NOT IN (SELECT mark FROM x) UNION ALL SELECT mark, 'transcribed' FROM x WHERE mark NOT IN (SELECT mark FROM m)""")
def unlinked_mentions(t: Tables) -> DataFrame:
    marks = lambda role: t.conversations.where(C("role") == role).select(F.explode(F.regexp_extract_all("text", F.lit(f"({_WORD})"), F.lit(1))).alias("mark"))
    return pages.unlinked(marks("user"), marks("assistant"), "mark")


@query("""SELECT conv_id, turn, 'img/' || conv_id || '/' || CASE turn % 2 WHEN 0 THEN 'page_' || CASE WHEN turn < 1000 THEN lpad(turn::VARCHAR, 3, '0') ELSE turn::VARCHAR END || '.jpg' ELSE turn::VARCHAR || '.png' END AS image_path FROM conversations""")
def page_images(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn")
    name = F.when(C("turn") % 2 == 0, F.format_string("page_%03d.jpg", "turn")).otherwise(F.concat("turn", F.lit(".png")))
    listing = rows.select("conv_id", name.alias("name")).withColumn("path", F.concat(F.lit("img/"), "conv_id", F.lit("/"), "name"))
    return pages.image_for_page(rows, listing.distinct(), "conv_id", "turn").select("conv_id", "turn", "image_path")


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN contains(lower(event_type), 'err') THEN 'validation' WHEN event_type = 'click' THEN 'api' ELSE 'other' END AS kind FROM events) GROUP BY kind""")
def error_categories(t: Tables) -> DataFrame:
    message = F.when(C("event_type") == "error", "Validation failed").when(C("event_type") == "click", "API timeout").otherwise("unknown")
    return t.events.select(pages.error_kind(message).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, turn, regexp_replace(text, '\\s+', ' ', 'g') AS body FROM conversations""")
def fenced_json(t: Tables) -> DataFrame:
    fenced = F.concat(F.lit("note ```json\n"), text.normalise_space(C("text")), F.lit("\n``` end"))
    return t.conversations.select("conv_id", "turn", text.fenced_json(fenced).alias("body"))
