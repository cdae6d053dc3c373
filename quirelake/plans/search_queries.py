"""Ranked search over ``documents`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import search
from .registry import Tables, query

C = F.col
TEXT = "the house of letters"
FIELDS = [("text", 1.0), ("source", 2.0)]


def _bm25(where: str = "true") -> str:
    terms = ", ".join(f"'{t}'" for t in search.query_terms(TEXT))
    return f"""
    WITH f AS (SELECT doc_id, 'text' AS field, 1.0 AS boost, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+') AS tok FROM documents WHERE {where} UNION ALL SELECT doc_id, 'source', 2.0, regexp_extract_all(lower(source), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+') FROM documents WHERE {where}),
    l AS (SELECT doc_id, field, boost, len(tok)::DOUBLE AS dl, tok FROM f), s AS (SELECT field, count(*) AS n, avg(dl) AS avgdl FROM l WHERE dl > 0 GROUP BY field),
    tf AS (SELECT doc_id, field, boost, dl, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, field, boost, dl, unnest(tok) AS term FROM l) WHERE term IN ({terms}) GROUP BY ALL),
    d AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
    w AS (SELECT doc_id, field, boost * sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s FROM tf JOIN d USING (field, term) JOIN s USING (field) GROUP BY doc_id, field, boost),
    lex AS (SELECT doc_id, max(s) AS score FROM w GROUP BY doc_id)"""


_QUERY_VECTOR = [1.0 if i % 3 == 0 else -0.5 for i in range(64)]
_COSINE_SQL = f"(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * q[i])) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) / sqrt(list_sum(list_transform(q, lambda x: x * x))) + 1.0)"
_VECTORS = f"(SELECT vec_id, embedding, {_QUERY_VECTOR}::DOUBLE[] AS q FROM embeddings)"


@query(_bm25() + " SELECT doc_id AS doc, round(score, 6) AS score FROM lex ORDER BY score DESC, doc_id LIMIT 100")
def search_lexical_bm25(t: Tables) -> DataFrame:
    return search.top(search.lexical(t.documents, "doc_id", FIELDS, TEXT), 100).withColumn("score", F.round("score", 6))


@query(f"SELECT vec_id AS doc, round({_COSINE_SQL}, 6) AS score FROM {_VECTORS} ORDER BY {_COSINE_SQL} DESC, vec_id LIMIT 100")
def search_semantic_cosine(t: Tables) -> DataFrame:
    return search.top(search.semantic(t.embeddings, "vec_id", "embedding", _QUERY_VECTOR), 100).withColumn("score", F.round("score", 6))


@query(_bm25() + f", sem AS (SELECT vec_id, {_COSINE_SQL} AS score FROM {_VECTORS}) SELECT coalesce(doc_id, vec_id) AS doc, round(coalesce(lex.score, 0) + coalesce(sem.score, 0), 6) AS score FROM lex FULL JOIN sem ON doc_id = vec_id ORDER BY coalesce(lex.score, 0) + coalesce(sem.score, 0) DESC, 1 LIMIT 100")
def search_hybrid(t: Tables) -> DataFrame:
    both = search.hybrid(search.lexical(t.documents, "doc_id", FIELDS, TEXT), search.semantic(t.embeddings, "vec_id", "embedding", _QUERY_VECTOR))
    return search.top(both, 100).withColumn("score", F.round("score", 6))


@query(_bm25("lang = 'en' AND n_chars >= 200") + ", n AS (SELECT count(*) AS total FROM lex) SELECT doc_id AS doc, round(score, 6) AS score, total FROM lex, n ORDER BY lex.score DESC, doc_id LIMIT 50")
def search_filtered(t: Tables) -> DataFrame:
    docs = t.documents.withColumnRenamed("lang", "main_language")
    where = search.filters(language="en") & (C("n_chars") >= 200)
    return search.search(docs, "doc_id", TEXT, FIELDS, where=where, size=50).withColumn("score", F.round("score", 6))


@query("""SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+')) AS term FROM documents) GROUP BY ALL) WHERE regexp_matches(term, '^[a-z0-9_]+$') GROUP BY term""")
def term_statistics(t: Tables) -> DataFrame:
    rows = search.postings(t.documents, "doc_id", ["text"])
    return rows.where(C("term").rlike("^[a-z0-9_]+$")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 7")
def point_lookup(t: Tables) -> DataFrame:
    return search.point_lookup(t.documents, "doc_id", 7).select("doc_id", "lang", "source", "n_chars")


@query("SELECT count(*) AS documents, sum(strlen(text))::BIGINT AS bytes, round(sum(strlen(text)) / 1048576.0, 4) AS mb, count(DISTINCT source) AS sources FROM documents")
def index_stats(t: Tables) -> DataFrame:
    n = F.sum(F.octet_length("text"))
    return t.documents.agg(F.count("*").alias("documents"), n.alias("bytes"), F.round(n / 1048576, 4).alias("mb"), F.count_distinct("source").alias("sources"))


@query(f"""SELECT label, round(avg(c), 6) AS avg_cosine, count(*) AS vectors FROM (SELECT label, {_COSINE_SQL} - 1.0 AS c FROM (SELECT label, embedding, {_QUERY_VECTOR}::DOUBLE[] AS q FROM embeddings)) GROUP BY label""")
def cosine_by_label(t: Tables) -> DataFrame:
    q = F.array(*[F.lit(x) for x in _QUERY_VECTOR])
    return t.embeddings.groupBy("label").agg(F.round(F.avg(vectors.cosine(C("embedding"), q)), 6).alias("avg_cosine"), F.count("*").alias("vectors"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS squared, len(embedding)::INTEGER AS dimensions FROM embeddings")
def l2_normalise(t: Tables) -> DataFrame:
    unit = vectors.l2_normalise(C("embedding"))
    return t.embeddings.select("vec_id", F.round(vectors.dot(unit, unit), 6).alias("squared"), F.size("embedding").alias("dimensions"))
