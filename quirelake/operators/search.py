"""Ranked search: postings, BM25, cosine and hybrid scores, filters before scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values
from ..functions.text import ascii_fold
from ..functions.vectors import cosine


def analyse(c: Column, fold: bool = False) -> Column:
    """Lower-case word tokens; with ``fold`` Latin letters lose their marks first (a pandas UDF)."""
    return F.regexp_extract_all(F.lower(ascii_fold(c) if fold else c), F.lit(r"([\p{L}\p{N}\p{M}_]+)"), F.lit(1))


def postings(df: DataFrame, doc: str, fields: list[str], fold: bool = False) -> DataFrame:
    """(field, doc, term, tf, dl); write it partitioned or bucketed by term to serve queries without a corpus scan."""
    tokens = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), analyse(F.col(f), fold).alias("tokens")) for f in fields]))
    rows = df.select(F.col(doc).alias("doc"), tokens.alias("x")).select("doc", "x.field", F.size("x.tokens").alias("dl"), F.explode("x.tokens").alias("term"))
    return rows.groupBy("field", "doc", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def query_terms(text: str) -> list[str]:
    import re

    return sorted({t for t in re.findall(r"\w+", text.lower())})


def _matches(tokens: Column, terms: list[str]) -> Column:
    return F.filter(tokens, lambda t: t.isin(terms))


def lexical(df: DataFrame, doc: str, fields: list[tuple[str, float]], text: str, fold: bool = False) -> DataFrame:
    """(doc, score): BM25 summed over terms per field, boosted, the best field counts.

    One pass over the texts keeps the length and the query's terms only; document frequencies and average lengths are
    aggregates of it, so nothing of the corpus but matching postings is shuffled.
    """
    terms = query_terms(text)
    k1, b = fixed_values.BM25_K1, fixed_values.BM25_B
    boosts = F.create_map(*[F.lit(x) for pair in fields for x in pair])
    parts = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), analyse(F.col(f), fold).alias("tokens")) for f, _ in fields]))
    per_field = df.select(F.col(doc).alias("doc"), parts.alias("x")).select("doc", "x.field", F.size("x.tokens").cast("double").alias("dl"), _matches(F.col("x.tokens"), terms).alias("hits"))
    stats = per_field.where("dl > 0").groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    found = per_field.where("size(hits) > 0").select("doc", "field", "dl", F.explode("hits").alias("term")).groupBy("doc", "field", "dl", "term").agg(F.count("*").cast("double").alias("tf"))
    df_counts = found.groupBy("field", "term").agg(F.count("*").alias("df"))
    # one row per field, and at most one per field and query term: bounded by the query, not by the corpus
    scored = found.join(F.broadcast(df_counts), ["field", "term"]).join(F.broadcast(stats), "field")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    by_field = scored.groupBy("doc", "field").agg(F.sum(weight).alias("s")).select("doc", (F.col("s") * boosts[F.col("field")]).alias("s"))
    return by_field.groupBy("doc").agg(F.max("s").alias("score"))


def semantic(df: DataFrame, doc: str, vector: str, query: list[float]) -> DataFrame:
    """(doc, score): cosine plus one, over all documents."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.select(F.col(doc).alias("doc"), (cosine(F.col(vector), q) + 1.0).alias("score"))


def hybrid(text_scores: DataFrame, vector_scores: DataFrame) -> DataFrame:
    """Sum of both scores; a document found by either is in."""
    both = text_scores.withColumnRenamed("score", "a").join(vector_scores.withColumnRenamed("score", "b"), "doc", "full")
    return both.select("doc", (F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))).alias("score"))


def filters(document_type: str | None = None, language: str | None = None, source: str | None = None, date_from: str | None = None, date_to: str | None = None, has_transcriptions: bool | None = None, min_completeness: float | None = None) -> Column:
    """The conditions given, on document_type, main_language, source_collection, date_start (as text), transcriptions and completeness_score."""
    tests: list[Column] = []
    for column, value in (("document_type", document_type), ("main_language", language), ("source_collection", source)):
        if value is not None:
            tests.append(F.col(column) == value)
    if date_from is not None:
        tests.append(F.col("date_start") >= date_from)
    if date_to is not None:
        tests.append(F.col("date_start") <= date_to)
    if has_transcriptions is not None:
        there = F.coalesce(F.size("transcriptions") > 0, F.lit(False))
        tests.append(there if has_transcriptions else ~there)
    if min_completeness is not None:
        tests.append(F.col("completeness_score") >= min_completeness)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def top(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "doc").limit(k)


def search(df: DataFrame, doc: str, text: str | None = None, fields: list[tuple[str, float]] | None = None, vector: str | None = None, query: list[float] | None = None, where: Column | None = None, size: int = 10) -> DataFrame:
    """(doc, score, total): lexical, semantic or both, filtered first; total counts the whole match set."""
    df = df if where is None else df.where(where)
    found = []
    if text:
        found.append(lexical(df, doc, fields or fixed_values.SEARCH_BOOSTS, text))
    if query is not None and vector:
        found.append(semantic(df, doc, vector, query))
    scores = found[0] if len(found) == 1 else hybrid(*found) if found else df.select(F.col(doc).alias("doc"), F.lit(1.0).alias("score"))
    total = scores.agg(F.count("*").alias("total"))
    return top(scores, size).crossJoin(F.broadcast(total))  # one row


def point_lookup(df: DataFrame, doc: str, value) -> DataFrame:
    return df.where(F.col(doc) == value).limit(1)
