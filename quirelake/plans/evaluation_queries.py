"""Transcription evaluation and cluster analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import clusters, evaluate
from .registry import Tables, query

C = F.col


def _turns(t: Tables) -> DataFrame:
    """Neighbouring turns of a conversation as reference and hypothesis."""
    a = t.conversations.select("conv_id", "turn", C("text").alias("ref"))
    b = t.conversations.select("conv_id", (C("turn") - 1).alias("turn"), C("text").alias("hyp"), C("role").alias("model"))
    return a.join(b, ["conv_id", "turn"])


@query("""SELECT p_partkey, round(levenshtein(p_name, p_type) / greatest(length(p_name), 1), 6) AS cer FROM part""")
def levenshtein_cer(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(metrics.levenshtein_cer(C("p_name"), C("p_type")), 6).alias("cer"))


@query()
def cer_wer_similarity(t: Tables) -> DataFrame:
    return evaluate.metric_rows(_turns(t), "ref", "hyp").drop("ref", "hyp")


@query()
def model_eval_summary(t: Tables) -> DataFrame:
    return evaluate.model_summary(evaluate.metric_rows(_turns(t), "ref", "hyp"), "model")


@query()
def rouge_scores(t: Tables) -> DataFrame:
    return _turns(t).select("conv_id", "turn", metrics.rouge(C("ref"), C("hyp")).alias("r")).select("conv_id", "turn", "r.*")


@query()
def model_disagreement(t: Tables) -> DataFrame:
    # every three turns stand for one document as read by three models
    rows = t.conversations.select(F.concat_ws(":", "conv_id", F.expr("turn div 3")).alias("document"), (C("turn") % 3).cast("string").alias("model"), "text")
    return evaluate.disagreements(rows, "document", "model", "text")


@query("""SELECT event_id, strategy, round(confidence, 6) AS confidence FROM (SELECT event_id, CASE WHEN event_type = 'click' AND value / 200.0 > 0.7 THEN 'ocr_primary' WHEN event_type IN ('view', 'error') THEN 'llm_pro_preferred' WHEN event_type = 'purchase' THEN 'llm_flash_only' WHEN event_type = 'signup' THEN 'failed' ELSE 'fallback_first' END AS strategy,
    CASE WHEN event_type = 'click' AND value / 200.0 > 0.7 THEN value / 200.0 WHEN event_type IN ('view', 'error') THEN 0.82 WHEN event_type = 'purchase' THEN 0.75 WHEN event_type = 'signup' THEN 0.0 ELSE 0.5 END AS confidence FROM events)""")
def consensus_strategy(t: Tables) -> DataFrame:
    e = C("event_type")
    some = lambda cond: F.when(cond, F.lit("text"))
    c = metrics.consensus(some(e == "click"), C("value") / 200.0, some(e.isin("view", "error")), some(e.isin("view", "error", "purchase")), some(e != "signup"), F.lit(False))
    return t.events.select("event_id", c.alias("c")).select("event_id", "c.strategy", F.round("c.confidence", 6).alias("confidence"))


@query("""WITH s AS (SELECT event_type AS model, avg(value) AS avg_cer FROM events GROUP BY event_type), b AS (SELECT model, avg_cer FROM s WHERE model <> 'view' ORDER BY avg_cer, model LIMIT 1)
    SELECT b.model AS best_model, round(b.avg_cer, 6) AS best_cer, round(v.avg_cer, 6) AS consensus_cer, round(b.avg_cer - v.avg_cer, 6) AS gain FROM b, (SELECT avg_cer FROM s WHERE model = 'view') v""")
def best_model_delta(t: Tables) -> DataFrame:
    summary = t.events.groupBy(C("event_type").alias("model")).agg(F.avg("value").alias("avg_cer"))
    out = evaluate.best_model(summary, "model", "view")
    return out.select("best_model", *[F.round(c, 6).alias(c) for c in ("best_cer", "consensus_cer", "gain")])


@query("""SELECT lang, count(*) AS texts, round(avg(length(text)), 6) AS avg_length, min(length(text))::INTEGER AS min_length, max(length(text))::INTEGER AS max_length, sum(length(text))::BIGINT AS total_chars FROM documents GROUP BY lang""")
def dataset_statistics(t: Tables) -> DataFrame:
    n = F.length("text")
    return t.documents.groupBy("lang").agg(F.count("*").alias("texts"), F.round(F.avg(n), 6).alias("avg_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.sum(n).alias("total_chars"))


@query("""SELECT count(*) AS texts, round(avg(length(text)), 6) AS avg_length, min(length(text))::INTEGER AS min_length, max(length(text))::INTEGER AS max_length, sum(length(text))::BIGINT AS total_chars, sum(length(regexp_replace(text, '[^a-zA-Z]', '', 'g')))::BIGINT AS script_chars, round(sum(length(regexp_replace(text, '[^a-zA-Z]', '', 'g'))) / sum(length(text)), 6) AS script_ratio FROM documents""")
def script_statistics(t: Tables) -> DataFrame:
    out = evaluate.dataset_statistics(t.documents, "text", "[^a-zA-Z]")
    return out.withColumn("avg_length", F.round("avg_length", 6)).withColumn("script_ratio", F.round("script_ratio", 6))


@query("""SELECT count(*) AS n, round(avg((o_orderstatus = l_linestatus)::INTEGER), 6) AS accuracy FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def exact_match_accuracy(t: Tables) -> DataFrame:
    j = t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey"))
    return evaluate.accuracy(j, "o_orderstatus", "l_linestatus").withColumn("accuracy", F.round("accuracy", 6))


@query("""SELECT round(sum(m) / sum(n), 6) AS purity FROM (SELECT max(c) AS m, sum(c) AS n FROM (SELECT vec_id % 7 AS k, label, count(*) AS c FROM embeddings GROUP BY ALL) GROUP BY k)""")
def cluster_purity(t: Tables) -> DataFrame:
    return clusters.purity(t.embeddings.withColumn("k", C("vec_id") % 7), "k", "label").withColumn("purity", F.round("purity", 6))


@query("""WITH c AS (SELECT vec_id % 7 AS cluster, label, count(*) AS n FROM embeddings GROUP BY ALL), r AS (SELECT cluster, label, n, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label) AS p, sum(n) OVER (PARTITION BY cluster) AS total FROM c)
    SELECT k AS cluster, coalesce(total, 0)::BIGINT AS total, label AS dominant, coalesce(round(n / total, 6), 0) AS purity FROM range(9) x(k) LEFT JOIN r ON r.cluster = k AND p = 1""")
def cluster_composition(t: Tables) -> DataFrame:
    rows = t.embeddings.withColumn("cluster", C("vec_id") % 7)
    return clusters.composition(rows, "cluster", "label", 9).withColumn("purity", F.round("purity", 6))


@query("""WITH d AS (SELECT a.vec_id AS k, a.label AS c, b.label AS o, b.vec_id AS j, sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE)))) AS dist FROM embeddings a, embeddings b),
    s AS (SELECT k, c, o, sum(dist) AS s, count(*) AS m FROM d GROUP BY ALL), v AS (SELECT k, max(CASE WHEN c = o AND m > 1 THEN s / (m - 1) END) AS a, min(CASE WHEN c <> o THEN s / m END) AS b FROM s GROUP BY k)
    SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM v""")
def silhouette_exact(t: Tables) -> DataFrame:
    return clusters.silhouette(t.embeddings, "vec_id", "embedding", "label").withColumn("silhouette", F.round("silhouette", 6))


@query()
def kmeans_silhouette(t: Tables) -> DataFrame:
    clustered = clusters.kmeans(t.embeddings, "embedding", 10, starts=3)
    return clusters.silhouette(clustered, "vec_id", "embedding", "cluster").crossJoin(clusters.purity(clustered, "cluster", "label"))  # one row each


@query()
def pca_2d(t: Tables) -> DataFrame:
    return clusters.pca(t.embeddings, "embedding").select("vec_id", "label", "x", "y")


@query("""SELECT label, count(*) AS n FROM embeddings GROUP BY label""")
def category_distribution(t: Tables) -> DataFrame:
    return t.embeddings.groupBy("label").agg(F.count("*").alias("n"))
