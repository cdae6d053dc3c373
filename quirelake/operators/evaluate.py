"""Evaluation of transcriptions: metric rows, disagreement, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.fixed_values import REVIEW_SIMILARITY
from ..functions.text import normalise_space


def metric_rows(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    """``df`` with cer, wer, similarity, exact_match on normalised text, and counts on raw text."""
    r, h = normalise_space(F.coalesce(F.col(ref), F.lit(""))), normalise_space(F.coalesce(F.col(hyp), F.lit("")))
    n, m = F.length(F.coalesce(F.col(hyp), F.lit(""))), F.length(F.coalesce(F.col(ref), F.lit("")))
    rows = df.withColumns({"__m": metrics.transcription_metrics(r, h), "exact_match": r == h, "char_count": n, "gt_char_count": m, "char_diff": F.abs(n - m)})
    return rows.withColumns({c: F.col(f"__m.{c}") for c in ("cer", "wer", "similarity")}).drop("__m")


def disagreements(df: DataFrame, doc: str, model: str, text: str) -> DataFrame:
    """(doc, model_a, model_b, similarity, disagree): each pair of a document's models once."""
    a = df.select(doc, F.col(model).alias("model_a"), F.col(text).alias("text_a"))
    b = df.select(doc, F.col(model).alias("model_b"), F.col(text).alias("text_b"))
    pairs = a.join(b, doc).where("model_a < model_b")
    score = metrics.similarity(F.col("text_a"), F.col("text_b"))
    return pairs.select(doc, "model_a", "model_b", score.alias("similarity")).withColumn("disagree", F.col("similarity") < REVIEW_SIMILARITY)


def model_summary(df: DataFrame, model: str) -> DataFrame:
    return df.groupBy(model).agg(F.count("*").alias("processed"), F.avg("cer").alias("avg_cer"), F.avg("similarity").alias("avg_similarity"))


def length_summary(df: DataFrame, by: list[str], similarity: str, predicted: str, target: str) -> DataFrame:
    """Samples, average, least and most similarity, and the average lengths of what was said and wanted."""
    s = F.col(similarity)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(s).alias("avg_similarity"), F.min(s).alias("min_similarity"), F.max(s).alias("max_similarity"), F.avg(F.length(predicted)).alias("avg_pred_length"), F.avg(F.length(target)).alias("avg_target_length")
    )


def best_model(summary: DataFrame, model: str, consensus: str) -> DataFrame:
    """One row: the single model of least error (first name on ties), and what the consensus gains over it."""
    single = summary.where(F.col(model) != consensus).agg(F.min_by(F.struct(model, "avg_cer"), F.struct("avg_cer", model)).alias("best"))
    both = summary.where(F.col(model) == consensus).agg(F.first("avg_cer").alias("consensus_cer"))
    return single.crossJoin(both).select(F.col("best")[model].alias("best_model"), F.col("best.avg_cer").alias("best_cer"), "consensus_cer", (F.col("best.avg_cer") - F.col("consensus_cer")).alias("gain"))


def has_truth(text: str):
    return F.length(F.trim(F.col(text))) > 10


def dataset_statistics(df: DataFrame, text: str, letters: str = "[^֐-׿]") -> DataFrame:
    """One row: texts, average, least and most characters, all characters, those of a script and their share."""
    n, s = F.length(text), F.length(F.regexp_replace(text, letters, ""))
    return df.agg(
        F.count("*").alias("texts"), F.avg(n).alias("avg_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.sum(n).alias("total_chars"), F.sum(s).alias("script_chars"), F.coalesce(F.try_divide(F.sum(s), F.sum(n)), F.lit(0.0)).alias("script_ratio")
    )


def accuracy(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.avg((F.col(ref) == F.col(hyp)).cast("double")).alias("accuracy"))
