"""Transcription metrics.  Sequence matching is the standard library's, so these are Arrow-batched pandas UDFs."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .fixed_values import CONSENSUS_SCORES, OCR_CONFIDENCE
from .text import not_blank


def error_rate(ref, hyp) -> float:
    """Changed units over the reference's length; an empty reference gives 1 if there is anything, else 0."""
    if not ref:
        return 1.0 if hyp else 0.0
    changed = sum(max(b - a, d - c) for op, a, b, c, d in SequenceMatcher(None, ref, hyp).get_opcodes() if op != "equal")
    return changed / len(ref)


def _pairs(f, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([f(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def cer(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return _pairs(error_rate, ref, hyp)


@F.pandas_udf(DoubleType())
def wer(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return _pairs(lambda x, y: error_rate(x.split(), y.split()), ref, hyp)


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(lambda x, y: SequenceMatcher(None, x, y).ratio(), a, b)


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in ("cer", "wer", "similarity")]))
def transcription_metrics(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """cer, wer and similarity of each pair; characters are aligned once for the first and the last."""

    def both(x: str, y: str) -> tuple[float, float, float]:
        match = SequenceMatcher(None, x, y)
        changed = sum(max(b - a, d - c) for op, a, b, c, d in match.get_opcodes() if op != "equal")
        return changed / len(x) if x else float(bool(y)), error_rate(x.split(), y.split()), match.ratio()

    return pd.DataFrame([both(x or "", y or "") for x, y in zip(ref, hyp)], columns=["cer", "wer", "similarity"], dtype="float64")


@F.pandas_udf(DoubleType())
def stripped_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(lambda x, y: SequenceMatcher(None, x.strip(), y.strip()).ratio() if x.strip() and y.strip() else 0.0, a, b)


def _f1(hits: int, a: int, b: int) -> float:
    return 2 * hits / (a + b) if a + b else 0.0


def rouge_scores(ref: str, hyp: str) -> tuple[float, float, float]:
    """Unstemmed ROUGE-1, -2 and -L F scores."""
    r, h = ref.lower().split(), hyp.lower().split()
    grams = lambda w, n: Counter(zip(*[w[i:] for i in range(n)]))
    by_n = [_f1(sum((grams(r, n) & grams(h, n)).values()), max(0, len(r) - n + 1), max(0, len(h) - n + 1)) for n in (1, 2)]
    row = [0] * (len(h) + 1)
    for x in r:
        last = 0
        for j, y in enumerate(h, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return by_n[0], by_n[1], _f1(row[-1], len(r), len(h))


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in ("rouge1", "rouge2", "rougeL")]))
def rouge(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([rouge_scores(x or "", y or "") for x, y in zip(ref, hyp)], columns=["rouge1", "rouge2", "rougeL"])


def levenshtein_cer(ref: Column, hyp: Column) -> Column:
    return F.levenshtein(ref, hyp) / F.greatest(F.length(ref), F.lit(1))


def consensus(ocr: Column, ocr_confidence: Column, pro: Column, flash: Column, fallback: Column, disagree: Column) -> Column:
    """(text, strategy, confidence, needs_review) from three models' texts.

    ``fallback`` is the first text there is; ``disagree`` says that some pair of texts is too far apart.
    """
    pick = lambda text, name, score: F.struct(text.alias("text"), F.lit(name).alias("strategy"), score.cast("double").alias("confidence"), F.coalesce(disagree, F.lit(False)).alias("needs_review"))
    score = {k: F.lit(v) for k, v in CONSENSUS_SCORES.items()}
    return (
        F.when(not_blank(ocr) & (ocr_confidence > OCR_CONFIDENCE), pick(ocr, "ocr_primary", ocr_confidence))
        .when(not_blank(pro) & not_blank(flash), pick(pro, "llm_pro_preferred", score["both"]))
        .when(not_blank(pro), pick(pro, "llm_pro_only", score["pro"]))
        .when(not_blank(flash), pick(flash, "llm_flash_only", score["flash"]))
        .when(not_blank(fallback), pick(fallback, "fallback_first", score["fallback"]))
        .otherwise(F.struct(F.lit("").alias("text"), F.lit("failed").alias("strategy"), F.lit(0.0).alias("confidence"), F.lit(True).alias("needs_review")))
    )
