"""Pages of scanned or born-digital literature: OCR re-join, cross-page analysis, model calls at the edge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def ocr_pages(results: DataFrame) -> DataFrame:
    """OCR result files (``pages`` array) as (pdf_path, page_number, full_text, confidence)."""
    page = results.select("pdf_path", F.explode("pages").alias("p"))
    return page.select("pdf_path", "p.page_number", F.col("p.ocr_result.full_text").alias("full_text"), F.col("p.ocr_result.confidence_score").alias("confidence"))


def usable(pages: DataFrame, first_page: int = 1) -> DataFrame:
    """Pages worth a model call: with text, from the first page on."""
    return pages.where(text.not_blank(F.col("full_text")) & (F.col("page_number") >= first_page))


def rejoin(structured: DataFrame, ocr: DataFrame, keys: list[str]) -> DataFrame:
    """Structured pages with full_main_text of the OCR page, '' where there is none."""
    return structured.join(ocr.select(*keys, F.col("full_text").alias("full_main_text")), keys, "left").withColumn("found", F.col("full_main_text").isNotNull()).withColumn("full_main_text", F.coalesce("full_main_text", F.lit("")))


def rejoin_stats(joined: DataFrame) -> DataFrame:
    return joined.agg(F.count("*").alias("pages"), F.count_if("found").alias("matched"), F.count_if(~F.col("found")).alias("missing"))


def mark_pages(pages: DataFrame, marks: str, page: str) -> DataFrame:
    """(mark, pages): the sorted pages that mention each mark."""
    return pages.select(F.explode(marks).alias("mark"), page).groupBy("mark").agg(F.sort_array(F.collect_set(page)).alias("pages"))


def unlinked(mentioned: DataFrame, transcribed: DataFrame, mark: str) -> DataFrame:
    """(mark, side): mentioned without a transcription, and the other way round."""
    a, b = mentioned.select(mark).distinct(), transcribed.select(mark).distinct()
    return a.join(b, mark, "left_anti").withColumn("side", F.lit("mentioned")).unionByName(b.join(a, mark, "left_anti").withColumn("side", F.lit("transcribed")))


def image_for_page(pages: DataFrame, listing: DataFrame, stem: str, number: str) -> DataFrame:
    """Pages with the first image name that exists, by ordered candidates and extensions; NULL where none does."""
    names = [F.format_string(f, F.col(number)) for f in ("page_%03d", "page_%d", "page-%03d", "page-%d", "%03d", "%d")]
    candidates = F.array(*[F.concat(n, F.lit(e)) for n in names for e in (".png", ".jpg", ".jpeg")])
    tried = pages.select(stem, number, F.posexplode(candidates).alias("rank", "name"))
    found = tried.join(listing.select(stem, "name", "path"), [stem, "name"]).groupBy(stem, number).agg(F.min_by("path", "rank").alias("image_path"))
    return pages.join(found, [stem, number], "left")


def with_model(pages: DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """An injected model over batches of pages; ``call`` maps a pandas frame to one of the schema."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield call(frame)

    return pages.mapInPandas(run, schema)


def with_context(pages: DataFrame, book: str, call: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """An injected model over all pages of one book at a time."""
    return pages.groupBy(book).applyInPandas(call, schema)


def with_constant(pages: DataFrame, metadata: DataFrame) -> DataFrame:
    """Pages with a book's metadata row."""
    one = metadata.limit(2).count()
    if one != 1:
        raise ValueError("a book has exactly one metadata row")
    return pages.crossJoin(F.broadcast(metadata))


def error_kind(message) -> F.Column:
    lower = F.lower(message)
    return F.when(F.contains(lower, F.lit("validation")), "validation").when(F.contains(lower, F.lit("api")), "api").otherwise("other")
