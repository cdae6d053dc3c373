"""Rows for charts; drawing them is left to a front end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import direction, truncate


def completeness_label(has_image: Column, has_text: Column) -> Column:
    return F.when(has_image & has_text, "Complete").when(has_image, "Image Only").when(has_text, "Transcription Only").otherwise("Incomplete")


def safe_image(c: Column) -> Column:
    """Whether an image value can be shown."""
    return c.isNotNull() & ~F.contains(c.cast("string"), F.lit("Invalid"))


def chart_frame(df: DataFrame, key: str, x: Column, y: Column, description: Column, text: Column, image: Column) -> DataFrame:
    return df.select(
        key, x.alias("x"), y.alias("y"), truncate(description, 100).alias("description"), truncate(text, 1000).alias("popup"), F.length(text).alias("transcription_length"), direction(text).alias("direction"),
        safe_image(image).alias("has_image"), (F.length(text) > 0).alias("has_transcription"), F.when(safe_image(image), 12).otherwise(8).alias("marker_size"),
    )
