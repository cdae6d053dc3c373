"""Training data for models: examples, chats, corpora, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import not_blank


def prompt_for(document_type: Column, language: Column) -> Column:
    return F.concat(F.lit("Transcribe this "), F.coalesce(document_type, F.lit("document")), F.lit(" in "), F.coalesce(language, F.lit("its language")), F.lit("."))


def examples(df: DataFrame, key: str, document_type: Column, language: Column, target: Column) -> DataFrame:
    """(key, prompt, target) of rows with a target."""
    return df.where(not_blank(target)).select(key, prompt_for(document_type, language).alias("prompt"), target.alias("target"))


def chat(prompt: Column, target: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")), F.struct(F.lit("assistant").alias("role"), target.alias("content")))


def tokenizer_corpus(df: DataFrame, text: str) -> DataFrame:
    """Non-blank lines, edition notes left out."""
    return df.select(F.explode(F.split(text, "\n")).alias("line")).where(not_blank(F.col("line")) & ~F.col("line").startswith("Edition:"))


def positional_split(df: DataFrame, group: str, order: str, share: float = 0.8) -> DataFrame:
    """The first ``share`` of each group's rows is for training."""
    w = Window.partitionBy(group)
    place = F.row_number().over(w.orderBy(order))
    return df.withColumn("split", F.when(place <= F.floor(F.count("*").over(w) * share), "train").otherwise("validation"))


def hashed_split(df: DataFrame, key: str, share: float = 0.9) -> DataFrame:
    """A split by a hash of the key: the same on every run and however the rows are partitioned."""
    place = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % 1000
    return df.withColumn("split", F.when(place < int(share * 1000), "train").otherwise("validation"))


def moving_average(df: DataFrame, group: str, order: str, value: str, n: int) -> DataFrame:
    return df.withColumn("moving_average", F.avg(value).over(Window.partitionBy(group).orderBy(order).rowsBetween(1 - n, 0)))
