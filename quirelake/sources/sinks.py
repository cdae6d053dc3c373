"""Writers.  Each writes to a new path; nothing is read and overwritten in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.resolve import last_writer_wins


def write_index(df: DataFrame, path: str, doc: str, order: str) -> DataFrame:
    """Search documents, the latest of each id, as Parquet."""
    keyed = df.withColumn("_id", F.coalesce(F.nullif(F.col(doc).cast("string"), F.lit("")), F.concat(F.lit("doc_"), F.col(order))))
    last_writer_wins(keyed, ["_id"], [order]).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "errorifexists").json(path)


def bulk_lines(df: DataFrame, index: str, doc: str) -> DataFrame:
    """Two lines per document, action and source, in one text value."""
    action = F.to_json(F.struct(F.struct(F.lit(index).alias("_index"), F.col(doc).cast("string").alias("_id")).alias("index")))
    return df.select(F.concat(action, F.lit("\n"), F.to_json(F.struct(*[F.col(c) for c in df.columns]))).alias("value"))


def write_bulk(df: DataFrame, path: str, index: str, doc: str) -> None:
    bulk_lines(df, index, doc).write.mode("errorifexists").text(path)


def write_pages(df: DataFrame, path: str, stem: str = "pdf_name") -> None:
    df.write.mode("overwrite").partitionBy(stem).json(path)


def work_left(df: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows whose key the cache table does not hold yet."""
    return df.join(cache.select(key), key, "left_anti")
