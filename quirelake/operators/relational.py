"""The relational model: audits for its constraints, trigger columns and reporting views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Table -> (primary key, unique keys, foreign keys (column, parent, parent key), columns that may not be NULL)
TABLES: dict[str, dict] = {
    "documents": {"key": "document_id", "unique": [["canonical_shelf_mark"]], "parents": [], "required": ["canonical_shelf_mark"]},
    "source_records": {"key": "record_id", "unique": [["source_name", "source_id"]], "parents": [("document_id", "documents", "document_id")], "required": ["source_name", "source_id"]},
    "shelf_mark_variants": {"key": "variant_id", "unique": [["variant_shelf_mark"]], "parents": [("document_id", "documents", "document_id")], "required": ["variant_shelf_mark"]},
    "images": {"key": "image_id", "unique": [["document_id", "source_name", "image_order"]], "parents": [("document_id", "documents", "document_id"), ("record_id", "source_records", "record_id")], "required": ["image_url"]},
    "bibliographic_sources": {"key": "source_id", "unique": [], "parents": [], "required": ["title"]},
    "document_mentions": {"key": "mention_id", "unique": [["document_id", "source_id", "page_number"]], "parents": [("document_id", "documents", "document_id"), ("source_id", "bibliographic_sources", "source_id")], "required": []},
    "chunks": {"key": "chunk_id", "unique": [["source_id", "chunk_order"]], "parents": [("source_id", "bibliographic_sources", "source_id")], "required": ["chunk_text"]},
    "embedding_models": {"key": "model_id", "unique": [["model_name"], ["index_name"]], "parents": [], "required": ["model_name"]},
    "chunk_embeddings": {"key": "embedding_id", "unique": [["chunk_id", "model_id"]], "parents": [("chunk_id", "chunks", "chunk_id"), ("model_id", "embedding_models", "model_id")], "required": []},
}


def natural_id(*parts: Column) -> Column:
    """A deterministic identifier in place of a random one."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows without a parent; a NULL reference is allowed."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def cascade(child: DataFrame, column: str, surviving: DataFrame, key: str) -> DataFrame:
    """Child rows that remain when parents outside ``surviving`` are deleted."""
    return child.join(surviving.select(F.col(key).alias(column)), column, "left_semi").select(*child.columns)


def outside(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.where(~F.col(column).between(low, high))


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rule, violations) for all tables given."""
    out: DataFrame | None = None
    for name, df in tables.items():
        rules = TABLES[name]
        checks = [(f"primary key {rules['key']}", duplicates(df, [rules["key"]]))]
        checks += [(f"unique {', '.join(u)}", duplicates(df.dropna(subset=u), u)) for u in rules["unique"]]
        checks += [(f"reference {c} to {p}", orphans(df, c, tables[p], k)) for c, p, k in rules["parents"] if p in tables]
        checks += [(f"not null {c}", df.where(F.col(c).isNull())) for c in rules["required"]]
        for rule, bad in checks:
            row = bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("table"), F.lit(rule).alias("rule"), "violations")
            out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no tables to audit")
    return out


def with_image_counts(documents: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """image_count and has_images recomputed from the image rows."""
    counts = images.groupBy(key).agg(F.count("*").alias("image_count"))
    return documents.drop("image_count", "has_images").join(counts, key, "left").withColumn("image_count", F.coalesce("image_count", F.lit(0))).withColumn("has_images", F.col("image_count") > 0)


def stamped(df: DataFrame, changed: Column, run_time: str) -> DataFrame:
    """updated_at of changed rows set to the run's time."""
    return df.withColumn("updated_at", F.when(changed, F.lit(run_time).cast("timestamp")).otherwise(F.col("updated_at")))


def documents_view(documents: DataFrame, records: DataFrame, variants: DataFrame, images: DataFrame, key: str = "document_id") -> DataFrame:
    """Documents with their sources and variants as JSON and their image count; an empty list is NULL."""
    listed = lambda df, *c: df.groupBy(key).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*c)))).alias("j"))
    return (
        documents.join(listed(records, "source_name", "source_id").withColumnRenamed("j", "sources"), key, "left")
        .join(listed(variants, "variant_shelf_mark", "kind").withColumnRenamed("j", "variants"), key, "left")
        .join(images.groupBy(key).agg(F.count("*").alias("total_images")), key, "left")
        .withColumn("total_images", F.coalesce("total_images", F.lit(0)))
    )


def sources_view(sources: DataFrame, mentions: DataFrame, chunks: DataFrame, key: str = "source_id") -> DataFrame:
    """Sources with counts of mentions, chunks and embedded chunks."""
    m = mentions.groupBy(key).agg(F.count("*").alias("mention_count"))
    c = chunks.groupBy(key).agg(F.count("*").alias("chunk_count"), F.count_if(~F.col("needs_embedding")).alias("embedded_chunks"))
    out = sources.join(m, key, "left").join(c, key, "left")
    return out.withColumns({x: F.coalesce(x, F.lit(0)) for x in ("mention_count", "chunk_count", "embedded_chunks")})


def embedding_models(spark: SparkSession, rows: list[tuple[str, int, str]]) -> DataFrame:
    """Seed rows (model_name, dimensions, index_name) with deterministic ids."""
    return spark.createDataFrame(rows, "model_name string, dimensions int, index_name string").withColumn("model_id", natural_id(F.col("model_name")))
