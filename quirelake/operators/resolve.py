"""Entity resolution and upserts: order-dependent merges as single aggregations.

Every policy takes the order as a column, so partitions and retries cannot change a result, and each is an aggregate
that is combined before the shuffle: no window over a key's rows and no sequential fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def longest(value: Column, order: Column) -> Column:
    """The longest value, the earliest of equal length; empty and NULL count as no value."""
    usable = value.isNotNull() & (value != "")
    return F.max_by(value, F.when(usable, F.struct(F.length(value), -order)))


def first_nonempty(value: Column, order: Column) -> Column:
    return F.min_by(value, F.when(value.isNotNull() & (value.cast("string") != ""), order))


def last_nonempty(value: Column, order: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull() & (value.cast("string") != ""), order))


def in_order(value: Column, order: Column) -> Column:
    """All values of the group as an array in order."""
    return F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])


def ordered_union(value: Column, order: Column) -> Column:
    """Elements of all arrays, in order, first occurrence kept."""
    return F.array_distinct(F.flatten(in_order(value, order)))


def concatenated(value: Column, order: Column) -> Column:
    return F.flatten(in_order(value, order))


def largest_map(value: Column, order: Column) -> Column:
    """The entry list with most keys, the earliest on ties."""
    return F.max_by(value, F.struct(F.size(value), -order))


def first_writer_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert-or-ignore: the earliest row of each key."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def last_writer_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert: the latest row of each key."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def merge_group(df: DataFrame, key: str, order: str, text: str, images: str, lists: list[str], metadata: str | None = None) -> DataFrame:
    """Records of one key merged: first record as base, images united in order, other lists concatenated, longest text."""
    o = F.col(order)
    base = [c for c in df.columns if c not in {key, order, text, images, metadata, *lists}]
    aggs = [F.min_by(c, o).alias(c) for c in base]
    aggs += [F.coalesce(longest(F.col(text), o), F.lit("")).alias(text)]
    single = F.count("*") == 1
    aggs += [F.when(single, F.min_by(images, o)).otherwise(ordered_union(F.col(images), o)).alias(images)]
    aggs += [concatenated(F.col(c), o).alias(c) for c in lists]
    if metadata:
        aggs += [largest_map(F.col(metadata), o).alias(metadata)]
    return df.groupBy(key).agg(*aggs, F.count("*").alias("merged_records"))


def canonical_records(df: DataFrame, key: str, order: str) -> DataFrame:
    """Per-field merge policies of the relational load, in one aggregation.

    Expects transcription, translation, description, date_start, date_display, year, language, material, condition,
    joins (array), image_count, completeness.  The date text is the latest display at or before the first record whose
    year is known; completeness is the plain maximum.
    """
    o, c = F.col(order), F.col
    has_year = F.min(F.when(c("year").isNotNull(), o))
    merged = df.groupBy(key).agg(
        *[longest(c(x), o).alias(x) for x in ("transcription", "translation", "description")],
        *[first_nonempty(c(x), o).alias(x) for x in ("language", "material", "condition")],
        ordered_union(c("joins"), o).alias("joins"),
        F.max("image_count").alias("image_count"),
        F.max("completeness").alias("completeness"),
        F.min_by("year", F.when(c("year").isNotNull(), o)).alias("year"),
        has_year.alias("__k"),
        F.count("*").alias("records"),
    )
    dated = df.where("date_start is not null").select(key, order, "date_display")
    text = dated.join(merged.select(key, "__k"), key).where(F.col("__k").isNull() | (o <= F.col("__k"))).groupBy(key).agg(F.max_by("date_display", o).alias("date_text"))
    return merged.join(text, key, "left").drop("__k")


def metadata_merge(df: DataFrame, key: str, order: str, kv: str) -> DataFrame:
    """Entries of all records of a key; of each entry key the last value that is neither NULL nor empty."""
    entries = df.select(key, order, F.posexplode(kv).alias("p", "e")).where("e.v is not null and e.v <> ''")
    last = entries.groupBy(key, "e.k").agg(F.max_by(F.col("e.v"), F.struct(order, "p")).alias("v"))
    return last.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias(kv))


def variants(df: DataFrame, document: str, canonical: Column, doc_id: Column, joined: Column, main: Column, order: str) -> DataFrame:
    """(document, variant, kind): every name of a document, globally unique, first writer wins."""
    names = F.array_distinct(F.filter(F.concat(F.array(canonical, doc_id), F.coalesce(joined, F.array().cast("array<string>")), F.array(main)), lambda x: x.isNotNull() & (x != "")))
    kind = F.when(F.col("variant") == F.col("__canonical"), "normalized").when(F.array_contains(F.coalesce(F.col("__joined"), F.array().cast("array<string>")), F.col("variant")), "join").otherwise("database")
    rows = df.select(document, order, canonical.alias("__canonical"), joined.alias("__joined"), F.posexplode(names).alias("position", "variant")).select(document, order, "position", "variant", kind.alias("kind"))
    return first_writer_wins(rows, ["variant"], [order, document, "position"]).select(document, "variant", "kind")


def images(df: DataFrame, document: str, source: str, urls: str, order: str) -> DataFrame:
    """(document, source, image_order, url): one row per (document, source, order), last writer wins."""
    rows = df.select(document, source, order, F.posexplode(urls).alias("i", "url")).select(document, source, (F.col("i") + 1).alias("image_order"), "url", order)
    return last_writer_wins(rows, [document, source, "image_order"], [order, "url"]).drop(order)
