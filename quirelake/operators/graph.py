"""Property graphs as node and edge tables, and pattern queries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resolve import last_writer_wins


def listed(df: DataFrame, key: str, column: str, separator: str) -> DataFrame:
    """(key, item): the non-empty trimmed parts of a separated list, once each."""
    parts = F.transform(F.split(F.col(column), separator), lambda x: F.trim(x))
    return df.select(key, F.explode(parts).alias("item")).where("item <> ''").distinct()


def nodes(df: DataFrame, label: str, key: Column, props: Column | None = None) -> DataFrame:
    """(label, id, props)"""
    return df.select(F.lit(label).alias("label"), key.cast("string").alias("id"), (F.to_json(props) if props is not None else F.lit(None).cast("string")).alias("props")).where("id is not null")


def edges(df: DataFrame, kind: str, src: tuple[str, Column], dst: tuple[str, Column], props: Column | None = None) -> DataFrame:
    """(type, src_label, src, dst_label, dst, props), unique"""
    return df.select(
        F.lit(kind).alias("type"), F.lit(src[0]).alias("src_label"), src[1].cast("string").alias("src"), F.lit(dst[0]).alias("dst_label"), dst[1].cast("string").alias("dst"),
        (F.to_json(props) if props is not None else F.lit(None).cast("string")).alias("props"),
    ).where("src is not null and dst is not null").distinct()


def merge_nodes(df: DataFrame, order: str) -> DataFrame:
    """Nodes of one label and id are one; the latest properties stay."""
    return last_writer_wins(df, ["label", "id"], [order]).drop(order)


def footnotes(notes: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Citation edges: rows with a document and a source that both exist; the latest row of a pair stays."""
    rows = notes.dropna(subset=["document_id", "source"]).join(documents.select("document_id").distinct(), "document_id", "left_semi").join(sources.select("source").distinct(), "source", "left_semi")
    return rows


def node_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def edge_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def cooccurrence(pairs: DataFrame, hub: str, item: str, least: int = 1) -> DataFrame:
    """(a, b, shared): items that occur with the same hubs, both directions.

    Pairs are made once with a < b and counted, and only the counts are mirrored.
    """
    rows = pairs.select(hub, item).distinct()
    a, b = rows.select(hub, F.col(item).alias("a")), rows.select(hub, F.col(item).alias("b"))
    once = a.join(b, hub).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    return once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))


def having_many(pairs: DataFrame, key: str, item: str, least: int = 2) -> DataFrame:
    """Keys with at least so many different items, the items sorted."""
    return pairs.groupBy(key).agg(F.sort_array(F.collect_set(item)).alias("items")).where(F.size("items") >= least)


def paths(undirected: DataFrame, start: DataFrame, most: int = 3) -> DataFrame:
    """(start, end, hops): ends of paths of 1..most edges from each start; an edge is used once in a path.

    ``undirected(id, a, b)`` holds each edge once, with an id.
    """
    both = undirected.select("id", "a", "b").unionByName(undirected.select("id", F.col("b").alias("a"), F.col("a").alias("b")))
    step = both.select(F.col("id").alias("e"), F.col("a").alias("at"), F.col("b").alias("to"))
    walk = start.select(F.col("start"), F.col("start").alias("at"), F.array().cast("array<string>").alias("used"))
    out = None
    for hops in range(1, most + 1):
        walk = walk.join(step, "at").where(~F.array_contains("used", F.col("e").cast("string"))).select("start", F.col("to").alias("at"), F.array_append("used", F.col("e").cast("string")).alias("used"))
        ends = walk.select("start", F.col("at").alias("end"), F.lit(hops).alias("hops"))
        out = ends if out is None else out.unionByName(ends)
    return out.groupBy("start", "end", "hops").agg(F.count("*").alias("paths"))


def neighbourhood(edge_table: DataFrame, node: Column) -> DataFrame:
    """Edges that touch a node."""
    return edge_table.where((F.col("src") == node) | (F.col("dst") == node))
