"""A stored inverted index, and matches inside nested fields, keyword arrays and token columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values
from .search import analyse, postings, query_terms


@dataclass(frozen=True)
class Index:
    """Folders of the postings, by term bucket, and of each field's count and average length."""

    path: str
    buckets: int = 64

    def bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")


def build_index(df: DataFrame, doc: str, fields: list[str], path: str, buckets: int = 64) -> Index:
    """Write the postings of ``fields`` once; a later search reads the buckets of its terms only.

    Rows of one bucket lie together, so a bucket is as many files as its size asks for and none is a task's whole.
    """
    index = Index(path, buckets)
    rows = postings(df, doc, fields).withColumn("bucket", index.bucket(F.col("term")))
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    tokens = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.size(analyse(F.col(f))).alias("dl")) for f in fields]))
    lengths = df.select(tokens.alias("x")).select("x.*").where("dl > 0").groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    return index


def lexical_indexed(spark: SparkSession, index: Index, fields: list[tuple[str, float]], text: str) -> DataFrame:
    """(doc, score) as ``search.lexical`` gives it, from the stored index."""
    terms = query_terms(text)
    k1, b = fixed_values.BM25_K1, fixed_values.BM25_B
    boosts = F.create_map(*[F.lit(x) for pair in fields for x in pair])
    rows = spark.read.parquet(f"{index.path}/postings")
    wanted = F.col("term").isin(terms) & F.col("field").isin([f for f, _ in fields])
    found = rows.where(F.col("bucket").isin([index.bucket(F.lit(t)) for t in terms]) & wanted) if terms else rows.where(F.lit(False))
    counts = found.groupBy("field", "term").agg(F.count("*").alias("df"))  # bounded by the query
    lengths = spark.read.parquet(f"{index.path}/lengths")  # one row a field
    scored = found.join(F.broadcast(counts), ["field", "term"]).join(F.broadcast(lengths), "field")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    by_field = scored.groupBy("doc", "field").agg(F.sum(weight).alias("s"))
    return by_field.groupBy("doc").agg(F.max(F.col("s") * boosts[F.col("field")]).alias("score"))


def hits(scores: DataFrame, sources: DataFrame, doc: str, size: int = 10) -> DataFrame:
    """(id, score, source, total, max_score): the best ``size`` with their documents; totals count the whole match set."""
    total = scores.agg(F.count("*").alias("total"), F.max("score").alias("max_score"))
    best = scores.orderBy(F.desc("score"), "doc").limit(size)
    source = sources.select(F.col(doc).alias("doc"), F.struct(*[F.col(c) for c in sources.columns]).alias("source"))
    return source.join(F.broadcast(best), "doc").crossJoin(F.broadcast(total)).select(F.col("doc").alias("id"), "score", "source", "total", "max_score")  # size rows; one row


def nested(df: DataFrame, column: str, test) -> DataFrame:
    """Rows of which one element of a nested field passes the whole test; ``test`` takes the element."""
    return df.where(F.exists(F.coalesce(F.col(column), F.array()), test))


def has_term(text: Column, term: str) -> Column:
    return F.array_contains(analyse(text), term.lower())


def mentions(values: Column, wanted: list[str], every: bool = False) -> Column:
    """Whether a keyword array holds one of the values, or all of them."""
    keys = F.array(*[F.lit(x) for x in wanted])
    return F.size(F.array_except(keys, values)) == 0 if every else F.arrays_overlap(values, keys)


def token_column(df: DataFrame, text: str, name: str = "tokens") -> DataFrame:
    """Distinct lower-case words, neither stemmed nor less stop words."""
    return df.withColumn(name, F.array_distinct(analyse(F.col(text))))


def token_match(tokens: Column, text: str) -> Column:
    """All words of the query are there."""
    return mentions(tokens, query_terms(text), every=True)
