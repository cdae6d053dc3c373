"""Outside formats, the stored index and list-valued fields on small inputs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.functions import images, notes
from quirelake.operators import clusters, index, search
from quirelake.sources import exchange, records
from quirelake.streaming import microbatch


def test_vector_archives(spark, tmp_path):
    np.savez(tmp_path / "a.npz", other=np.ones((1, 2)), embeddings=np.array([[3.0, 4.0], [0.0, 2.0]]))
    np.savez(tmp_path / "b.npz", img_emb=np.ones((1, 2, 2)))
    np.savez(tmp_path / "c.npz", first=np.array([[5.0, 0.0]]))
    (tmp_path / "d.txt").write_text("no archive")
    rows = exchange.read_vector_archives(spark, f"file://{tmp_path}").orderBy("path", "row").collect()
    assert [r.embedding for r in rows] == [[0.6, 0.8], [0.0, 1.0], [0.5] * 4, [1.0, 0.0]]
    assert [r.row for r in rows] == [0, 1, 0, 0]


def test_listing_of_one_kind(spark, tmp_path):
    for name in ("a.pdf", "b.PDF", "c.txt"):
        (tmp_path / name).write_text("x")
    assert [r.name for r in records.listing(spark, str(tmp_path), "*.pdf").collect()] == ["a.pdf"]


def test_ordinals_follow_the_order(spark):
    df = spark.range(1000).repartition(7).select((F.col("id") * 7919 % 1000).alias("k"))
    assert all(r.k == r.ordinal for r in exchange.ordinals(df, "k").collect())
    assert exchange.ordinals(df.where("k < 0"), "k").count() == 0


def test_batches_that_are_no_records(spark, tmp_path):
    (tmp_path / "batch_0.jsonl").write_text('{"a": 1}\nnonsense\n{"a": 3}\n')
    got = sorted((r.a is None, r.a, r.batch) for r in exchange.read_batches(spark, str(tmp_path), "a long").collect())
    assert got == [(False, 1, "batch_0.jsonl"), (False, 3, "batch_0.jsonl"), (True, None, "batch_0.jsonl")]


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Away:
        applicationId = "away"
        master = "spark://elsewhere:7077"
        getConf = lambda self: {}

    class Session:
        conf = {}
        sparkContext = Away()

    with pytest.raises(ValueError):
        exchange.scratch_folder(Session(), "x")


def test_index_reads_the_buckets_of_its_terms(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red house", "a"), (2, "blue house house", "b"), (3, "", None), (4, None, "red")], "d int, t string, s string")
    fields = [("t", 1.0), ("s", 2.0)]
    built = index.build_index(docs, "d", ["t", "s"], str(tmp_path / "i"), buckets=16)
    for text in ("house", "red house", "nothing", ""):
        want = {r.doc: round(r.score, 9) for r in search.lexical(docs, "d", fields, text).collect()} if text else {}
        assert {r.doc: round(r.score, 9) for r in index.lexical_indexed(spark, built, fields, text).collect()} == want
    plan = index.lexical_indexed(spark, built, fields, "house")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters")[1][:120]
    found = index.hits(search.lexical(docs, "d", fields, "house"), docs, "d", 1).collect()
    assert [(r.id, r.source.t, r.total) for r in found] == [(2, "blue house house", 2)] and found[0].score == found[0].max_score


def test_nested_and_lists(spark):
    df = spark.createDataFrame([(1, [("e", "one two")], ["a", "b"]), (2, [("f", "two")], ["c"]), (3, None, None)], "i int, n array<struct<editor:string,text:string>>, k array<string>")
    assert [r.i for r in index.nested(df, "n", lambda e: (e["editor"] == "e") & index.has_term(e["text"], "TWO")).collect()] == [1]
    assert [r.i for r in df.where(index.mentions(F.col("k"), ["b", "c"])).collect()] == [1, 2]
    assert [r.i for r in df.where(index.mentions(F.col("k"), ["a", "b"], every=True)).collect()] == [1]
    assert [r.x for r in df.select(F.size(images.aligned_images(F.col("k"), F.array())).alias("x")).collect()][:2] == [2, 1]


def test_cluster_of_no_members(spark):
    df = spark.createDataFrame([(0, "a"), (0, "a"), (0, "b"), (2, "c")], "c long, k string")
    got = {r.c: (r.total, r.categories, r.dominant, round(r.purity, 3)) for r in clusters.category_counts(df, "c", "k", 3).collect()}
    assert got == {0: (3, {"a": 2, "b": 1}, "a", 0.667), 1: (0, {}, None, 0.0), 2: (1, {"c": 1}, "c", 1.0)}
    mean = clusters.mean_vector(spark.createDataFrame([("x", [1.0, 2.0]), ("x", [3.0, 4.0])], "g string, v array<double>"), "g", "v")
    assert mean.head().mean == [2.0, 3.0]


def test_status_without_a_number(spark, tmp_path):
    folder = f"{tmp_path}/in"
    rows = spark.range(10).selectExpr("id")
    rows.write.parquet(folder)
    microbatch.ingest(spark, folder, rows.schema, f"{tmp_path}/out", f"{tmp_path}/state")
    assert microbatch.status(spark, f"{tmp_path}/state", f"{tmp_path}/out").head().state == "completed"
    (tmp_path / "state" / "offsets" / "99").write_text("planned")
    assert microbatch.status(spark, f"{tmp_path}/state", f"{tmp_path}/out").head().state == "in_progress"


def test_rates(spark):
    row = spark.range(1).select(notes.rate(F.lit(1), F.lit(0)).alias("none"), notes.rate(F.lit(1), F.lit(4)).alias("quarter"), notes.perplexity(F.lit(2)).alias("few"), notes.perplexity(F.lit(31)).alias("many")).head()
    assert tuple(row) == (0.0, 0.25, 1, 30)
