"""The stages one by one, and the registered queries."""

from __future__ import annotations

import duckdb
import pytest

from quirelake.llm.queries import SQL

from . import brute
from ..test_queries import TABLES, rows


def test_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in p.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, sf_dir).cache()
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        kept[name] = before, after
    before, after = kept["ngram_jaccard_join"]
    assert set(after) == {d for d, (_, root) in brute.similar_documents(before.items(), 5, 0.8).items() if root == d}
    before, after = kept["substring_dedup"]
    want = brute.phrases(before.items(), 20)
    assert after == {d: (before[d] if not gone else text) for d, (n, gone, _, text) in want.items() if gone < n or n == 0}
    before, after = kept["benchmark_decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(after) == {d for d, x in brute.contamination(before.items(), items, 13).items() if not x[4]}
    packed = p.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(after)


def test_rows_ingested_twice_stay_once(spark):
    import corpus_pipeline as p

    rows = [(1, "one two three four five six", "a"), (1, "one two three four five six", "a"), (1, "another text of the same id here", "a"), (2, None, "a"), (2, None, "a"), (3, "one two three four five six", "a"), (4, "alone", "a"), (None, "x", "a"), (None, "x", "a")]
    got = dict(p.STAGES)["ngram_jaccard_join"](spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [rows[0], rows[2], rows[3], rows[6], rows[7], rows[8]]))


def test_every_operator_has_a_query():
    from quirelake.llm.queries import QUERIES

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, name):
    from quirelake.llm.queries import QUERIES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got, want = QUERIES[name](spark, sf_dir).toArrow(), con.sql(SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names) and rows(got) == rows(want)


def test_byte_spans_of_all_documents(spark, sf_dir):
    from quirelake.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op7_suffix_array_dedup"](spark, sf_dir).collect()}
    assert got == {d: tuple(x) for d, *x in brute.spans(docs, 400)}
