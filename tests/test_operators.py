"""Merges, audits, graph patterns, sources, sinks and micro-batches on literal rows."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from quirelake.operators import clusters, evaluate, graph, normalize, pages, relational, resolve, search
from quirelake.sources import records, sinks
from quirelake.streaming import microbatch

C = F.col


def test_merge_does_not_depend_on_partitions(spark):
    rows = [("k", 1, "ab", ["x", "y"], ["t1"]), ("k", 2, "abc", ["y", "z"], ["t1", "t2"]), ("k", 3, "abd", [], []), ("one", 4, None, ["q", "q"], ["t"])]
    want = None
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "k string, o int, text string, images array<string>, lists array<string>").repartition(seed + 1)
        got = sorted(tuple(r) for r in resolve.merge_group(df, "k", "o", "text", "images", ["lists"]).select("k", "text", "images", "lists", "merged_records").collect())
        want = want or got
        assert got == want
    assert want == [("k", "abc", ["x", "y", "z"], ["t1", "t1", "t2"], 3), ("one", "", ["q", "q"], ["t"], 1)]


def test_writers(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y")], "k string, o int, v string")
    assert sorted(tuple(r) for r in resolve.first_writer_wins(df, ["k"], ["o"]).collect()) == [("a", 1, "x"), ("b", 1, "y")]
    assert sorted((r.k, r.v) for r in resolve.last_writer_wins(df, ["k"], ["o"]).collect()) == [("a", None), ("b", "y")]


def test_dating_follows_the_first_known_year(spark):
    row = lambda o, start, display, year: ("k", o, None, None, None, None, None, None, [], 0, 0.5, start, display, year)
    ddl = "k string, o int, transcription string, translation string, description string, language string, material string, condition string, joins array<string>, image_count int, completeness double, date_start string, date_display string, year int"
    df = spark.createDataFrame([row(1, "969-01-01", "969", None), row(2, None, "none", None), row(3, "1050-01-01", "1050", 1050), row(4, "1100-01-01", "1100", 1100)], ddl)
    r = resolve.canonical_records(df, "k", "o").head()
    assert (r.year, r.date_text, r.records) == (1050, "1050", 4)


def test_audit(spark):
    t = {
        "documents": spark.createDataFrame([("d1", "m1"), ("d2", "m1"), ("d2", None)], "document_id string, canonical_shelf_mark string"),
        "source_records": spark.createDataFrame([("r1", "d1", "s", "1"), ("r2", "d9", "s", "2")], "record_id string, document_id string, source_name string, source_id string"),
    }
    got = {(r.table, r.rule): r.violations for r in relational.audit(t).collect()}
    assert got[("documents", "primary key document_id")] == 1 and got[("documents", "unique canonical_shelf_mark")] == 1 and got[("documents", "not null canonical_shelf_mark")] == 1
    assert got[("source_records", "reference document_id to documents")] == 1


def test_containers(spark, tmp_path):
    shapes = {
        "a.json": {"documents": [{"doc_id": "1"}, {"doc_id": "2"}]},
        "b.json": {"k1": {"doc_id": "3"}, "scraping_metadata_x": {}, "k2": {"doc_id": "4"}},
        "c.json": {"doc_id": "5", "images": []},
        "d.json": [{"doc_id": "6"}],
    }
    for name, x in shapes.items():
        (tmp_path / name).write_text(json.dumps(x))
    got = records.read_containers(spark, [str(tmp_path)]).select(F.get_json_object("record", "$.doc_id").alias("d"), "ordinal").collect()
    assert sorted(r.d for r in got) == list("123456")
    assert sorted(F_r.ordinal for F_r in records.read_containers(spark, [str(tmp_path)], resume_from=1).collect()) == [1, 1]


def test_structured_pages_and_metadata(spark, tmp_path):
    folder = tmp_path / "book_structured"
    folder.mkdir()
    (folder / "page_002_structured.json").write_text(json.dumps({"summary": "two", "metadata": {"page_number": 2}, "transcriptions": {"m": {"10": "b", "2": "a", "x": "c", "3": " "}}}))
    (folder / "page_001_structured.json").write_text(json.dumps({"summary": "one", "metadata": {"page_number": 1}}))
    (folder / "page_003_structured.json").write_text("{broken")
    (tmp_path / "book_metadata.json").write_text(json.dumps({"title": "T", "author": "A, B", "keywords": ["k"]}))
    good, bad = records.read_structured_pages(spark, str(tmp_path))
    assert [r.summary for r in good.collect()] == ["one", "two"] and bad.count() == 1
    assert good.where("summary = 'two'").select(normalize.nested_transcriptions(C("transcriptions")).alias("t")).head().t == {"m": "a\nb\nc"}
    m = records.read_book_metadata(spark, str(tmp_path / "book_metadata.json")).head()
    assert (m.title, m.authors, m.subjects) == ("T", ["A", "B"], ["k"])
    (tmp_path / "book_images").mkdir()
    (tmp_path / "book_images" / "p.png").write_bytes(b"x")
    task = records.tasks(records.listing(spark, str(tmp_path)), "_structured", ("_structured",)).head()
    assert task.folder.endswith("book_structured") and task.image_folder.endswith("book_images") and task.pages == 3


def test_derived_document(spark):
    ddl = f"doc_id string, shelf_mark string, description string, language string, original_url string, miscellaneous_info string, document_category string, image_urls array<string>, translations array<string>, transcriptions {normalize.SECTION}, date {normalize.KV}, full_metadata {normalize.KV}, related_people array<struct<name:string>>, related_places array<struct<name:string>>, bibliography array<string>"
    row = ("d", "T-S AS 1", "Description Marriage contract", "Unknown", None, None, None, ["u"], [" ", "tr"], [("s", "map", [("1", "x"), ("2", "")])], [("standard_date", "0932-01-01")], [("textLang {'mainLang': 'heb'}", "v")], [("P",)], [], [])
    full = normalize.derived(spark.createDataFrame([row], ddl)).cache()
    r = full.head()
    assert (r.institution, r.document_type, r.lines, r.description) == ("Cambridge University Library", "ketubah", ["x"], "Marriage contract")
    assert r.completeness_score == pytest.approx((1 + 1 + 1 + 2 + 1 + 1 + 0.5) / 10) and r.content_quality == "medium"
    s = normalize.search_document(full).head()
    assert (s.date_start, s.main_language, s.primary_image_url, s.has_transcriptions) == ("932-01-01", "Hebrew", "u", True) and s.full_text == "Marriage contract x tr"


def test_graph_patterns(spark):
    e = spark.createDataFrame([("1", "a", "b"), ("2", "b", "c"), ("3", "a", "c")], "id string, a string, b string")
    got = {(r.start, r.end, r.hops): r.paths for r in graph.paths(e, spark.createDataFrame([("a",)], "start string"), 3).collect()}
    assert got == {("a", "b", 1): 1, ("a", "c", 1): 1, ("a", "c", 2): 1, ("a", "b", 2): 1, ("a", "a", 3): 2}
    pairs = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "y"), (2, "z"), (2, "z")], "h int, i string")
    assert {tuple(r) for r in graph.cooccurrence(pairs, "h", "i", 2).collect()} == {("x", "y", 2), ("y", "x", 2)}


def test_clusters(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b"), (2, "b")], "k int, c string")
    assert clusters.purity(df, "k", "c").head().purity == pytest.approx(0.8)
    pts = spark.createDataFrame([(i, [float(i // 3 * 10), float(i % 3)], i // 3) for i in range(6)], "id long, v array<double>, g int")
    assert clusters.silhouette(pts, "id", "v", "g", block=2).head().silhouette == pytest.approx(clusters.silhouette(pts, "id", "v", "g").head().silhouette)
    assert clusters.silhouette(pts, "id", "v", "g").head().silhouette > 0.8


def test_search(spark):
    df = spark.createDataFrame([(1, "old letter", "x"), (2, "letter letter of trade", ""), (3, "nothing", "letter")], "id int, description string, body string")
    top = search.search(df, "id", "Letter", [("description", 2.0), ("body", 1.0)], size=2).collect()
    assert [r.doc for r in top] == [2, 1] and {r.total for r in top} == {3}
    assert search.search(df, "id", "absent", [("description", 1.0)]).count() == 0


def test_unlinked_and_images(spark):
    m = lambda *x: spark.createDataFrame([(v,) for v in x], "mark string")
    assert {tuple(r) for r in pages.unlinked(m("A", "B"), m("B", "C"), "mark").collect()} == {("A", "mentioned"), ("C", "transcribed")}
    doc = spark.createDataFrame([("b", 7), ("b", 8)], "book string, page int")
    listing = spark.createDataFrame([("b", "7.png", "late"), ("b", "page_007.jpg", "early")], "book string, name string, path string")
    assert [r.image_path for r in pages.image_for_page(doc, listing, "book", "page").orderBy("page").collect()] == ["early", None]


def test_model_calls_are_injected(spark):
    df = spark.createDataFrame([("b", 2, "y"), ("b", 1, "x")], "book string, page int, text string")
    got = pages.with_model(df, lambda f: f.assign(text=f.text.str.upper()), df.schema.simpleString()[7:-1].replace(":", " ")).collect()
    assert {r.text for r in got} == {"X", "Y"}
    whole = pages.with_context(df, "book", lambda f: f.sort_values("page").groupby("book", as_index=False).agg(text=("text", "".join)), "book string, text string").head()
    assert whole.text == "xy"


def test_evaluation(spark):
    df = spark.createDataFrame([("d", "m1", "abc"), ("d", "m2", "abc"), ("d", "m3", "xyz")], "doc string, model string, text string")
    got = {(r.model_a, r.model_b): r.disagree for r in evaluate.disagreements(df, "doc", "model", "text").collect()}
    assert got == {("m1", "m2"): False, ("m1", "m3"): True, ("m2", "m3"): True}
    s = spark.createDataFrame([("a", 0.2), ("b", 0.2), ("consensus", 0.1)], "model string, avg_cer double")
    b = evaluate.best_model(s, "model", "consensus").head()
    assert (b.best_model, round(b.gain, 6)) == ("a", 0.1)


def test_micro_batches_resume(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    assert microbatch.status(spark, state, out).head().state == "not_started"
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").coalesce(1).write.parquet(src)
    assert microbatch.ingest(spark, src, "id int, v string", out, state)["rows"] == 2
    assert microbatch.ingest(spark, src, "id int, v string", out, state)["rows"] == 0
    spark.createDataFrame([(2, "again"), (3, "c")], "id int, v string").coalesce(1).write.mode("append").parquet(src)
    assert microbatch.ingest(spark, src, "id int, v string", out, state)["rows"] == 2
    assert sorted((r.id, r.v) for r in microbatch.consolidate(spark, out, "id").collect()) == [(1, "a"), (2, "b"), (3, "c")]
    assert microbatch.status(spark, state, out, 5).head().state == "in_progress"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("d", 1, "old"), ("d", 2, "new"), (None, 3, "x")], "doc_id string, o int, v string")
    assert {(r["_id"], r.v) for r in sinks.write_index(df, str(tmp_path / "i"), "doc_id", "o").collect()} == {("d", "new"), ("doc_3", "x")}
    sinks.write_bulk(df.where("doc_id is not null"), str(tmp_path / "b"), "idx", "doc_id")
    lines = [json.loads(x) for f in (tmp_path / "b").glob("part-*") for x in f.read_text().splitlines()]
    assert len(lines) == 4 and sum("index" in x for x in lines) == 2


def test_records_of_both_families(spark):
    from quirelake.operators import records as r

    tei = {"doc_id": "MS-X/1", "image_urls": ["u"], "transcriptions": [{"name": "a", "lines": {"2": "x", "1": "y"}}, {"name": "b", "lines": ["p", "q"]}, {"name": "c", "lines": "one"}], "date": {"standard_date": "950/1300"}, "language": "ignored", "full_metadata_info": {r.TEI + "idno": "ID 1", "Title": "T", r.TEI + "textLang": "heb, arc", r.TEI + "provenance": "from Fustat"}}
    linked = {"images": ["i"], "language": "Hebrew", "transcriptions": {"1": "x\n\n y ", "2": " "}, "translations": {"a": "t", "b": " "}, "other_info": {"material": "Paper"}, "related_people": [{"name": "P"}, {"role": "x"}], "date": {"hebrew_date": "1050"}, "joins_data": {"mainShelfmark": "M"}}
    a = r.tei_documents(spark.createDataFrame([(json.dumps(tei),)], "record string"))
    row = a.head()
    assert [(s.name, s.kind, [(e.k, e.v) for e in s.lines]) for s in row.transcriptions] == [("a", "map", [("2", "x"), ("1", "y")]), ("b", "list", [("1", "p"), ("2", "q")]), ("c", "text", [("1", "one")])]
    assert row.language == "Unknown" and row.full_metadata[0].v == "ID 1"
    d = normalize.derived(a).head()
    assert (d.source_collection, d.temporal.date_start, d.language_info.main_language, d.lines) == ("cambridge", "950-01-01", None, ["x", "y", "p", "q", "one"])
    f = a.select(r.adapter_fields(C("full_metadata"), C("doc_id"), C("shelf_mark"), F.lit(None).cast("string"), F.lit("Unknown")).alias("f")).head().f
    assert (f.shelf_mark, f.place, f.languages, f.dating) == ("ID 1", "Fustat", ["arc", "heb"], None)
    b = r.linked_documents(spark.createDataFrame([("k1", json.dumps(linked))], "id string, record string"), key="id")
    d = normalize.derived(b).head()
    assert (d.doc_id, d.lines, d.translations, d.physical_notes.material, d.entities.people, d.source_collection, d.joins_data.mainShelfmark) == ("k1", ["x", "y"], ["t"], "Paper", ["P"], "princeton", "M")
    h = lambda s, m: tuple(spark.range(1).select(r.holding(F.lit("L"), F.lit(s), F.lit(m), F.lit(None).cast("string")).alias("h")).head().h)
    assert h("x", "MS-TS-AS-1") == ("L", "Unknown", "AS") and h("Rylands", "B 1") == ("Rylands", "Friedberger Collection", None)


def test_source_records(spark):
    from quirelake.operators.records import source_records

    df = spark.createDataFrame([("s", "1", "m", "old", "d1", 1), ("s", "1", "m2", "new", "d2", 2), ("s", None, "m3", "x", "d3", 3)], "source_name string, doc_id string, shelf_mark string, original_url string, document_id string, o int")
    got = {(r.source_id, r.original_url, r.document_id) for r in source_records(df, "o").collect()}
    assert got == {("1", "new", "d1"), ("m3", "x", "d3")}


def test_page_documents(spark):
    from quirelake.operators.records import page_documents, page_search_document
    from quirelake.sources.records import STRUCTURED_PAGE

    raw = spark.createDataFrame([(json.dumps({"extracted_page_number": [119], "shelf_marks_mentioned": {"A": "x"}, "transcriptions": {"A": {"2": "b", "1": "a"}}, "summary": "S"}),)], "j string")
    pages_ = page_documents(raw.select(F.from_json("j", STRUCTURED_PAGE).alias("p")).select("p.*"), F.lit("book"))
    book = spark.createDataFrame([("T", ["A"], ["s"], "P", "1999")], "title string, authors array<string>, subjects array<string>, publisher string, publication_date string")
    r = page_search_document(pages_, book).head()
    assert (r.doc_id, r.page_number, r.shelf_mark, r.transcriptions, r.full_text_content, r.title) == ("book_p119", 119, "A", {"A": "a\nb"}, "Summary: S\nTranscriptions: a\nb", "T")
