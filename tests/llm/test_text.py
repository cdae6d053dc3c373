"""Decontamination, classifier, tokens, archives and packing."""

from __future__ import annotations

import io
import random
import zlib
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirelake.llm import kernels as K
from quirelake.llm.components import components
from quirelake.llm.decontaminate import decontaminate
from quirelake.llm.packing import CAPACITIES, bin_cost, pack, pack_documents
from quirelake.llm.quality_fm import fit, keep_good, logits, quality_scores
from quirelake.llm.queries import QUERIES, tokenizer_path
from quirelake.llm.token_binary import pack_values, read_file, token_binary, unpack_values, write_tokens
from quirelake.llm.token_counts import TREES, SegmentTree, count_trees, edit_trees, edited_counts, leaves, redactions
from quirelake.llm.tokens import encoder
from quirelake.llm.warc import read_archives, read_records, warc_records, write_archives, write_record

from . import brute

TEXT = "doc_id long, text string"
ODD = [None, "", " ", "  ", "a  b", "a b \n c", " lead", "trail ", "x\n\ny", "don't  do's", "tab\there", "<|endoftext|> hi", "é, ü. 12. a1, 3,4 (x) \"y\", ...", ",x", "a ,b", "x!. y", "a\x1fb c", "a\x1cb c", " x  y", "_, b", "word " * 300]


@cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def whole(text):
    return library().encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("most", [10**6, 0])
def test_contamination(spark, most):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcé") for _ in range(rnd.randrange(1, 4)))
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 3, 12, 13, 14, 30])))) for i in range(25)] + [(90, None), (91, "?!"), (None, "ab c"), (3, "repeated id of an item"), (92, ""), (10, "Ab C")]
    rows = [(i, " ".join(word() for _ in range(rnd.randrange(0, 40))) + " " + (items[rnd.randrange(25)][1] or "").upper() + ", " + " ".join(word() for _ in range(60))) for i in range(60)] + [(100, None), (101, ""), (102, "...")]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], TEXT + ", start long, m long, items string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) for r in decontaminate(df, spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, m string"), broadcast_windows=most).collect()}
    want = brute.contamination(rows, items, 13)
    assert got == want and sum(w[4] for w in want.values()) > 10


def test_contamination_of_repeated_and_null_ids(spark):
    item = " ".join(f"w{i}" for i in range(14))
    rows = [(1, item), (1, "nothing to see"), (1, "b " + item + " of two"), (1, item), (None, item), (None, "nor here"), (2, None)]
    df, items = spark.createDataFrame(rows, TEXT), spark.createDataFrame([(7, item), (8, "of two")], "item_id long, text string")
    one, two = (sorted(map(str, decontaminate(df, items, broadcast_windows=most).collect())) for most in (10**6, 0))
    assert one == two and sum("contaminated=True" in x for x in one) == 4


def test_contamination_of_nothing(spark):
    none, one = spark.createDataFrame([], TEXT), spark.createDataFrame([(1, "a b")], TEXT)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(none, empty).count() == 0
    assert [tuple(r) for r in decontaminate(one, empty).collect()] == [(1, 2, 0, 0, [], False)]


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=200), st.integers(1, 5), st.integers(1, 12))
def test_winnowing_keeps_one_of_every_window(data, k, width):
    units = K.TABLES[0][np.frombuffer(data, np.uint8)]
    grams = K.Spans(units).grams(k)
    kept = set(K.winnow(grams, np.array([0, len(data)]), k, width)[0].tolist())
    for start in range(len(data) - width - k + 2):
        assert kept & set(range(start, start + width))


def test_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(90), rnd.randrange(90)) for _ in range(70)] + [(1, 1), (None, 3), (5, 4), (5, 4)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    real = [(a, b) for a, b in links if a is not None and a != b]
    want = brute.components({x for e in real for x in e}, real)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classifier_learns_interactions():
    # label is whether two features agree: no linear rule can tell
    rnd = np.random.default_rng(1)
    a, b = rnd.integers(0, 2, 600), rnd.integers(0, 2, 600)
    which = np.stack([a, 2 + b], axis=1).ravel().astype(np.int32)
    bounds, label = np.arange(601) * 2, (a == b).astype(np.float32)
    model = fit(which, np.ones(1200, np.float32), bounds, label, 16, rounds=200)
    assert ((logits(model, which, np.ones(1200, np.float32), bounds) > 0) == label).mean() > 0.98


def test_sum_of_squares_identity():
    rnd = np.random.default_rng(4)
    from quirelake.llm.quality_fm import Model

    model = Model(8, 0.3, rnd.normal(size=20).astype(np.float32), rnd.normal(size=(20, 3)).astype(np.float32))
    which, value = np.array([1, 5, 7, 2]), rnd.normal(size=4).astype(np.float32)
    pairs = sum(model.factors[which[i]] @ model.factors[which[j]] * value[i] * value[j] for i in range(4) for j in range(i + 1, 4))
    assert np.isclose(logits(model, which, value, np.array([0, 4]))[0], 0.3 + model.linear[which] @ value + pairs, atol=1e-5)


def test_classifier_on_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest folder has too few labels to learn from
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = {r.doc_id: r for r in quality_scores(docs.withColumnRenamed("n_chars", "score"), labels).collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    judged = [(rows[x.doc_id].predicted, x.quality) for x in labels.collect() if rows[x.doc_id].held_out]
    assert sum(p == q for p, q in judged) >= 0.9 * len(judged)
    assert keep_good(docs, labels).columns == docs.columns


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "text"), (3, "w " * 5000), (3, "again")], TEXT)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {round(r.score, 3) for r in quality_scores(docs, none).collect()} == {0.5}
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1), (3, 0), (3, 1), (99, 0)], "doc_id long, quality int")
    assert quality_scores(docs, labels).count() == 5 and quality_scores(docs.limit(0), labels).count() == 0


def test_encoder_equals_the_library():
    rnd = random.Random(6)
    parts = ["a", "Bc", " ", "\n", ",", ".", "  ", "é", "'s", "12", "word", "!!", "\t", "_", "́"]
    texts = [t or "" for t in ODD] + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(40))) for _ in range(400)]
    ids, bounds = encoder(tokenizer_path()).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [whole(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=40))
def test_values_round_trip(values):
    control, data = pack_values(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4) and unpack_values(control, data, len(values)).tolist() == values


def test_token_files(spark):
    rows = [(i * 3 - 7, t) for i, t in enumerate(ODD)] + [(50, "twice"), (50, "twice"), (None, "no id")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], TEXT + ", start long, ids long")
    got = sorted((tuple(r) for r in token_binary(df, tokenizer_path()).collect()), key=lambda r: r[1])
    want, at = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = whole(t) + [2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert token_binary(df.limit(0), tokenizer_path()).count() == 0
    files, ranks = write_tokens(df, tokenizer_path(), file_tokens=10)
    assert files.count() >= 3 and sum(r.documents for r in files.collect()) == len(rows)
    by_rank = np.fromfile(ranks, "<i4").astype("<u4")
    assert sum(len(read_file(open(r.path, "rb").read(), by_rank)[2]) for r in files.collect()) == at


def test_segment_tree_follows_edits():
    rnd, known = random.Random(3), encoder(tokenizer_path())
    parts = ["a", "Bc", " ", "\n", ",", ".", "  ", "é", "'s", "12", "word", "!!"]
    for _ in range(60):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(120)))
        own = leaves(text, 10)
        tree = SegmentTree(own, np.diff(known.encode(own)[1]).tolist())
        for _ in range(4):
            a = rnd.randrange(len(text) + 1)
            b, new = min(len(text), a + rnd.randrange(12)), "".join(rnd.choice(parts) for _ in range(rnd.randrange(5)))
            tree.edit(a, b, new, known)
            text = text[:a] + new + text[b:]
            assert "".join(tree.parts) == text and tree.total == len(whole(text)) == sum(tree.tokens[tree.base :])


def test_edited_counts(spark):
    long = "some words here, " * 500
    rows = [(1, "write to a.b@c.org or +49 30 1234567 now"), (2, None), (3, ""), (4, long + "x@y.de " + long), (None, "no id")]
    got = {r.doc_id: r for r in edited_counts(spark.createDataFrame([(*r, 1) for r in rows], TEXT + ", n_tokens long"), tokenizer_path()).collect()}
    assert got[1].n_edits == 2 and got[1].n_tokens_edited == len(whole("write to <MAIL> or <NUMBER> now"))
    assert got[4].n_tokens_edited == len(whole(long + "<MAIL> " + long)) and got[4].n_chars_encoded < 1500
    assert (got[2].n_tokens, got[3].n_tokens_edited, got[None].n_tokens) == (0, 0, len(whole("no id")))
    odd = [(0, 3, "x"), (1, 5, "inside"), (-4, 0, "<"), (6, 99, ">"), (9, 4, "none")]
    edits = spark.createDataFrame([(3, "abc def", odd)], TEXT + ", edits array<struct<start:int,end:int,text:string>>")
    (row,) = edited_counts(edits, tokenizer_path(), find=None).collect()
    assert (row.n_edits, row.n_tokens_edited) == (3, len(whole("<x de>")))
    edits = spark.createDataFrame([(1, "abc def", [(0, 3, "x"), (4, 7, None)]), (2, "q", None)], TEXT + ", edits array<struct<start:int,end:int,text:string>>")
    assert {r.doc_id: r.n_tokens_edited for r in edited_counts(edits, tokenizer_path(), find=None).collect()} == {1: len(whole("x ")), 2: len(whole("q"))}


def test_kept_trees_take_edit_after_edit(spark):
    text = "some words here, " * 300
    start = spark.createDataFrame([(1, text), (2, None)], TEXT)
    trees, path = count_trees(start, tokenizer_path()), tokenizer_path()
    assert {r.doc_id: sum(r.tokens) for r in trees.collect()} == {1: len(whole(text)), 2: 0}
    for turn in range(3):
        at = 900 * turn
        once = edit_trees(trees, path, lambda t: [(at, at + 7, "(new)")] if t else [(0, 0, "born")])
        rows = {r.doc_id: r for r in once.collect()}
        text = text[:at] + "(new)" + text[at + 7 :]
        assert "".join(rows[1].leaves) == text and rows[1].n_tokens_edited == sum(rows[1].tokens) == len(whole(text))
        assert rows[1].n_chars_encoded < 1500
        trees = spark.createDataFrame([(r.doc_id, r.leaves, r.tokens) for r in rows.values()], TREES)
        assert "".join(rows[2].leaves).startswith("born")


def test_counts_of_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {}
    for r in docs.collect():
        edited, edits = r.text or "", redactions(r.text or "")
        for a, b, new in reversed(edits):
            edited = edited[:a] + new + edited[b:]
        want[r.doc_id] = len(whole(r.text)), len(edits), len(whole(edited)), len(r.text or "")
    got = QUERIES["op4_token_counts"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_tokens, r.n_edits, r.n_tokens_edited, r.n_chars) for r in got} == want and len(got) == len(want)


PAGES = [(1, "http://a/1", "same"), (2, "u\r\nX-Forged: 1", "same"), (3, None, None), (4, "d", ""), (5, "e", "é" * 70_000), (6, "f", "é" * 70_000), (7, "g", "alone\r\n\r\nWARC/1.1")]


@pytest.mark.parametrize("least", [0, 5])
def test_archives(spark, least):
    df = spark.createDataFrame([(*r, "x") for r in PAGES], "page_id long, url string, html string, refers_to string")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_records(df, least).collect()}
    assert got == brute.warc(PAGES, least)
    assert warc_records(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a", "x"), (None, "b", "x"), (1, "c", "x")], "page_id long, url string, html string")
    assert sorted(r.record_type for r in warc_records(odd).collect()) == ["response"] * 3


def test_pages_that_share_an_id(spark):
    rows = [(1, "a", "old"), (1, "b", "new"), (2, "c", "old"), (3, "d", "new"), (3, "e", "third"), (1, "f", "fourth"), (1, "g", "new")]
    got = warc_records(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    digest = lambda t: brute.warc([(0, None, t)], 0)[0][1]
    want = [(1, 3, digest("old"), "revisit", 2), (1, 3, digest("new"), "revisit", 3), (1, 3, digest("new"), "revisit", 3), (1, 6, digest("fourth"), "response", None)]
    want += [(2, 3, digest("old"), "response", None), (3, 3, digest("new"), "response", None), (3, 5, digest("third"), "response", None)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_payloads_come_in_chunks(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rows = read_archives(write_archives(df, chunk=1000), chunk=1000).orderBy("page_id", "chunk_no").collect()
    joined = {}
    for r in rows:
        assert len(r.payload) <= 1000
        joined[r.page_id] = joined.get(r.page_id, b"") + r.payload
    assert joined[6] == ("é" * 70_000).encode() and joined[7] == b"alone\r\n\r\nWARC/1.1" and joined[5] == b""


@pytest.mark.parametrize("chunk", [1, 7, 100, 4096])
def test_members_of_any_size_follow_each_other(chunk):
    rnd, out = random.Random(chunk), io.BytesIO()
    payloads = [(rnd.choice(["ab", "é", "xyz "]) * rnd.randrange(3000)).encode() + rnd.randbytes(rnd.randrange(50)) for _ in range(40)]
    for p in payloads:
        write_record(out, [("WARC-Type", "response")], memoryview(p), 1 << 16, 1)
    got, part = [], b""
    for _, _, last, seen, _, piece in read_records(io.BytesIO(out.getvalue()), chunk):
        part += piece
        assert len(piece) <= chunk and seen == len(part)
        if last:
            got.append(part)
            part = b""
    assert got == payloads


def test_a_broken_archive_is_an_error():
    out = io.BytesIO()
    write_record(out, [("WARC-Type", "response")], b"payload", 3, 1)
    assert b"".join(p for *_, p in read_records(io.BytesIO(out.getvalue() * 2), 4)) == b"payload" * 2
    with pytest.raises(ValueError):
        list(read_records(io.BytesIO(zlib.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort", wbits=31)), 4))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=80))
def test_bins_hold_what_they_say(lengths):
    bins, at, sizes = pack(np.array(lengths, np.int64), (16, 32, 64))
    for b in set(bins.tolist()):
        own = sorted((int(at[i]), lengths[i], int(sizes[i])) for i in range(len(lengths)) if bins[i] == b)
        used = sum(n for _, n, _ in own)
        assert {s for *_, s in own} == {min(c for c in (16, 32, 64) if c >= used)}  # downsized to its contents
        assert all(a + n == (own[j + 1][0] if j + 1 < len(own) else used) for j, (a, n, _) in enumerate(own))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=60))
def test_plain_best_fit(lengths):
    got = list(zip(*(x.tolist() for x in pack(np.array(lengths, np.int64), (16, 32, 64)))))
    assert got == brute.best_fit(lengths, (16, 32, 64), bin_cost)


def test_packing_of_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = QUERIES["op9_packing"](spark, sf_dir).collect()
    want = brute.packed([(r.doc_id, len(whole(r.text)) + 1) for r in docs], CAPACITIES, bin_cost)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.bin, r.capacity, r.position) for r in got if r.shard == 0) == sorted(want)


def test_rows_of_one_id_spread_over_shards(spark):
    rows = spark.range(60_000).selectExpr("cast(null as long) doc_id", "'x' text")
    got = pack_documents(rows, length=F.lit(900), shard_rows=2048).groupBy("shard").count().collect()
    assert sum(r["count"] for r in got) == 60_000 and max(r["count"] for r in got) <= 6 * 2048


def test_packing(spark):
    rows = [(1, "w " * 9000), (2, None), (3, ""), (None, "x"), (None, "x"), (4, "a b c"), (4, "a b c")]
    got = pack_documents(spark.createDataFrame([(*r, 1, 2) for r in rows], TEXT + ", length long, bin long")).collect()
    pieces = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 1)
    assert pieces == [(0, 0, 4096), (1, 4096, 4096), (2, 8192, 809)]
    assert len(got) == 9 and all(r.capacity in CAPACITIES and r.position + r.length <= r.capacity for r in got)
    assert pack_documents(spark.createDataFrame([], TEXT)).count() == 0


def test_queries_pack_tokens(spark, tmp_path):
    import corpus_pipeline
    from quirelake.llm.queries import QUERIES

    rows = [(1, "".join(chr(0x4E00 + i % 5000) for i in range(9000))), (2, None), (3, ""), (4, "a b c"), (None, "QUJD" * 3000)]
    df = spark.createDataFrame(rows, TEXT)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for out in (QUERIES["op9_packing"](spark, str(tmp_path)), corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path))):
        got = out.collect()
        for d, t in rows:
            own = [r for r in got if r.doc_id == d]
            assert sum(r.length for r in own) == len(whole(t)) + 1
            assert all(r.position + r.length <= r.capacity <= CAPACITIES[-1] for r in own)
