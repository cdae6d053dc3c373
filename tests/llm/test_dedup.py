"""Repeated phrases, repeated byte spans, near duplicates of texts and vectors, against plain versions."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirelake.llm import kernels as K
from quirelake.llm.embed_dedup import embedding_dedup
from quirelake.llm.ngram_join import band_count, ngram_join
from quirelake.llm.phrase_dedup import Shard, confirmed, phrase_dedup, strip_phrases
from quirelake.llm.queries import QUERIES
from quirelake.llm.repeats import Spans, anchors
from quirelake.llm.suffix_dedup import blind_trie, common_prefix, deep_shallow, suffix_dedup

from . import brute

TEXT = "doc_id long, text string"
CLASHING = "doc_id long, text string, key long, c1 long, n long, d long, marks string, kept boolean, class_id string, bands string, label int, start long"


def corpus(seed: int = 5) -> list[tuple[int, str | None]]:
    """Copies, near copies, shared passages, periodic texts, long words, nulls and empties."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 6)))
    passage = [word() for _ in range(45)]
    base = [word() for _ in range(120)]
    rows: list[tuple[int, str | None]] = [(1, None), (2, ""), (3, " \t\n "), (4, "x"), (5, "a " * 70), (6, "a " * 90), (7, "ab" * 300), (8, "b" + "ab" * 260)]
    for i in range(10, 22):
        words = [word() for _ in range(rnd.randrange(5, 90))]
        at = rnd.randrange(len(words) + 1)
        cut = passage[rnd.randrange(0, 12) : rnd.randrange(30, 46)]
        rows.append((i, " ".join(words[:at] + cut + words[at:])))
    for i in range(30, 36):
        words = list(base)
        words[rnd.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    rows += [(40, " ".join(base)), (41, " ".join(base)), (42, "\n".join(base)), (43, " ".join(base).upper())]
    return rows


def widened(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2, 3, 4, "m", True, "c", "b", 5, 6) for d, t in rows], CLASHING)


@pytest.mark.parametrize("limit", [1, 3, 512])
def test_phrases(spark, limit):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.text) for r in phrase_dedup(widened(spark, corpus()), length=8, k=3, limit=limit).collect()}
    assert got == brute.phrases(corpus(), 8)


def test_phrase_text_is_rewritten_in_place(spark):
    want = brute.phrases(corpus(), 8)
    got = {r.doc_id: r for r in strip_phrases(widened(spark, corpus()), length=8, k=3).collect()}
    assert set(got) == {d for d, (n, gone, *_) in want.items() if gone < n or n == 0}
    for d, t in corpus():
        if d in got:
            assert got[d].text == (t if want[d][1] == 0 else want[d][3]) and got[d].class_id == "c"


@pytest.mark.parametrize("limit", [2, 256])
def test_byte_spans(spark, limit):
    got = sorted((tuple(r)[:-1] for r in suffix_dedup(widened(spark, corpus()), length=40, k=12, limit=limit).collect()), key=str)
    assert got == brute.spans(corpus(), 40)


def test_passages_of_over_50_words_go_from_400_bytes_on(spark, tmp_path):
    rnd = random.Random(7)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefghé") for _ in range(5)) for _ in range(n))
    rows, planted = [(90, prose(90)), (91, prose(200))], {}
    for i, size in enumerate((399, 400, 401, 700)):
        passage = prose(120).encode()[:size].decode("utf-8", "ignore")
        passage += "x" * (size - len(passage.encode()))
        assert len(passage.split()) > 50
        rows += [(2 * i, f"{prose(30)} <{passage}> {prose(30)}"), (2 * i + 1, f"{prose(40)} [{passage}] {prose(5)}")]
        planted |= {2 * i: (size, passage), 2 * i + 1: (size, passage)}
    spark.createDataFrame(rows, TEXT).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op7_suffix_array_dedup"](spark, str(tmp_path)).collect()
    assert sorted((tuple(r)[:-1] for r in got), key=str) == brute.spans(rows, 400)
    texts = dict(rows)
    for r in got:
        size, passage = planted.get(r.doc_id, (0, ""))
        gone = size >= 400
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(texts[r.doc_id].encode()), size * gone, int(gone))
        assert r.text == (texts[r.doc_id].replace(passage, "") if gone else texts[r.doc_id])


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "ab" * 40), (1, "ab" * 40), (None, "cd" * 40), (None, None), (2, "xyz" * 30)]
    df = spark.createDataFrame(rows, TEXT)
    spans = sorted((r.doc_id or 0, r.n_removed) for r in suffix_dedup(df, length=30, k=8).collect())
    assert spans == [(0, 0), (0, 0), (1, 80), (1, 80), (2, 90)]  # the periodic texts repeat themselves
    assert phrase_dedup(df, length=4).count() == 5
    near = {(r.doc_id, r.class_id, r.n_links, r.kept) for r in ngram_join(df).collect()}
    assert near == {(1, 1, 1, True), (None, None, 0, True), (2, 2, 0, True)}


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(120))
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix_dedup(spark.createDataFrame([(1, a), (1, b), (2, a)], TEXT), length=60, k=12).collect()}
    assert got == {(1, len(a)): len(a), (1, len(b)): 0, (2, len(a)): len(a)}
    rows = [(5, a), (5, "pre pre pre " + a), (5, b), (6, b), (6, b)]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in phrase_dedup(spark.createDataFrame(rows, TEXT)).collect())
    assert got in ([(5, 60, 0), (5, 63, 60), (5, 120, 0), (6, 120, 120), (6, 120, 120)], [(5, 60, 60), (5, 63, 0), (5, 120, 0), (6, 120, 120), (6, 120, 120)])


def test_the_automaton_finds_what_nobody_placed():
    shard = Shard()
    shard.add(b"a b c", (1, 0, 7))
    assert shard.hits(1, 0, b"x a b c".split()) is None  # before the first place
    assert shard.hits(2, 0, b"a b a b c y a b c".split()).tolist() == [False, False, True, True, True, False, True, True, True]
    assert Shard().hits(2, 0, [b"a"]) is None


def test_phrases_of_a_block_are_routed_without_places(spark):
    """One phrase row a block, however many copies the block has: only the automaton can find them all."""
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(30))) for i in range(400)], TEXT)
    phrases, _ = confirmed(docs, Spans("words", 20, 4))
    assert phrases.groupBy("block").count().agg({"count": "max"}).head()[0] == 1
    assert sorted(r.n_removed for r in phrase_dedup(docs).collect()) == [0] + [30] * 399


def test_a_long_document_in_parts(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(K, "CHUNK_BYTES", 64)
    from quirelake.llm.repeats import _parts

    texts = pa.array([t for _, t in rows], pa.string())
    for unit in ("bytes", "words"):
        found = {}
        for size in (64, 1 << 18):
            K.CHUNK_BYTES = size
            batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows]), pa.array([0] * len(rows)), texts], ["doc_id", "rid", "text"])
            found[size] = sorted(tuple(r.values()) for b in anchors(Spans(unit, 40 if unit == "bytes" else 8, 3))(iter([batch])) for r in b.to_pylist())
        assert found[64] == found[1 << 18]


def test_empty_tables(spark):
    none = spark.createDataFrame([], TEXT)
    assert [f(none).count() for f in (phrase_dedup, suffix_dedup, ngram_join, strip_phrases)] == [0] * 4
    assert embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("block", [2, 256])
def test_near_duplicates(spark, block):
    got = {r.doc_id: (r.n_links, r.class_id) for r in ngram_join(widened(spark, corpus()), block_docs=block).collect()}
    want = brute.similar_documents(corpus(), 5, 0.8)
    assert got == want and sum(n for n, _ in want.values()) > 20


def test_near_duplicates_under_one_id(spark):
    a, b = ([f"{x}{i}" for i in range(60)] for x in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a, "x"])), (3, " ".join([*b, "y"])), (3, " ".join([*b, "y"]))]
    got = sorted((r.doc_id, r.n_links, r.class_id, r.kept) for r in ngram_join(spark.createDataFrame(rows, TEXT)).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False)]


def test_a_large_group_of_equal_vectors(spark):
    rows = [(i, [1.0, 0.0, 0.5], "a") for i in range(20_000)] + [(30_000, [1.0, 0.0, 0.51], "a"), (30_001, [0.0, 1.0, 0.0], "a"), (30_002, [1.0, 0.0, 0.5], "b"), (7, [0.0, 1.0, 0.01], "a")]
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")).collect()}
    assert {x for x in got if x[0] in (0, 1, 30_000, 30_002)} == {(0, 20_000, 0, True), (1, 20_000, 0, False), (30_000, 20_000, 0, False), (30_002, 0, 30_002, True)}
    assert {x[1:] for x in got if x[0] == 7} == {(20_000, 0, False), (1, 7, True)} and (30_001, 1, 7, False) in got


def test_band_count_reaches_the_recall():
    for rows in range(1, 9):
        assert 1 - (1 - 0.8**rows) ** band_count(0.8, rows, 0.999) >= 0.999


def vectors(n: int = 160, dim: int = 16):
    rnd = random.Random(3)
    rows = [(0, None, 1), (1, [], 1), (2, [0.0] * dim, 1), (3, [float("nan")] + [1.0] * (dim - 1), 1), (4, [None] + [1.0] * (dim - 1), 1), (5, [1.0] * dim, None), (6, [1.0] * dim, 1), (7, [2.0] * dim, 1), (8, [1.0] * 3, 1), (9, [1.0] * dim, 2)]
    for i in range(10, n):
        if i % 3 and i > 12:
            seed = rows[rnd.randrange(10, len(rows))]
            rows.append((i, [x + rnd.gauss(0, 0.08) for x in seed[1]], seed[2]))
        else:
            rows.append((i, [rnd.gauss(0, 1) for _ in range(dim)], rnd.randrange(3)))
    return rows


@pytest.mark.parametrize("options", [{}, {"cell_rows": 10}, {"cell_rows": 10, "block": 8}, {"cell_rows": 10, "margin": None}])
def test_vectors(spark, options):
    import struct

    rows = [(i, None if v is None else [None if x is None else struct.unpack("f", struct.pack("f", x))[0] for x in v], label) for i, v, label in vectors()]
    df = spark.createDataFrame([(*r, "a", 1, True) for r in rows], "vec_id long, embedding array<float>, label int, unit string, cell int, home boolean")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup(df, **options).collect()}
    want = brute.similar_vectors(rows, 0.93)
    found, there = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert there > 50 and found <= there
    if options.get("cell_rows") is None or "margin" in options:
        assert got == want  # one cell, or a margin that is exact
    else:
        assert found >= 0.99 * there


def test_vectors_of_few_directions(spark):
    import numpy as np

    rng = np.random.default_rng(11)
    x = (rng.normal(size=(1500, 3)) @ rng.normal(size=(3, 64)) + rng.normal(size=(1500, 64)) * 0.05).astype(np.float32)
    got = {r.vec_id: r.n_links for r in embedding_dedup(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int"), cell_rows=100).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    assert got == dict(enumerate(want.tolist())) and want.sum() > 10_000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=30).map(lambda b: bytes(x % 3 + 97 for x in b)), min_size=1, max_size=30), st.integers(0, 6))
def test_deep_shallow_sorts(strings, shallow):
    order, shared = deep_shallow(strings, 0, shallow)
    assert [strings[i] for i in order] == sorted(strings) and sorted(order) == list(range(len(strings)))
    assert all(shared[j] == common_prefix(strings[order[j - 1]], strings[order[j]]) for j in range(1, len(order)))
    assert [strings[i] for i in blind_trie(strings, list(range(len(strings))), 0)] == sorted(strings)
