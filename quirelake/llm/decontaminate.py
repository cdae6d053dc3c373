"""Benchmark decontamination by winnowing.

Documents and benchmark items are fingerprinted with the smallest k-gram hash of each sliding window, so any
shared span of ``window`` words shares a fingerprint.  Fingerprints are joined, and every hit is extended to
the windows around it, which are compared as 128-bit word-sequence hashes.  Items shorter than the window are
one window of their own length and are looked up at every position.

A benchmark whose windows number at most ``broadcast_windows`` (counted first) is sent to the tasks and nothing
of the documents is shuffled; a larger one is joined by shuffles on fingerprints and window hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .repeats import _long
from .work import stored

HITS = "doc_id long, n_words long, n_hit long, items array<string>"
_WINDOWS = "m long, h1 long, h2 long, item string"
_PLACES = "doc_id long, start long, m long, h1 long, h2 long"
GRAM = 5


class _Text:
    """Word-sequence hashes of one chunk of texts, A-Z lower-cased."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, self.ranges = K.words(data, offsets, K.NOT_ALNUM)
        hashes = K.Spans(K.FOLDED[data]).hash(starts, ends)
        self.one, self.two = K.Spans(hashes), K.Spans(K.mix(hashes ^ np.uint64(0x8EBC6AF09C88C6E3)), 1)

    def windows(self, starts: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        return self.one.hash(starts, starts + m), self.two.hash(starts, starts + m)

    def every(self, m: int, doc_ok: np.ndarray | None = None) -> np.ndarray:
        """Starts of all windows of m words inside one document."""
        size = np.diff(self.ranges)
        count = np.maximum(0, size - m + 1)
        if doc_ok is not None:
            count = np.where(doc_ok, count, 0)
        return np.repeat(self.ranges[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())

    def fingerprints(self, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        grams = self.one.grams(k)
        pos, doc = K.winnow(grams, self.ranges, k, window - k + 1)
        return pos, doc, grams[pos]

    def around(self, pos: np.ndarray, doc: np.ndarray, window: int, k: int) -> np.ndarray:
        """Starts of all windows that hold one of the hits."""
        reach = window - k
        starts = pos[:, None] - np.arange(reach + 1)[None, :]
        ok = (starts >= self.ranges[doc][:, None]) & (starts + window <= self.ranges[doc + 1][:, None])
        return np.unique(starts[ok])


def _item_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, _, data, offsets in K.chunks(batch.column(1)):
                text = _Text(data, offsets)
                size = np.diff(text.ranges)
                for m in sorted({min(int(s), window) for s in size if s}):
                    starts = text.every(m, size >= window if m == window else size == m)
                    doc = np.searchsorted(text.ranges, starts, side="right") - 1
                    h1, h2 = text.windows(starts, m)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), m)), _long(h1), _long(h2), ids.take(pa.array(a + doc))], ["m", "h1", "h2", "item"])

    return run


def _fingerprints(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in K.chunks(batch.column(1)):
                text = _Text(data, offsets)
                pos, doc, keys = text.fingerprints(window, k)
                yield pa.RecordBatch.from_arrays([_long(ids[a:b][doc]), _long(pos - text.ranges[doc]), _long(keys)], ["doc_id", "pos", "key"])

    return run


def _find(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of each value in a sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


class Benchmark:
    """Sorted windows by length, with the items that hold each, and the fingerprints of the long items."""

    def __init__(self, rows: pa.Table, keys: np.ndarray, window: int, k: int):
        self.window, self.k, self.keys = window, k, np.unique(keys.astype(np.int64).view(np.uint64))
        m = rows["m"].to_numpy()
        self.lengths: dict[int, tuple] = {}
        items = np.asarray(rows["item"].to_pylist(), object)
        for length in np.unique(m).tolist():
            at = np.flatnonzero(m == length)
            h1, h2 = rows["h1"].to_numpy()[at].view(np.uint64), rows["h2"].to_numpy()[at].view(np.uint64)
            order = np.lexsort((h2, h1))
            h1, h2, who = h1[order], h2[order], items[at][order]
            new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            first = np.flatnonzero(new)
            self.lengths[length] = (h1[first], h2[first], np.r_[first, len(h1)], who)

    def hits(self, text: _Text) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, starts, window numbers) of all occurrences."""
        for m, (h1, h2, _, _) in self.lengths.items():
            if m == self.window:
                pos, doc, keys = text.fingerprints(self.window, self.k)
                ok = _find(self.keys, keys) >= 0
                starts = text.around(pos[ok], doc[ok], self.window, self.k)
            else:
                starts = text.every(m)
            if not len(starts):
                continue
            one, two = text.windows(starts, m)
            at = _find(h1, one)
            ok = at >= 0
            starts, at, two = starts[ok], at[ok], two[ok]
            ok = h2[at] == two
            yield m, starts[ok], at[ok]

    def items(self, m: int, number: int) -> list[str]:
        bounds, who = self.lengths[m][2:]
        return who[bounds[number] : bounds[number + 1]].tolist()


def _count_hits(ranges: np.ndarray, spans: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    n = int(ranges[-1])
    cover = np.zeros(n + 1, np.int64)
    for starts, ends in spans:
        np.add.at(cover, starts, 1)
        np.add.at(cover, ends, -1)
    hit = np.r_[0, np.cumsum(np.cumsum(cover[:-1]) > 0)]
    return hit[ranges[1:]] - hit[ranges[:-1]]


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Benchmark = shared.value
        for batch in batches:
            for a, b, data, offsets in K.chunks(batch.column(1)):
                text = _Text(data, offsets)
                found: dict[int, set[str]] = {}
                spans = []
                for m, starts, numbers in known.hits(text):
                    spans.append((starts, starts + m))
                    doc = np.searchsorted(text.ranges, starts, side="right") - 1
                    for d, number in np.unique(np.c_[doc, numbers], axis=0).tolist():
                        found.setdefault(d, set()).update(known.items(m, number))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], _long(np.diff(text.ranges)), _long(_count_hits(text.ranges, spans)), pa.array([sorted(found.get(d, ())) for d in range(b - a)], pa.list_(pa.string()))],
                    ["doc_id", "n_words", "n_hit", "items"],
                )

    return run


def _near(window: int, k: int):
    """(doc_id, text, positions of fingerprint hits) -> the windows around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in K.chunks(batch.column(1)):
                text = _Text(data, offsets)
                places = [np.asarray(x.as_py(), np.int64) for x in batch.column(2)[a:b]]
                doc = np.repeat(np.arange(b - a), [len(p) for p in places])
                starts = text.around(np.concatenate(places) + text.ranges[doc], doc, window, k)
                yield _placed(text, ids[a:b], starts, window)

    return run


def _all_windows(lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in K.chunks(batch.column(1)):
                text = _Text(data, offsets)
                for m in lengths:
                    yield _placed(text, ids[a:b], text.every(m), m)

    return run


def _placed(text: _Text, ids: np.ndarray, starts: np.ndarray, m: int) -> pa.RecordBatch:
    doc = np.searchsorted(text.ranges, starts, side="right") - 1
    h1, h2 = text.windows(starts, m)
    return pa.RecordBatch.from_arrays([_long(ids[doc]), _long(starts - text.ranges[doc]), pa.array(np.full(len(starts), m)), _long(h1), _long(h2)], ["doc_id", "start", "m", "h1", "h2"])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in K.chunks(batch.column(1)):
            ranges = K.words(data, offsets, K.NOT_ALNUM)[2]
            spans = []
            for i, x in enumerate(batch.column(2)[a:b]):
                for s in x.as_py() or ():
                    spans.append((ranges[i] + s["start"], ranges[i] + s["start"] + s["m"]))
            both = np.array(spans, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], _long(np.diff(ranges)), _long(_count_hits(ranges, [(both[:, 0], both[:, 1])])), batch.column(3)[a:b]], ["doc_id", "n_words", "n_hit", "items"])


def _by_shuffles(docs: DataFrame, windows: DataFrame, keys: DataFrame, lengths: list[int], window: int, k: int) -> DataFrame:
    # a row's key, so that null and repeated ids keep their own hits; rows with one id and text share one
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    plain = docs.where("text is not null").select(F.col("row").alias("doc_id"), "text")
    seen = windows.select("m", "h1", "h2").distinct()
    hits = plain.mapInArrow(_fingerprints(window, k), "doc_id long, pos long, key long").join(keys, "key", "left_semi")
    near = plain.join(hits.groupBy("doc_id").agg(F.collect_list("pos").alias("pos")), "doc_id").select("doc_id", "text", "pos").mapInArrow(_near(window, k), _PLACES)
    short = [m for m in lengths if m < window]
    if short:
        near = near.unionByName(plain.mapInArrow(_all_windows(short), _PLACES))
    matched = stored(near.join(stored(seen, "windows"), ["m", "h1", "h2"], "left_semi"), "matched")
    spans = matched.groupBy("doc_id").agg(F.collect_set(F.struct("start", "m")).alias("spans"))
    items = matched.select("doc_id", "m", "h1", "h2").distinct().join(windows, ["m", "h1", "h2"]).select("doc_id", "item").distinct()
    items = items.groupBy("doc_id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = docs.join(spans.withColumnRenamed("doc_id", "row"), "row", "left").join(items.withColumnRenamed("doc_id", "row"), "row", "left")
    return out.select("doc_id", "text", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items")).mapInArrow(_tally, HITS)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = 13, k: int = GRAM, broadcast_windows: int = 1_000_000) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside an occurrence of an item's window), items (sorted ids).

    Words are runs of ASCII letters (lower-cased), digits and characters beyond ASCII.  Items of fewer words than
    the window are one window; items without words or id are ignored; repeated items count once.  A null or empty
    text has no words; every input row gives one row with its own hits, also under a null or repeated doc_id; other
    columns are ignored.
    """
    k = min(k, window)
    docs = docs.select("doc_id", "text")
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    windows = stored(items.mapInArrow(_item_windows(window), _WINDOWS).distinct(), "item-windows")
    long_items = items.select(F.lit(0).cast("long").alias("doc_id"), "text")
    keys = stored(long_items.mapInArrow(_fingerprints(window, k), "doc_id long, pos long, key long").select("key").distinct(), "item-keys")
    if windows.count() > broadcast_windows:
        lengths = sorted(r.m for r in windows.select("m").distinct().collect())
        return _by_shuffles(docs, windows, keys, lengths, window, k)
    known = Benchmark(windows.toArrow(), keys.toArrow()["key"].to_numpy(), window, k)
    return docs.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(known)), HITS)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, broadcast_windows: int = 1_000_000) -> DataFrame:
    """``benchmark_hits`` with n_items and contaminated: some word is hit, and at least one in ``share``."""
    hits = benchmark_hits(docs, benchmark, window, broadcast_windows=broadcast_windows)
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with all columns, less the rows that are contaminated; told by a 64-bit hash of id and text, so that rows
    under one id are judged each by its own text."""
    keyed = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    hits = decontaminate(keyed.select(F.col("__row").alias("doc_id"), "text"), benchmark)
    gone = hits.where("contaminated").select(F.col("doc_id").alias("__row")).distinct()
    return keyed.join(gone, "__row", "left_anti").select(*docs.columns)
