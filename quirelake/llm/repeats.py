"""Exact search for spans of ``length`` units that occur more than once, in work linear in the text.

Units are bytes or words.  Winnowing keeps, of every ``length - k + 1`` consecutive k-grams, the one with
the smallest hash, so each span of ``length`` units holds a kept *anchor* at an offset that only its content
decides: two equal spans always share an anchor at the same offset.  Hence

1. anchors whose key occurs once are dropped (counts are combined before the shuffle);
2. anchors with equal *contexts* (all units any span around the anchor can reach) collapse to one
   representative with a count, so a passage copied a million times is one row from there on;
3. the contexts of keys that still have several are fetched and handed to a solver, at most ``limit`` a group;
4. a key with more contexts is halved again and again: the spans that hold the anchor far from their start,
   and the others.  Each half is keyed by the units all its spans share, so a very common short line falls
   apart as soon as the key reaches past it, and no group, pair list or row set grows beyond its input.
   At the last level a key is a whole span and nothing is left to compare.

A row is named by ``doc_id`` and ``rid``, a hash of its text: rows that share an id but not a text are documents
of their own, in the order of (doc_id, rid).  Equal contexts are told by 128-bit hashes.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .work import scratch, stored

ANCHORS = "doc_id long, rid long, pos long, key long, c1 long, c2 long, fp long"
CONTEXTS = "key long, d long, lo int, hi int, n long, doc_id long, rid long, pos long, left_part binary, right_part binary"
_CELLS = "key long, c1 long, c2 long, lo int, hi int, n long, doc_id long, rid long, pos long, left_part binary, right_part binary"
PLACE = ("doc_id", "rid", "pos")


@dataclass(frozen=True)
class Spans:
    """What is searched: spans of ``length`` units, anchored on k-grams, at most ``limit`` contexts a group."""

    unit: str
    length: int
    k: int
    limit: int = 256

    @property
    def reach(self) -> int:
        """Units that a span can hold before its anchor."""
        return self.length - self.k


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _second(hashes: np.ndarray) -> np.ndarray:
    return K.mix(hashes ^ np.uint64(0xA0761D6478BD642F))


def _parts(mode: Spans, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """(first row, unit hashes, bounds of the documents, shift, low, high): positions from low to high are the part's own.

    A document of more bytes than a chunk comes in parts that overlap by a span on either side, so an anchor is
    chosen, and its context seen, as in the whole.
    """
    for a, b, data, offsets in K.chunks(texts):
        if mode.unit == "words":
            starts, ends, ranges = K.words(data, offsets, K.SPACE)
            yield a, K.word_hashes(data, starts, ends, K.TABLES[0]), ranges, 0, 0, len(starts)
        elif b - a == 1 and len(data) > K.CHUNK_BYTES:
            for at in range(0, len(data), K.CHUNK_BYTES):
                low, high = max(0, at - mode.length), min(len(data), at + K.CHUNK_BYTES + mode.length)
                yield a, data[low:high], np.array([0, high - low]), low, at - low, min(len(data), at + K.CHUNK_BYTES) - low
        else:
            yield a, data, offsets, 0, 0, len(data)


def anchors(mode: Spans) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, rid, text) -> its anchors.

    ``fp``, summed over all places of a context, tells whether two contexts occur side by side wherever they occur:
    a step to the right multiplies it by a constant.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            names = K.mix(ids.view(np.uint64) ^ K.mix(rids.view(np.uint64)))
            for a, units, ranges, shift, least, most in _parts(mode, batch.column(2)):
                one = units if mode.unit == "words" else K.TABLES[0][units]
                first = K.Spans(one)
                grams = first.grams(mode.k)
                pos, doc = K.winnow(grams, ranges, mode.k, mode.reach + 1)
                if least or most < len(units):
                    own = (pos >= least) & (pos < most)
                    pos, doc = pos[own], doc[own]
                if not len(pos):
                    continue
                second = K.Spans(_second(units) if mode.unit == "words" else K.TABLES[1][units], 1)
                low, high = ranges[doc], ranges[doc + 1]
                start, end = np.maximum(low, pos - mode.reach), np.minimum(high, pos + mode.length)
                # where the anchor lies in its context belongs to the context
                c1 = first.hash(start, end) + K.mix((pos - start).astype(np.uint64) + np.uint64(7))
                at = pos - low + shift
                fp = names[a + doc] * K.powers(int(at.max()))[0][at]
                yield pa.RecordBatch.from_arrays([_long(ids[a + doc]), _long(rids[a + doc]), _long(at), _long(grams[pos]), _long(c1), _long(second.hash(start, end)), _long(fp)], [x.split()[0] for x in ANCHORS.split(", ")])

    return run


def moved(fp: int, steps: int) -> int:
    """The sum of ``fp`` over places that all lie ``steps`` units to the right."""
    return fp * pow(K.BASES[0], steps, 1 << 64) & (1 << 64) - 1


def cut_words(text: str | None) -> tuple[bytes, np.ndarray]:
    """(the words joined by one space; where each begins, and one past the end)."""
    joined = b" ".join((text or "").encode().split())
    return joined, np.r_[0, np.flatnonzero(np.frombuffer(joined, np.uint8) == 32) + 1, len(joined) + 1] if joined else np.zeros(1, np.int64)


def listed(lists: pa.ListArray) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each row's structs; their fields are numbers."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten()
    columns = {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
    for begin, end in zip([0, *ends], ends):
        yield {k: v[begin:end] for k, v in columns.items()}


def contexts(mode: Spans) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, rid, text, reps) -> one row for each representative, with the units left and right of its anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()  # a row that stands in the table twice is asked once
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc, rid, text, reps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), listed(batch.column(3))):
                if (doc, rid) in done:
                    continue
                done.add((doc, rid))
                pos = reps["pos"]
                if mode.unit == "words":
                    data, bounds = cut_words(text.as_py())
                    most = len(bounds) - 1
                    left = (bounds[np.maximum(0, pos - mode.reach)], np.maximum(0, bounds[pos] - 1))
                    right = (bounds[pos], bounds[np.minimum(most, pos + mode.length)] - 1)
                else:
                    data = (text.as_py() or "").encode()
                    left, right = (np.maximum(0, pos - mode.reach), pos), (pos, pos + mode.length)
                for key, d, n, p, a, b, c, e in zip(*(x.tolist() for x in (reps["key"], reps["d"], reps["n"], pos, *left, *right))):
                    rows.append((key, d, 0, mode.reach, n, doc, rid, p, data[a:b], data[c:e]))
                    size += b - a + e - c
                    if size > 4 << 20:
                        yield _rows(rows, CONTEXTS)
                        rows, size = [], 0
            if rows:
                yield _rows(rows, CONTEXTS)

    return run


_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def _rows(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [x.strip().split() for x in ddl.split(",")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _halves(mode: Spans) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each context of a crowded key, once for either half of the offsets its spans can have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for x in batch.to_pylist():
                left, right, glue = x["left_part"], x["right_part"], b""
                if mode.unit == "words":
                    left, right, glue = left.split(), right.split(), b" "
                middle = (x["lo"] + x["hi"]) // 2
                for lo, hi in ((x["lo"], middle), (middle + 1, x["hi"])):
                    least, most = max(lo, mode.length - len(right)), min(hi, len(left))
                    if least > most:
                        continue  # no whole span of this half fits into the document
                    near, far = left[len(left) - most :], right[: mode.length - least]
                    core = glue.join([*left[len(left) - lo :], *right[: mode.length - hi]]) if glue else left[len(left) - lo :] + right[: mode.length - hi]
                    near, far = (glue.join(near), glue.join(far)) if glue else (near, far)
                    key = xxhash.xxh3_64_intdigest(core, seed=lo * 65536 + hi)
                    whole = xxhash.xxh3_128_digest(near + b"\0" + far, seed=most)
                    key, (c1, c2) = struct.unpack("q", struct.pack("Q", key))[0], struct.unpack("qq", whole)
                    rows.append((key, c1, c2, lo, hi, x["n"], x["doc_id"], x["rid"], x["pos"], near, far))
                    size += len(near) + len(far)
                if size > 4 << 20:
                    yield _rows(rows, _CELLS)
                    rows, size = [], 0
            if rows:
                yield _rows(rows, _CELLS)

    return run


#: Takes (mode, lo, hi, rows of one key) and yields rows; a row of the key is a dict with n, the place, left_part, right_part.
Solver = Callable[[Spans, int, int, list[dict]], Iterator[tuple]]


def solved(rows: DataFrame, mode: Spans, solver: Solver, schema: str) -> DataFrame:
    """What the solver makes of each key's contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            flat = batch.column(2).flatten()
            names = [f.name for f in flat.type]
            rows = [dict(zip(names, x)) for x in zip(*(flat.field(i).to_pylist() for i in range(len(names))))]
            ends = np.cumsum(batch.column(2).value_lengths().to_numpy()).tolist()
            for lo, hi, begin, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), [0, *ends], ends):
                out.extend(solver(mode, lo, hi, rows[begin:end]))
                if len(out) > 20_000:
                    yield _rows(out, schema)
                    out = []
            yield _rows(out, schema)

    groups = rows.groupBy("key", "lo", "hi").agg(F.collect_list(F.struct("n", *PLACE, "left_part", "right_part")).alias("g"))
    return groups.select("lo", "hi", "g").mapInArrow(run, schema)


def named(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, text) of the rows that take part."""
    return docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("rid"), "text")


def at(place: str) -> list[Column]:
    return [F.col(f"{place}.{c}").alias(f"first_{c}") for c in PLACE]


def anchored_contexts(docs: DataFrame, mode: Spans) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(anchors whose key recurs, their contexts with a count and the first place, keys with several contexts); all stored."""
    docs = named(docs)
    with scratch(docs.sparkSession):
        found = stored(docs.mapInArrow(anchors(mode), ANCHORS), "all-anchors")
        keys = stored(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "keys")
        anchored = stored(found.join(keys, "key", "left_semi").select(*[x.split()[0] for x in ANCHORS.split(", ")]), "anchors", outer=True)
    halves = (F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32))  # sums of 32 bits don't overflow
    seen = anchored.groupBy("key", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("first"), F.sum(halves[0]).alias("fp_low"), F.sum(halves[1]).alias("fp_high"))
    seen = stored(seen, "contexts")
    return anchored, seen, stored(seen.groupBy("key").agg(F.count("*").alias("d")).where("d > 1"), "several")


def join_hot(rows: DataFrame, groups: DataFrame, on: list[str], n: str) -> DataFrame:
    """``rows`` with the columns of their group, ``n`` of which are among ``rows``.

    A group with a thousandth of all rows or more is broadcast, so its rows stay where they are: there are at most a
    thousand of them.  The others are too small to burden a task.
    """
    least = max(1000, rows.count() // 1000)
    hot = groups.where(F.col(n) >= least)
    if hot.isEmpty():
        return rows.join(groups, on)
    hot = F.broadcast(hot)
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(groups.where(F.col(n) < least), on))


def refined(rows: DataFrame, mode: Spans) -> Iterator[tuple[DataFrame, DataFrame | None]]:
    """Level by level: the contexts of keys small enough for the solver; the halved contexts that are not alone, with their first place.

    A halved context runs from its furthest to its nearest span, both inside the document.
    """
    alike = None
    while True:
        yield rows.where(F.col("d") <= mode.limit), alike
        crowded = rows.where(F.col("d") > mode.limit)
        if crowded.isEmpty():
            return
        cells = stored(crowded.mapInArrow(_halves(mode), _CELLS), "cells")
        seen = stored(cells.groupBy("key", "c1", "c2").agg(F.sum("n").alias("all_n"), F.count("*").alias("rows"), F.min(F.struct(*PLACE)).alias("first")), "contexts")
        several = stored(seen.groupBy("key").agg(F.count("*").alias("d")).where("d > 1"), "several")
        cells = stored(join_hot(cells, seen.select("key", "c1", "c2", "all_n", "rows", *at("first")), ["key", "c1", "c2"], "rows").drop("rows"), "cells-first")
        alike = cells.where("all_n > 1")
        reps = cells.where("doc_id = first_doc_id and rid = first_rid and pos = first_pos").join(several, "key")
        rows = stored(reps.select("key", "d", "lo", "hi", F.col("all_n").alias("n"), *PLACE, "left_part", "right_part"), "reps")


def units(mode: Spans, part: str) -> Column:
    """How many units a part has; words are joined by one space."""
    size = F.octet_length(part)
    if mode.unit == "bytes":
        return size.cast("long")
    return F.when(size == 0, 0).otherwise(size - F.octet_length(F.replace(F.col(part).cast("string"), F.lit(" "), F.lit(""))) + 1).cast("long")
