"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

score = w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2], so a document costs time linear in its
features.  Words hash into ``buckets``; structure statistics (case, digits, punctuation, symbols, line and word
repetition) and metadata read off the text (length, links, addresses) fall into quantile-free fixed steps, each
step a feature of its own.  Labels, lang, source and doc_id are never features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .repeats import _long
from .work import stored

SCORES = "doc_id long, score double"
FEATURES = "label int, which array<int>, value array<float>"
STEPS = 24
#: Names of the structure statistics, in the order of their feature blocks.
STATISTICS = ("bytes", "words", "word_length", "upper", "digit", "punctuation", "symbol", "emphasis", "pipe", "beyond_ascii", "line_length", "distinct_words", "top_word", "distinct_lines", "links", "addresses", "sentence_length")


def _kinds() -> np.ndarray:
    """One bit for each character class of a byte."""
    kind = np.zeros(256, np.uint16)
    kind[0x41:0x5B] |= 1
    kind[0x30:0x3A] |= 2
    for c in b".,;:'\"()?-":
        kind[c] |= 4
    for c in b"#$%&*+/<=>@[\\]^_`{|}~":
        kind[c] |= 8
    kind[ord("!")] |= 16
    kind[ord("|")] |= 32
    kind[0x80:] |= 64
    kind[ord("\n")] |= 128
    for c in b".!?":
        kind[c] |= 256
    return kind


KINDS = _kinds()


@dataclass
class Model:
    """Weights of buckets first, then of the steps of each statistic."""

    buckets: int
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def features(texts: pa.Array, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, feature numbers, values, bounds) of a run of texts."""
    for a, b, data, offsets in K.chunks(texts):
        docs = b - a
        starts, ends, ranges = K.words(data, offsets, K.NOT_ALNUM)
        doc = np.repeat(np.arange(docs), np.diff(ranges))
        hashes = K.Spans(K.FOLDED[data]).hash(starts, ends)
        cell, count = np.unique(doc * buckets + (hashes % np.uint64(buckets)).astype(np.int64), return_counts=True)
        word_doc, word = cell // buckets, cell % buckets
        value = np.log1p(count)
        norm = np.sqrt(np.bincount(word_doc, value**2, minlength=docs))
        value = value / norm[word_doc]

        size, words = np.diff(offsets).astype(float), np.diff(ranges).astype(float)
        prefix = lambda hit: np.r_[0, np.cumsum(hit)]
        within = lambda hit: (p := prefix(hit))[offsets[1:]] - p[offsets[:-1]]
        kinds = KINDS[data]
        upper, digit, punct, symbol, emphasis, pipe, beyond, lines, ends_of = (within(kinds & (1 << i) > 0) for i in range(9))
        line_start, line_end, line_ranges = K.words(data, offsets, np.arange(256) == 10)
        line_hash = K.Spans(K.TABLES[0][data]).hash(line_start, line_end)
        line_doc = np.repeat(np.arange(docs), np.diff(line_ranges))
        new = np.unique(np.c_[line_doc.astype(np.uint64), line_hash], axis=0)[:, 0].astype(np.int64) if len(line_hash) else np.empty(0, np.int64)
        at_sign = within(data == ord("@"))
        slashes = np.zeros(len(data), bool)
        slashes[:-2] = (data[:-2] == ord(":")) & (data[1:-1] == ord("/")) & (data[2:] == ord("/"))
        top = np.zeros(docs)
        np.maximum.at(top, word_doc, count)
        rate = lambda x, y: np.log2(1 + 255 * x / np.maximum(1, y)) * (STEPS - 1) / 8
        scale = lambda x: np.log2(1 + x)
        steps = [
            scale(size), scale(words), scale(size / np.maximum(1, words)) * 3, rate(upper, size), rate(digit, size), rate(punct, size), rate(symbol, size), rate(emphasis, words), rate(pipe, words),
            rate(beyond, size), scale(size / (lines + 1)) * 1.5, rate(np.bincount(word_doc, minlength=docs), words), rate(top, words), rate(np.bincount(new, minlength=docs), np.diff(line_ranges)),
            scale(within(slashes)) * 2, scale(at_sign) * 2, scale(words / (ends_of + 1)) * 2,
        ]
        steps = np.clip(np.stack(steps, axis=1).astype(np.int64), 0, STEPS - 1)
        extra = buckets + np.arange(len(STATISTICS)) * STEPS + steps
        which = np.concatenate([word, extra.ravel()])
        values = np.concatenate([value, np.full(extra.size, 1 / np.sqrt(len(STATISTICS)))])
        owner = np.concatenate([word_doc, np.repeat(np.arange(docs), len(STATISTICS))])
        order = np.argsort(owner, kind="stable")
        yield a, b, which[order].astype(np.int32), values[order].astype(np.float32), np.searchsorted(owner[order], np.arange(docs + 1))


def logits(model: Model, which: np.ndarray, value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Every document has structure features, so no range is empty."""
    vx = model.factors[which] * value[:, None]
    sums = np.add.reduceat(vx, bounds[:-1], axis=0)
    squares = np.add.reduceat(vx**2, bounds[:-1], axis=0)
    return model.bias + np.add.reduceat(model.linear[which] * value, bounds[:-1]) + 0.5 * (sums**2 - squares).sum(axis=1)


def fit(which: np.ndarray, value: np.ndarray, bounds: np.ndarray, label: np.ndarray, buckets: int, rank: int = 6, rounds: int = 80, rate: float = 0.06, penalty: float = 2e-5, seed: int = 11) -> Model:
    """Logistic loss, both classes given the same weight up to a prior for the larger; Adam over the whole sample."""
    size = buckets + len(STATISTICS) * STEPS
    rng = np.random.default_rng(seed)
    model = Model(buckets, 0.0, np.zeros(size, np.float32), rng.normal(0, 0.05, (size, rank)).astype(np.float32))
    positive = label.mean()
    if len(label) == 0 or positive in (0.0, 1.0):  # nothing to learn from: score the only class seen, or one half
        model.factors[:] = 0
        model.bias = 0.0 if len(label) == 0 else (4.0 if positive else -4.0)
        return model
    model.bias = float(np.log(positive / (1 - positive)))
    order = np.argsort(which, kind="stable").astype(np.int32)
    by_feature = which[order]
    used, first = np.unique(by_feature, return_index=True)
    row, val = np.repeat(np.arange(len(label), dtype=np.int32), np.diff(bounds))[order], value[order]
    moments = [np.zeros((2, len(used)), np.float32), np.zeros((2, len(used), rank), np.float32), np.zeros(2)]
    starts = bounds[:-1]
    for t in range(1, rounds + 1):
        # one factor at a time: nothing larger than a number for each entry is held
        sums = np.empty((len(label), rank), np.float32)
        z = model.bias + np.add.reduceat(model.linear[which] * value, starts)
        for f in range(rank):
            vx = model.factors[which, f] * value
            sums[:, f] = np.add.reduceat(vx, starts)
            vx *= vx
            z += 0.5 * (sums[:, f] ** 2 - np.add.reduceat(vx, starts))
        error = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - label).astype(np.float32) / np.float32(len(label))
        pull = error[row] * val
        linear = np.add.reduceat(pull, first) + penalty * model.linear[used]
        factors = np.empty((len(used), rank), np.float32)
        for f in range(rank):
            rest = sums[row, f]
            rest -= model.factors[by_feature, f] * val
            rest *= pull
            factors[:, f] = np.add.reduceat(rest, first)
        factors += penalty * model.factors[used]
        for i, g in enumerate((linear, factors, error.sum())):
            m = moments[i]
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            step = rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-9)
            if i == 0:
                model.linear[used] -= step
            elif i == 1:
                model.factors[used] -= step
            else:
                model.bias -= float(step)
    return model


def _featurise(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, which, value, bounds in features(batch.column(1), buckets):
                at = pa.array(bounds, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.ListArray.from_arrays(at, pa.array(which)), pa.ListArray.from_arrays(at, pa.array(value))], ["label", "which", "value"])

    return run


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for a, b, which, value, bounds in features(batch.column(1), model.buckets):
                z = logits(model, which, value, bounds).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    return run


def held_out(doc_id: str = "doc_id"):
    """Rows kept from training: crc32 of the id as text is a multiple of five."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000, buckets: int = 1 << 16) -> Model:
    """Fit on at most about ``sample_rows`` labelled documents, drawn by a hash of the id; none of them held out.

    A document with several labels takes their rounded mean; null labels and ids are ignored.
    """
    label = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("label"))
    label = stored(label, "labels")
    share = min(1.0, sample_rows / max(1, label.count()))
    drawn = label.where(F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else label
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn) if share < 1 or sample_rows <= 100_000 else drawn, "doc_id").select("label", "text").mapInArrow(_featurise(buckets), FEATURES).toArrow()
    which = rows["which"].combine_chunks() if len(rows) else None
    if which is None:
        return fit(np.empty(0, np.int32), np.empty(0, np.float32), np.zeros(1, np.int64), np.empty(0), buckets)
    bounds = np.r_[0, np.cumsum(np.diff(np.asarray(which.offsets)))]
    return fit(which.flatten().to_numpy(), rows["value"].combine_chunks().flatten().to_numpy(), bounds, rows["label"].to_numpy().astype(np.float32), buckets)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_rows: int = 8000, buckets: int = 1 << 16) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 from ``threshold``); one row per input row.

    A null text counts as empty and is scored on its statistics; a null doc_id is scored and not held out; labels
    of unknown documents are ignored; without labels every score is one half; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample_rows, buckets))
    scored = docs.select("doc_id", "text").mapInArrow(_score(shared), SCORES)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _keep(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            kept = np.zeros(batch.num_rows, bool)
            for a, b, which, value, bounds in features(batch.column(batch.schema.get_field_index("text")), model.buckets):
                z = logits(model, which, value, bounds).astype(np.float64)
                kept[a:b] = 1 / (1 + np.exp(-np.clip(z, -30, 30))) >= threshold
            yield batch.filter(pa.array(kept))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_rows: int = 8000, buckets: int = 1 << 16) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``quality_scores`` predicts to be good; no shuffle of texts."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample_rows, buckets))
    return docs.mapInArrow(_keep(shared, threshold), docs.schema)
