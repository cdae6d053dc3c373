"""Best-fit packing into bins of several permitted capacities.

Pieces are dealt into shards of bounded size by a hash of their id and packed shard by shard: longest first, each
into the open bin that it leaves fullest.  Where none fits, a bin of the capacity that costs least for what is still
to pack is opened, and when a shard is done every bin is downsized to the smallest capacity that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tokens import encoder
from .work import stored

CAPACITIES = (512, 1024, 2048, 4096)
#: Equal rows travel as one with a count of at most this many.
COPIES = 512
PACKED = "doc_id long, piece long, start long, length long, shard long, bin long, capacity long, position long"


def bin_cost(capacity: int) -> float:
    """Relative cost of a bin: linear work, a fixed overhead, and attention that grows with the square."""
    return capacity + 64 + capacity * capacity / 65536


def opened(length: int, histogram: np.ndarray, capacities: tuple[int, ...], cost: Callable[[int], float]) -> int:
    """Capacity whose cost for each unit it can be expected to hold is least, given what is left to pack.

    ``histogram[n]`` counts the pieces of length n that are left; those that still fit beside ``length`` may fill up
    to what they have in total.
    """
    best, least = capacities[-1], None
    for c in capacities:
        if c < length:
            continue
        room = c - length
        sizes = np.arange(min(room, len(histogram) - 1) + 1)
        fill = min(room, int((histogram[: len(sizes)] * sizes).sum()))
        price = cost(c) / max(1, length + fill)  # empty pieces alone fill nothing
        if least is None or price < least:
            best, least = c, price
    return best


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = bin_cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, position, capacity of the bin) of every piece; no piece is longer than the largest capacity."""
    capacities = tuple(sorted(capacities))
    lengths = np.asarray(lengths, np.int64)
    bins, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    histogram = np.bincount(lengths, minlength=capacities[-1] + 1)
    used: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # sorted distinct rooms of open bins
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        histogram[size] -= 1
        k = bisect_left(rooms, size)
        if k < len(rooms):
            room = rooms[k]
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                del by_room[room], rooms[k]
        else:
            b, room = len(used), opened(size, histogram, capacities, cost)
            used.append(0)
        bins[i], at[i] = b, used[b]
        used[b] += size
        room -= size
        if room:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append(b)
    sizes = np.array(capacities)[np.searchsorted(capacities, np.asarray(used, np.int64))] if used else np.empty(0, np.int64)
    return bins, at, sizes[bins] if len(lengths) else np.empty(0, np.int64)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in K.chunks(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.diff(K.words(data, offsets, K.SPACE)[2]) + 1)], ["doc_id", "length"])


def _token_counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        for batch in batches:
            for a, b, _, sizes in tokens.runs(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(sizes + 1)], ["doc_id", "length"])

    return run


def _pack_shard(capacities: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, group in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = pa.RecordBatch.from_struct_array(group.values) if len(group.values) else None
                if rows is None:
                    continue
                order = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
                order = order.take(pa.array(np.repeat(np.arange(len(order)), order.column("copies").to_numpy())))
                lengths = order.column("length").to_numpy()
                bins, at, sizes = pack(lengths, capacities)
                yield pa.RecordBatch.from_arrays(
                    [order.column("doc_id"), order.column("piece"), order.column("start"), order.column("length"), *(pa.array(x) for x in (np.full(len(bins), shard, np.int64), bins, sizes.astype(np.int64), at))],
                    ["doc_id", "piece", "start", "length", "shard", "bin", "capacity", "position"],
                )

    return run


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, length: Column | None = None, shard_rows: int = 8192, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, shard, bin, capacity, position.

    A document's length is ``length``, or its tokens under the vocabulary file ``tokenizer`` and an end mark, or with
    neither its words (ASCII white space apart) and an end mark.  A document longer
    than the largest capacity is cut into pieces of that size and a rest; one of length zero is a piece of length
    zero.  (shard, bin) names a bin; position is where a piece begins in it.  A null text has the end mark only; a
    null or negative ``length`` is zero; null ids and repeated rows are packed like others, and rows of equal id and
    length are counted before they are dealt, so that any number of them spreads over the shards; other columns are
    ignored; an empty table gives no rows.
    """
    capacities = tuple(sorted(set(capacities)))
    most = capacities[-1]
    if length is None:
        sized = docs.select("doc_id", "text").mapInArrow(_token_counts(tokenizer) if tokenizer else _word_counts, "doc_id long, length long")
    else:
        sized = docs.select("doc_id", F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long").alias("length"))
    counted = sized.groupBy("doc_id", "length").agg(F.count(F.lit(1)).alias("n"))
    blocks = counted.select("doc_id", "length", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})")).alias("block"))
    blocks = blocks.select("doc_id", "length", "block", F.least(F.lit(COPIES), F.col("n") - F.col("block") * COPIES).alias("copies"))
    pieces = blocks.select("*", F.explode(F.expr(f"sequence(0L, greatest(0L, (length - 1) div {most}))")).alias("piece"))
    start = F.col("piece") * most
    pieces = pieces.select("doc_id", "block", "copies", "piece", start.alias("start"), F.least(F.lit(most), F.col("length") - start).alias("length"))
    pieces = stored(pieces, "pieces")
    shards = max(1, (pieces.agg(F.sum("copies")).first()[0] or 0) // shard_rows)
    # all that tells pieces apart takes part, so that many rows of one id still spread
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "length", "block"), F.lit(shards)))
    groups = dealt.groupBy("shard").agg(F.collect_list(F.struct("doc_id", "piece", "start", "length", "copies")).alias("g"))
    return groups.mapInArrow(_pack_shard(capacities), PACKED)
