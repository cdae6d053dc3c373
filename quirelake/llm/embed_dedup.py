"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, one representative a group.

Centres are fitted on a bounded sample.  A vector belongs to its closest cell, and visits each cell of smaller
number whose bounding plane it lies close to: two unit vectors at cosine ``t`` are at most ``d = sqrt(2 - 2t)``
apart, so if they belong to cells a and b, either lies within ``d`` of the plane between a and b.  That margin is
the default and finds every link.  Cells are dealt out by label, and large ones as pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .repeats import _long, join_hot
from .work import scratch, stored

ASSIGNED = "node long, copies long, label string, cell int, home boolean, unit binary"
LINKS = "node long, links long, leader long"


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors in double precision) of the vectors that can be compared; all of one length."""
    rows, out = [], []
    for i, x in enumerate(column):
        v = x.values
        if v is None or not len(v) or v.null_count:
            continue
        v = v.to_numpy(zero_copy_only=False).astype(np.float64)
        if np.isfinite(v).all() and (most := np.abs(v).max()) > 0:
            v = v / most
            rows.append(i)
            out.append(v / np.sqrt(v @ v))
    return np.array(rows, np.int64), out


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centres; empty cells keep their last centre."""
    rng = np.random.default_rng(seed)
    centres = vectors[rng.choice(len(vectors), min(k, len(vectors)), replace=False)].copy()
    for _ in range(rounds):
        cell = np.concatenate([np.argmax(vectors[a : a + 4096] @ centres.T, axis=1) for a in range(0, len(vectors), 4096)])
        order = np.argsort(cell, kind="stable")
        present, first = np.unique(cell[order], return_index=True)
        sums = np.add.reduceat(vectors[order], first, axis=0)
        norms = np.linalg.norm(sums, axis=1)
        centres[present[norms > 0]] = sums[norms > 0] / norms[norms > 0, None]
    return centres


def _assign(shared, threshold: float, margin: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_centres: dict[int, np.ndarray] = shared.value
        all_gaps: dict[int, np.ndarray] = {}
        for batch in batches:
            rows, units = _unit(batch.column(3))
            lengths = np.array([len(u) for u in units])
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                x = np.stack([units[i] for i in at])
                centres = all_centres.get(dim, np.eye(1, dim))
                if dim not in all_gaps:  # from differences: products cancel where centres nearly coincide
                    all_gaps[dim] = np.stack([np.linalg.norm(centres - c, axis=1) for c in centres])
                gaps = all_gaps[dim]
                near = x @ centres.T
                home = np.argmax(near, axis=1)
                reach = math.sqrt(2 - 2 * threshold) * (1.0 if margin is None else min(1.0, margin / math.sqrt(dim)))
                visit = near[np.arange(len(x)), home][:, None] - near <= reach * gaps[home] + 1e-12
                visit &= np.arange(len(centres))[None, :] < home[:, None]
                r, c = np.nonzero(visit)
                r, c = np.r_[np.arange(len(x)), r], np.r_[home, c]
                where = pa.array(rows[at][r])
                blobs = pa.array([v.tobytes() for v in x], pa.binary()).take(pa.array(r))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(where) for i in range(3)), pa.array(c.astype(np.int32)), pa.array(np.arange(len(r)) < len(x)), blobs], ["node", "copies", "label", "cell", "home", "unit"])

    return run


def linked(x: np.ndarray, side: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the unit vectors are linked, as a symmetric matrix.

    Sides: 0 with itself and with all others; 1 only with 0; 3 and 4 only with each other.
    """
    near = np.zeros((len(x), len(x)), bool)
    for a in range(0, len(x), 512):
        s, t = side[a : a + 512, None], side[None, a:]
        ok = np.where((s >= 3) | (t >= 3), s != t, (s == 0) | (t == 0))
        near[a : a + 512, a:] = np.triu((x[a : a + 512] @ x[a:].T >= threshold) & ok, 1)
    return near | near.T


def leaders(near: np.ndarray) -> np.ndarray:
    """The first member of each row's connected component; every row of the matrix is read once."""
    lead = np.full(len(near), -1)
    for i in range(len(near)):
        front = np.array([i]) if lead[i] < 0 else ()
        while len(front):
            lead[front] = i
            front = np.flatnonzero(np.logical_or.reduce(near[front]) & (lead < 0))
    return lead


def _link(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.column(0):
                rows = group.as_py()
                nodes, side, copies = (np.array([x[k] for x in rows], np.int64) for k in ("node", "side", "copies"))
                links, lead = np.zeros(len(rows), np.int64), nodes.copy()
                dims = np.array([len(x["unit"]) for x in rows])
                for dim in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == dim)
                    near = linked(np.frombuffer(b"".join(rows[i]["unit"] for i in at), np.float64).reshape(len(at), -1), side[at], threshold)
                    for a in range(0, len(at), 512):
                        links[at[a : a + 512]] = near[a : a + 512].astype(np.float64) @ copies[at]
                    lead[at] = nodes[at[leaders(near)]]
                yield pa.RecordBatch.from_arrays([_long(nodes), _long(links), _long(lead)], ["node", "links", "leader"])

    return run


def _dealt(assigned: DataFrame, block: int) -> DataFrame:
    """(label, cell, task, side, node, copies, unit); members of a cell meet each other and its visitors, visitors don't meet."""
    sizes = assigned.groupBy("label", "cell").agg(F.count_if("home").alias("own"), F.count_if(~F.col("home")).alias("guests"))
    sizes = stored(sizes.where("own > 0 and own + guests > 1"), "cells")
    rows = assigned.join(sizes, ["label", "cell"])
    whole = F.col("own") + F.col("guests") <= block
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / (block // 2))).cast("int")
    salt = lambda c: F.pmod(F.xxhash64("node"), blocks(c)).cast("int")
    kind = "array<struct<task:string,side:int>>"
    s = salt("own")
    with_own = F.transform(
        F.sequence(F.lit(0), blocks("own") - 1),
        lambda t: F.struct(F.concat_ws(":", F.lit("o"), F.least(s, t), F.greatest(s, t)).alias("task"), F.when(s == t, 0).when(s < t, 3).otherwise(4).alias("side")),
    )
    with_guests = F.when(F.col("guests") == 0, F.array().cast(kind)).otherwise(
        F.transform(F.sequence(F.lit(0), blocks("guests") - 1), lambda t: F.struct(F.concat_ws(":", F.lit("g"), s, t).alias("task"), F.lit(3).alias("side")))
    )
    as_guest = F.transform(F.sequence(F.lit(0), blocks("own") - 1), lambda t: F.struct(F.concat_ws(":", F.lit("g"), t, salt("guests")).alias("task"), F.lit(4).alias("side")))
    one = F.array(F.struct(F.lit("all").alias("task"), F.when(F.col("home"), 0).otherwise(1).alias("side")))
    tasks = F.when(whole, one.cast(kind)).when(F.col("home"), F.concat(with_own, with_guests).cast(kind)).otherwise(as_guest.cast(kind))
    return rows.select("label", "cell", "node", "copies", "unit", F.explode(tasks).alias("t")).select("label", "cell", "t.task", "t.side", "node", "copies", "unit")


def embedding_dedup(vectors: DataFrame, threshold: float = 0.93, cell_rows: int = 2000, max_cells: int = 1024, sample_rows: int = 20_000, margin: float | None = None, block: int = 4096) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Only vectors of equal, non-null labels and equal length are compared; vectors that are null, empty, zero or
    hold null or non-finite components link with nothing.  n_links: other rows at cosine ``threshold`` or more, all of
    them with ``margin=None``; a number narrows the margin to ``margin / sqrt(dim)`` of the exact one and loses links;
    component_id: smallest vec_id reachable by links; kept: it is its own.  Centres come from at most ``sample_rows``
    vectors, one for every ``cell_rows`` of the largest label.  Equal vectors of a label, told by 128 bits of hashes, are
    compared once.  A null vec_id is its own group with a null component_id; other columns are ignored; rows that share a
    vec_id are vectors of their own; an empty table gives no rows.
    """
    with scratch(vectors.sparkSession):
        return stored(_embedding_dedup(vectors, threshold, cell_rows, max_cells, sample_rows, margin, block), "vector-groups", outer=True)


def _embedding_dedup(vectors: DataFrame, threshold: float, cell_rows: int, max_cells: int, sample_rows: int, margin: float | None, block: int) -> DataFrame:
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding")
    usable = rows.where("vec_id is not null and label is not null and embedding is not null")
    keys = usable.select("vec_id", "label", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding", F.lit(2)).alias("h2"), "embedding")
    same = ["label", "h1", "h2"]
    groups = keys.groupBy(*same).agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id())
    groups = stored(groups, "equal-vectors")
    distinct = keys.join(groups, [*same]).where("vec_id = first").dropDuplicates(["node"]).select("node", "copies", "label", "embedding")
    distinct = stored(distinct, "distinct-vectors")
    total, largest = distinct.groupBy("label").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.max("count")).head()
    centres: dict[int, np.ndarray] = {}
    if total:
        share = min(1.0, 1.2 * sample_rows / total)
        # chosen by a hash, so that a repeated run chooses alike
        drawn = distinct.where((F.pmod(F.xxhash64("embedding"), F.lit(1_000_000)) < int(share * 1_000_000)) | F.lit(share >= 1)).limit(sample_rows).select("embedding").toArrow()
        _, units = _unit(drawn["embedding"].combine_chunks())
        for dim in {len(u) for u in units}:
            own = np.stack([u for u in units if len(u) == dim])
            centres[dim] = spherical_kmeans(own, max(1, min(max_cells, largest // cell_rows, len(own))))
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    assigned = stored(distinct.mapInArrow(_assign(shared, threshold, margin), ASSIGNED), "assigned")
    tasks = _dealt(assigned, block).groupBy("label", "cell", "task").agg(F.collect_list(F.struct("node", "copies", "side", "unit")).alias("g"))
    links = stored(tasks.select("g").mapInArrow(_link(threshold), LINKS), "vector-links")
    roots = components(links.select(F.col("node").alias("a"), F.col("leader").alias("b")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = assigned.where("home").select("node").join(counts, "node", "left").join(roots, "node", "left").select("node", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    known = stored(groups.join(known, "node"), "known")  # vectors that can be compared
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    known = stored(known.join(least, "root").select(*same, "copies", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links")), "answers")
    found = join_hot(keys.select("vec_id", *same), known, same, "copies").select("vec_id", "n_links", "component_id")
    comparable = known.select(*same)
    alone = rows.select("vec_id", "label", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding", F.lit(2)).alias("h2"), (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).alias("usable"))
    alone = alone.where("not usable").unionByName(alone.where("usable").join(comparable, same, "left_anti").select(alone.columns)).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
