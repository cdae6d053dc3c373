"""Near-duplicate documents by MinHash banding over word n-grams, verified on full n-gram sets.

Documents with the same n-gram set collapse to one representative with a count.  Signatures of representatives
are cut into bands; band and row counts follow from the threshold and the target recall.  Representatives that
share a band hash are tied to that band's smallest one (a star, never all pairs), and the stars' components are
clusters that hold every candidate pair.  Each cluster is verified with set intersections counted by matrix
products over distinct membership patterns; clusters beyond a block are dealt out as pairs of blocks whose set
sizes can meet the threshold.  Tasks return a link count for each document and one leader, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .repeats import _long, join_hot
from .work import scratch, stored

SIGNATURES = "doc_id long, rid long, n long, c1 long, c2 long, bands array<long>"
SETS = "node long, n long, copies long, cluster long, task string, side int, grams binary"
LINKS = "node long, links long, leader long"


def band_count(threshold: float, rows: int, recall: float) -> int:
    """Bands needed so that a pair at the threshold shares one with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def gram_sets(texts: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, bounds): the sorted n-gram sets of a run of texts; fewer words than ``size`` are one gram."""
    for a, b, data, offsets in K.chunks(texts):
        starts, ends, ranges = K.words(data, offsets, K.NOT_ALNUM)
        spans = K.Spans(K.Spans(K.FOLDED[data]).hash(starts, ends))
        count = np.diff(ranges)
        grams = np.where(count > 0, np.maximum(1, count - size + 1), 0)
        doc = np.repeat(np.arange(b - a), grams)
        at = np.repeat(ranges[:-1] - (np.cumsum(grams) - grams), grams) + np.arange(grams.sum())
        hashes = spans.hash(at, np.minimum(at + size, ranges[1:][doc]))
        order = np.lexsort((hashes, doc))
        hashes, doc = hashes[order], doc[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        hashes, doc = hashes[new], doc[new]
        yield a, b, hashes, np.searchsorted(doc, np.arange(b - a + 1))


def _signatures(size: int, bands: int, rows: int):
    rng = np.random.default_rng(20240229)
    seeds = rng.integers(0, 2**63, bands * rows, np.uint64)
    factors = rng.integers(0, 2**63, bands * rows, np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for a, b, hashes, bounds in gram_sets(batch.column(2), size):
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                if not len(full):
                    continue
                first = bounds[:-1][full]
                c1, c2 = (np.add.reduceat(K.mix(hashes ^ np.uint64(s)), first) for s in (0x1F83D9AB, 0x5BE0CD19137E2179))
                out = np.zeros((len(full), bands), np.uint64)
                for j in range(bands * rows):
                    least = np.minimum.reduceat((hashes ^ seeds[j]) * factors[j], first)
                    out[:, j // rows] = K.mix(out[:, j // rows] + least + np.uint64(j // rows + 1))
                flat = pa.array(out.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1) * bands, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([_long(ids[a:b][full]), _long(rids[a:b][full]), _long(n[full]), _long(c1), _long(c2), lists], ["doc_id", "rid", "n", "c1", "c2", "bands"])

    return run


def _sets(size: int):
    """(text, members) -> the document's set, once for each task that needs it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SETS.split(", ")]
        for batch in batches:
            for a, b, hashes, bounds in gram_sets(batch.column(0), size):
                rows = []
                for i in range(a, b):
                    grams = hashes[bounds[i - a] : bounds[i - a + 1]].tobytes()
                    for x in batch.column(1)[i].as_py():
                        rows.append((x["node"], x["n"], x["copies"], x["cluster"], x["task"], x["side"], grams))
                types = [pa.int64()] * 4 + [pa.string(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)

    return run


def similar(grams: list[np.ndarray], threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(i, the j > i whose set is at least that similar), counted exactly on whole sets."""
    m = len(grams)
    sizes = np.array([len(g) for g in grams], np.int64)
    tags = K.mix(np.arange(1, m + 1, dtype=np.uint64))
    flat, doc = np.concatenate(grams), np.repeat(np.arange(m), sizes)
    _, which, count = np.unique(flat, return_inverse=True, return_counts=True)
    kept = count[which] > 1  # a gram of one document meets nothing
    which, doc = which[kept], doc[kept]
    common = np.zeros((m, m), np.float64)
    if len(which):
        order = np.argsort(which, kind="stable")
        which, doc = which[order], doc[order]
        first = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
        # grams held by the same documents are one column with a weight
        pattern = np.add.reduceat(tags[doc], first)
        _, sample, weight = np.unique(pattern, return_index=True, return_counts=True)
        bounds = np.r_[first, len(doc)]
        step = max(1, (1 << 22) // m)
        for at in range(0, len(sample), step):
            part = sample[at : at + step]
            matrix = np.zeros((m, len(part)), np.float64)
            lengths = bounds[part + 1] - bounds[part]
            columns = np.repeat(np.arange(len(part)), lengths)
            entries = np.repeat(bounds[part] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            matrix[doc[entries], columns] = 1
            common += (matrix * weight[at : at + step]) @ matrix.T
    for i in range(m - 1):
        inter = common[i, i + 1 :]
        # a set pair is linked if inter / union >= threshold
        yield i, i + 1 + np.flatnonzero(inter >= threshold * (sizes[i] + sizes[i + 1 :] - inter) - 1e-9)


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.column(0):
                rows = list({x["node"]: x for x in group.as_py()}.values())  # a row that stands in the table twice is one
                ids, sides, copies = [x["node"] for x in rows], np.array([x["side"] for x in rows]), np.array([x["copies"] for x in rows], np.int64)
                two = sides[0] != 2  # a pair of blocks: only links across
                links, root = np.zeros(len(rows), np.int64), list(range(len(rows)))

                def find(x: int) -> int:
                    while root[x] != x:
                        root[x] = x = root[root[x]]
                    return x

                for i, near in similar([np.frombuffer(x["grams"], np.uint64) for x in rows], threshold):
                    if two:
                        near = near[sides[near] != sides[i]]
                    links[i] += copies[near].sum()
                    links[near] += copies[i]
                    for j in near.tolist():
                        a, b = find(i), find(j)
                        if a != b:
                            a, b = (a, b) if ids[a] < ids[b] else (b, a)
                            root[b] = a
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _long(links), pa.array([ids[find(i)] for i in range(len(rows))], pa.int64())], ["node", "links", "leader"])

    return run


def _tasks(members: DataFrame, threshold: float, block_docs: int, block_grams: int) -> DataFrame:
    """(node, n, copies, cluster, task, side): which tasks each member of a cluster goes to; side 2 meets its own.

    A cluster within a block is one task.  A larger one is cut by set size into classes a factor of 1/threshold
    apart, so that links only join a class to itself or the next, and each class into blocks.
    """
    size = members.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("n").alias("grams"))
    size = stored(size.select("cluster", ((F.col("docs") <= block_docs) & (F.col("grams") <= block_grams)).alias("small")), "cluster-sizes")
    rows = members.join(size, "cluster")
    small = rows.where("small").select("node", "n", "copies", "cluster", F.lit("all").alias("task"), F.lit(2).alias("side"))
    large = rows.where("not small").withColumn("c", F.floor(F.log("n") / F.lit(-math.log(threshold)) + 1e-9).cast("int"))
    classes = large.groupBy("cluster", "c").agg(F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("n") / block_grams)).cast("int").alias("blocks"))
    classes = stored(classes, "classes")
    up = classes.select("cluster", (F.col("c") - 1).alias("c"), F.col("blocks").alias("above"))
    down = classes.select("cluster", (F.col("c") + 1).alias("c"), F.col("blocks").alias("below"))
    plan = stored(classes.join(up, ["cluster", "c"], "left").join(down, ["cluster", "c"], "left"), "plan")
    large = large.join(plan, ["cluster", "c"]).withColumn("s", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    name = lambda c, s, d, t: F.concat_ws(":", c, s, d, t)
    c, s = F.col("c"), F.col("s")
    own = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda t: F.struct(name(c, F.least(s, t), c, F.greatest(s, t)).alias("task"), F.when(s == t, 2).when(s < t, 0).otherwise(1).alias("side")))
    above = F.when(F.col("above").isNull(), F.array().cast("array<struct<task:string,side:int>>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.coalesce("above", F.lit(1)) - 1), lambda t: F.struct(name(c, s, c + 1, t).alias("task"), F.lit(0).alias("side")))
    )
    below = F.when(F.col("below").isNull(), F.array().cast("array<struct<task:string,side:int>>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.coalesce("below", F.lit(1)) - 1), lambda t: F.struct(name(c - 1, t, c, s).alias("task"), F.lit(1).alias("side")))
    )
    large = large.select("node", "n", "copies", "cluster", F.explode(F.concat(own, above, below)).alias("t")).select("node", "n", "copies", "cluster", "t.task", "t.side")
    return small.unionByName(large)


def ngram_join(docs: DataFrame, size: int = 5, threshold: float = 0.8, rows: int = 5, recall: float = 0.999, block_docs: int = 256, block_grams: int = 400_000) -> DataFrame:
    """One row per input row: doc_id, n_grams, copy_id, class_id, n_links, kept.

    Words are runs of ASCII letters (lower-cased), digits and characters beyond ASCII; a text of fewer than ``size``
    words is one gram, one without words has none and links with nothing.  copy_id is the smallest doc_id with the
    same set; n_links counts the other documents whose set has a Jaccard similarity of ``threshold`` or more (copies
    included); class_id is the smallest doc_id reachable by links; kept says that it is the document's own id.
    Candidate search finds a pair at the threshold with probability ``recall`` or more; what is linked is verified.
    A null text has no words; a row with a null doc_id links with nothing, has a null class_id and is kept; other
    columns are ignored; an empty table gives an empty result.  Rows that share a doc_id are documents of their own and
    link like others; of those with the smallest doc_id of a class the ones with the smallest text hash are kept.
    """
    return classes(docs, size, threshold, rows, recall, block_docs, block_grams).drop("rid")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class, and one of rows with equal doc_id and text; rows with a null id all stay."""
    found = classes(docs, **options).select(F.col("doc_id").alias("__id"), F.col("rid").alias("__rid"), "kept")
    gone = found.where(~F.col("kept")).select("__id", "__rid").distinct()
    often = stored(found.where("__id is not null").groupBy("__id", "__rid").count().where("count > 1").select("__id", "__rid"), "repeated-rows")
    rows = docs.withColumns({"__id": F.col("doc_id"), "__rid": F.xxhash64("text")})
    left = rows.join(gone, ["__id", "__rid"], "left_anti")
    if often.isEmpty():
        return left.select(*docs.columns)
    again = left.join(often, ["__id", "__rid"], "left_semi").dropDuplicates(["__id", "__rid"])
    return left.join(often, ["__id", "__rid"], "left_anti").select(*docs.columns).unionByName(again.select(*docs.columns))


def classes(docs: DataFrame, size: int = 5, threshold: float = 0.8, rows: int = 5, recall: float = 0.999, block_docs: int = 256, block_grams: int = 400_000) -> DataFrame:
    """``ngram_join`` with each row's text hash as ``rid``."""
    with scratch(docs.sparkSession):
        return stored(_classes(docs, size, threshold, rows, recall, block_docs, block_grams), "classes", outer=True)


def _classes(docs: DataFrame, size: int, threshold: float, rows: int, recall: float, block_docs: int, block_grams: int) -> DataFrame:
    docs = docs.select("doc_id", F.xxhash64("text").alias("rid"), "text")
    bands = band_count(threshold, rows, recall)
    signed = stored(docs.where("doc_id is not null").mapInArrow(_signatures(size, bands, rows), SIGNATURES), "signatures")
    copies = signed.groupBy("n", "c1", "c2").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "rid", "bands")).alias("x"))
    copies = copies.select("n", "c1", "c2", "copies", F.col("x.doc_id").alias("copy_id"), F.col("x.rid").alias("copy_rid"), F.col("x.bands").alias("bands"), F.monotonically_increasing_id().alias("node"))
    copies = stored(copies, "copies")
    reps = copies.select("node", F.posexplode("bands").alias("band", "hash"))
    shared = stored(reps.groupBy("band", "hash").agg(F.min("node").alias("least"), F.count("*").alias("m")).where("m > 1").select("band", "hash", "least"), "buckets")
    stars = reps.join(shared, ["band", "hash"]).select(F.col("node").alias("a"), F.col("least").alias("b"))
    clusters = components(stars)
    members = stored(copies.join(clusters, "node").select("node", "n", "copies", F.col("root").alias("cluster")), "members")
    wanted = _tasks(members, threshold, block_docs, block_grams).groupBy("node").agg(F.collect_list(F.struct("node", "n", "copies", "cluster", "task", "side")).alias("members"))
    wanted = wanted.join(copies.select("node", F.col("copy_id").alias("doc_id"), F.col("copy_rid").alias("rid")), "node").drop("node")
    sets = docs.join(wanted, ["doc_id", "rid"]).select("text", "members").mapInArrow(_sets(size), SETS)
    groups = sets.groupBy("cluster", "task").agg(F.collect_list(F.struct("node", "copies", "side", "grams")).alias("g"))
    links = stored(groups.select("g").mapInArrow(_verify(threshold), LINKS), "links")
    roots = components(links.select(F.col("node").alias("a"), F.col("leader").alias("b")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    per_copy = stored(copies.drop("bands").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "per-copy")
    least = per_copy.groupBy("root").agg(F.min(F.struct("copy_id", "copy_rid")).alias("least"))
    total = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    per_copy = stored(per_copy.join(least, "root").select("n", "c1", "c2", "copies", "copy_id", total, F.col("least.copy_id").alias("class_id"), F.col("least.copy_rid").alias("class_rid")), "per-class")
    found = join_hot(signed.select("doc_id", "rid", "n", "c1", "c2"), per_copy, ["n", "c1", "c2"], "copies")
    found = found.select("doc_id", "rid", F.col("n").alias("n_grams"), "copy_id", "class_id", "n_links", ((F.col("class_id") == F.col("doc_id")) & (F.col("class_rid") == F.col("rid"))).alias("kept"))
    alone = docs.select("doc_id", "rid").join(signed.select("doc_id", "rid").distinct(), ["doc_id", "rid"], "left_anti")
    alone = alone.select("doc_id", "rid", F.lit(0).cast("long").alias("n_grams"), F.col("doc_id").alias("copy_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    return found.unionByName(alone)
