"""Suffix-array substring deduplication with deep-shallow sorting.

``repeats`` brings together the contexts that share an anchor; here their suffixes (to the right of the anchor,
and mirrored to the left) are put in order: a multikey quicksort down to a shallow depth, then blind tries for
the groups that still agree there.  Adjacent longest common prefixes then tell, for every offset at which they
change, which spans of ``length`` bytes are equal.  Contexts that are equal as a whole are told by 128-bit hashes and
merged before; all that differs is compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import CONTEXTS, PLACE, Spans, anchored_contexts, contexts, join_hot, listed, named, refined, solved, units
from .work import scratch, stored

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"
MARKS = "doc_id long, rid long, start long, end long"
SHALLOW = 24


def common_prefix(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the longest common prefix, known to be ``at`` or more."""
    most = min(len(a), len(b))
    if a[at:most] == b[at:most]:
        return most
    low, high = at, most  # a[:low] agrees, a[:high] does not
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class _Node:
    __slots__ = ("depth", "edges", "leaves")

    def __init__(self, depth: int, leaf: int | None = None):
        self.depth = depth  # where the strings below part; for a leaf, its length
        self.edges: dict[int, _Node] = {}
        self.leaves = [] if leaf is None else [leaf]


def blind_trie(strings: list[bytes], group: list[int], depth: int) -> list[int]:
    """Sort strings that agree up to ``depth``: only branching bytes are kept, one full comparison an insertion."""
    root = _Node(len(strings[group[0]]), group[0])
    for i in group[1:]:
        s = strings[i]
        node = root
        while node.edges:  # descend on branching bytes alone, anywhere where there is none to follow
            c = s[node.depth] if node.depth < len(s) else -1
            node = node.edges.get(c) or next(iter(node.edges.values()))
        known = strings[node.leaves[0]]
        agree = common_prefix(s, known, min(depth, len(s), len(known)))
        parent, node = None, root
        while node.edges and node.depth < agree:
            parent, node = node, node.edges[s[node.depth] if node.depth < len(s) else -1]
        if node.edges and node.depth == agree:
            c = s[agree] if agree < len(s) else -1
            if c in node.edges:  # only where both end here: an equal string
                node.edges[c].leaves.append(i)
            else:
                node.edges[c] = _Node(len(s), i)
        elif not node.edges and agree == len(s) == node.depth:
            node.leaves.append(i)  # an equal string
        else:
            fork = _Node(agree)
            fork.edges[known[agree] if agree < len(known) else -1] = node
            fork.edges[s[agree] if agree < len(s) else -1] = _Node(len(s), i)
            if parent is None:
                root = fork
            else:
                parent.edges[known[parent.depth] if parent.depth < len(known) else -1] = fork
    order: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        order.extend(node.leaves)
        stack.extend(node.edges[c] for c in sorted(node.edges, reverse=True))
    return order


def deep_shallow(strings: list[bytes], agreed: int = 0, shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Order of the strings (a shorter one first), and the common prefix of each with the one before it."""
    order: list[int] = []
    stack = [(list(range(len(strings))), agreed)]
    while stack:
        group, depth = stack.pop()
        if len(group) < 2:
            order.extend(group)
            continue
        if depth >= agreed + shallow:
            order.extend(blind_trie(strings, group, depth))
            continue
        keys = [strings[i][depth] if depth < len(strings[i]) else -1 for i in group]
        pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        less = [i for i, c in zip(group, keys) if c < pivot]
        same = [i for i, c in zip(group, keys) if c == pivot]
        more = [i for i, c in zip(group, keys) if c > pivot]
        stack.append((more, depth))
        if pivot < 0:  # these have ended: they are equal
            stack.extend(([i], depth) for i in reversed(same))
        else:
            stack.append((same, depth + 1))
        stack.append((less, depth))
    shared = [0] + [common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:])]
    return order, shared


def equal_spans(mode: Spans, lo: int, hi: int, rows: list[dict]) -> Iterator[tuple]:
    """Marks of the spans, with ``lo`` to ``hi`` bytes before the anchor, that two of the contexts share."""
    length = mode.length
    left = [x["left_part"][-hi:][::-1] if hi else b"" for x in rows]
    right = [x["right_part"][: length - lo] for x in rows]
    if len(rows) == 2:
        reach, along = common_prefix(*left), common_prefix(*right)
        if reach + along >= length and reach >= lo:
            for x in rows:
                yield x["doc_id"], x["rid"], x["pos"] - reach, x["pos"] + along
        return
    m = len(rows)
    ranks, shared = [], []
    for strings in (left, right):
        agreed = len(strings[0])  # all begin alike: to the right with the anchor, in a halved group on both sides
        for x in strings[1:]:
            agreed = min(agreed, len(x)) if strings[0][:agreed] == x[:agreed] else common_prefix(strings[0][:agreed], x)
        order, common = deep_shallow(strings, agreed)
        ranks.append(np.asarray(order))
        shared.append(np.asarray(common))
    sizes = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    points = {int(v) for v in shared[0][1:] if lo <= v <= hi} | {length - int(v) for v in shared[1][1:] if lo <= length - v <= hi}
    for a in sorted(points):
        part = np.empty((2, m), np.int64)
        for side, need in ((0, a), (1, length - a)):
            part[side, ranks[side]] = np.cumsum(shared[side] < need)
        ok = np.flatnonzero((sizes[0] >= a) & (sizes[1] >= length - a))
        if len(ok) < 2:
            continue
        _, which, count = np.unique(part[0, ok] * (m + 1) + part[1, ok], return_inverse=True, return_counts=True)
        for i in ok[count[which] > 1].tolist():
            yield rows[i]["doc_id"], rows[i]["rid"], rows[i]["pos"] - a, rows[i]["pos"] - a + length


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RESULT.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            digests, texts, removed, spans, sizes = [], [], [], [], []
            for data, marks in zip(part.column(1).fill_null("").cast(pa.binary()).to_pylist(), listed(part.column(2))):
                sizes.append(len(data))
                if not len(marks["start"]):
                    digests.append(hashlib.sha256(data).hexdigest())
                    texts.append(data)
                    removed.append(0)
                    spans.append(0)
                    continue
                order = np.argsort(marks["start"])
                start, end = marks["start"][order], np.maximum.accumulate(np.minimum(marks["end"][order], len(data)))
                new = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
                start, end = start[new].tolist(), end[np.r_[new[1:], len(end)] - 1].tolist()
                kept = [data[a:b] for a, b in zip([0, *end], [*start, len(data)])]
                digests.append(hashlib.sha256(b"".join(kept)).hexdigest())
                texts.append("".join(x.decode("utf-8", "ignore") for x in kept).encode())
                removed.append(sum(end) - sum(start))
                spans.append(len(start))
            numbers = [pa.array(x, pa.int64()) for x in (sizes, removed, spans)]
            yield pa.RecordBatch.from_arrays([part.column(0), *numbers, pa.array(digests), pa.array(texts, pa.binary()).cast(pa.string())], names)


def repeated_bytes(docs: DataFrame, length: int = 400, k: int = 64, limit: int = 256) -> DataFrame:
    """(doc_id, rid, start, end) of byte ranges covered by ``length``-byte strings that start anywhere else too.

    ``rid`` is the row's text hash, ``xxhash64(text)``.
    """
    if length <= 2 * k:
        k = max(1, length // 4)
    mode = Spans("bytes", length, k, limit)
    anchored, seen, several = anchored_contexts(docs, mode)
    copied = join_hot(anchored.select(*PLACE, "key", "c1", "c2"), seen.where("n > 1").select("key", "c1", "c2", "n"), ["key", "c1", "c2"], "n")
    marks = copied.select("doc_id", "rid", F.greatest(F.lit(0), F.col("pos") - mode.reach).alias("start"), (F.col("pos") + mode.length).alias("end"))
    reps = seen.join(several, "key").select("first.doc_id", "first.rid", F.struct("first.pos", "key", "n", "d").alias("rep"))
    reps = reps.groupBy("doc_id", "rid").agg(F.collect_list("rep").alias("reps"))
    rows = stored(named(docs).join(reps, ["doc_id", "rid"]).select("doc_id", "rid", "text", "reps").mapInArrow(contexts(mode), CONTEXTS), "reps")
    for small, alike in refined(rows, mode):
        marks = marks.unionByName(solved(small, mode, equal_spans, MARKS))
        if alike is not None:
            marks = marks.unionByName(alike.select("doc_id", "rid", (F.col("pos") - units(mode, "left_part")).alias("start"), (F.col("pos") + units(mode, "right_part")).alias("end")))
    return marks


def suffix_dedup(docs: DataFrame, length: int = 400, k: int = 64, limit: int = 256) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts anywhere else in ``docs``.

    One row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the remaining
    bytes), text (the remaining bytes, less characters of which a part was removed).  Strings are judged on the input
    and never cross documents.  A null text is empty; texts under ``length`` bytes keep all; a row with a null doc_id
    is returned whole and takes no part; other columns are ignored; an empty table gives an empty result.  Every row
    is a document of its own, whether or not its id or its text occurs again.
    """
    with scratch(docs.sparkSession):
        marks = repeated_bytes(docs, length, k, limit).groupBy("doc_id", "rid").agg(F.collect_list(F.struct("start", "end")).alias("marks"))
        marks = stored(marks, "marks", outer=True)
    rows = docs.select("doc_id", F.xxhash64("text").alias("rid"), "text")
    return rows.join(marks, ["doc_id", "rid"], "left").select("doc_id", "text", "marks").mapInArrow(_cut, RESULT)
