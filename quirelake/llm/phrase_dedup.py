"""Repeated-phrase automata: remove words of passages that occur earlier in the corpus.

1. ``repeats`` confirms the passages that recur and tells where each occurs first.  Neighbouring contexts that occur
   side by side wherever they occur become one passage, so that a text copied whole is one phrase.
2. Documents are dealt into blocks by a hash.  Each distinct phrase goes once to every block that one of its
   contexts touches; how often, and where in the block, is not recorded.
3. The phrases of a block are compiled into an Aho-Corasick automaton over word numbers: one shard of the phrase set.
   Every document of the block streams through it, and the automaton's hits alone tell where phrases occur.  A word is
   removed if a hit covers it that is not the phrase's first place.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate, chain, compress, count, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .repeats import CONTEXTS, PLACE, Spans, _rows, anchored_contexts, contexts, cut_words, listed, moved, named, refined, solved, units
from .work import scratch, stored

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, text string"
#: A phrase, its first place, and the place for which it is meant.
PHRASES = "doc_id long, rid long, pos long, first_doc_id long, first_rid long, first_pos long, words binary"
#: A phrase, its first place, and a context that it goes with.
PASSAGES = "key long, c1 long, c2 long, first_doc_id long, first_rid long, first_pos long, words binary"
_FIRST = ("first_doc_id", "first_rid", "first_pos")
_ORDER = ("block", "kind", "doc_id", "rid", "first_doc_id", "first_rid", "shift", "first_pos")
#: Anchors with a key that recurs, for each block: what bounds a block's phrases.  Small automata stay in a core's cache.
BLOCK_ANCHORS = 1 << 12


def earlier_spans(mode: Spans, lo: int, hi: int, rows: list[dict]) -> Iterator[tuple]:
    """Phrases that a context shares with an earlier one, among spans with ``lo`` to ``hi`` words before the anchor."""
    rows = sorted(rows, key=lambda x: (x["doc_id"], x["rid"], x["pos"]))
    first: dict[tuple[int, bytes], int] = {}
    for i, x in enumerate(rows):
        left, right = x["left_part"], x["right_part"]
        data = left + b" " + right if left and right else left or right
        bounds = [0, *accumulate(len(w) + 1 for w in data.split(b" "))]
        anchor, n = left.count(b" ") + 1 if left else 0, len(bounds) - 1
        shared = None  # words from, words to, and the earlier context of the phrase under way

        def phrase() -> tuple:
            earlier = rows[shared[2]]
            return x["doc_id"], x["rid"], x["pos"] - anchor + shared[0], earlier["doc_id"], earlier["rid"], earlier["pos"] - anchor + shared[0], data[bounds[shared[0]] : bounds[shared[1]] - 1]

        for a in range(max(lo, mode.length - (n - anchor)), min(hi, anchor) + 1):
            begin = anchor - a
            j = first.setdefault((a, data[bounds[begin] : bounds[begin + mode.length]].rstrip(b" ")), i)
            if shared and shared[2] != j:
                yield phrase()
                shared = None
            if j != i:
                shared = (begin, shared[1] if shared else begin + mode.length, j)
        if shared:
            yield phrase()


def passages(mode: Spans):
    """(doc_id, rid, text, copies) -> the phrases that occur first in the document, from its contexts that have copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for doc, rid, text, copies in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), listed(batch.column(3))):
                if (doc, rid) in done:
                    continue
                done.add((doc, rid))
                words, bounds = cut_words(text.as_py())
                order = np.argsort(copies["pos"])
                begin = end = last = None  # the passage under way, and its last context

                def passage() -> tuple:
                    return last[1], last[2], last[3], doc, rid, begin, words[bounds[begin] : bounds[end] - 1]

                for x in zip(*(copies[c][order].tolist() for c in ("pos", "key", "c1", "c2", "n", "fp_low", "fp_high"))):
                    fp = (x[5] + (x[6] << 32)) & (1 << 64) - 1
                    starts, ends = max(0, x[0] - mode.reach), min(len(bounds) - 1, x[0] + mode.length)
                    if last and starts <= end and x[4] == last[4] and moved(last[-1], x[0] - last[0]) == fp:
                        end, last = ends, (*x, fp)
                        continue
                    if last:
                        out.append(passage())
                        size += len(out[-1][-1])
                    begin, end, last = starts, ends, (*x, fp)
                if last:
                    out.append(passage())
                    size += len(out[-1][-1])
                if size > 4 << 20:
                    yield _rows(out, PASSAGES)
                    out, size = [], 0
            yield _rows(out, PASSAGES)

    return run


def confirmed(docs: DataFrame, mode: Spans) -> tuple[DataFrame, Column]:
    """(phrases, stored: block, the document for which one is meant, first place, how far that is off, words; the block of a row by its ``doc_id`` and ``rid``)."""
    with scratch(docs.sparkSession):
        phrases, block = _confirmed(docs, mode)
        return stored(phrases, "phrases", outer=True), block


def _confirmed(docs: DataFrame, mode: Spans) -> tuple[DataFrame, Column]:
    spark = docs.sparkSession
    anchored, seen, several = anchored_contexts(docs, mode)
    blocks = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), anchored.count() // BLOCK_ANCHORS)
    block = F.pmod(F.xxhash64("doc_id", "rid"), F.lit(blocks)).cast("int").alias("block")
    rows = named(docs)

    copies = seen.where("n > 1").select("first.doc_id", "first.rid", F.struct("first.pos", "key", "c1", "c2", "n", "fp_low", "fp_high").alias("x"))
    copies = copies.groupBy("doc_id", "rid").agg(F.collect_list("x").alias("copies"))
    reps = seen.join(several, "key").select("first.doc_id", "first.rid", F.struct("first.pos", "key", "n", "d").alias("rep"))
    reps = reps.groupBy("doc_id", "rid").agg(F.collect_list("rep").alias("reps"))
    texts = stored(rows.join(copies.join(reps, ["doc_id", "rid"], "full"), ["doc_id", "rid"]), "first-texts")  # the texts travel once for both
    touched = anchored.select(block, "key", "c1", "c2").distinct()
    whole = stored(texts.where("copies is not null").select("doc_id", "rid", "text", "copies").mapInArrow(passages(mode), PASSAGES), "passages")
    null = F.lit(None).cast("long")
    phrases = touched.join(whole, ["key", "c1", "c2"]).select("block", null.alias("doc_id"), null.alias("rid"), *_FIRST, null.alias("shift"), "words")
    shift = (F.col("first_pos") - F.col("pos")).alias("shift")

    parts = stored(texts.where("reps is not null").select("doc_id", "rid", "text", "reps").mapInArrow(contexts(mode), CONTEXTS), "reps")
    for small, alike in refined(parts, mode):
        phrases = phrases.unionByName(solved(small, mode, earlier_spans, PHRASES).select(block, "doc_id", "rid", *_FIRST, shift, "words"))
        if alike is not None:
            left, right = F.col("left_part"), F.col("right_part")
            words = F.when(F.octet_length(left) == 0, right).when(F.octet_length(right) == 0, left).otherwise(F.concat(left, F.lit(bytearray(b" ")), right)).alias("words")
            later = alike.where("struct(doc_id, rid, pos) > struct(first_doc_id, first_rid, first_pos)")
            phrases = phrases.unionByName(later.select(block, "doc_id", "rid", "first_doc_id", "first_rid", (F.col("first_pos") - units(mode, "left_part")).alias("first_pos"), shift, words))
    return phrases, block


class Shard:
    """The phrases of one block, compiled when the first document asks."""

    def __init__(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict(count(1).__next__)
        self.phrases: dict[tuple[int, ...], tuple[int, int, int]] = {}
        self.automaton: ahocorasick.Automaton | None = None
        self.open: tuple | None = None

    def add(self, words: bytes, first: tuple[int, int, int], meant: tuple = ()) -> None:
        """Phrases that are ``meant`` for one document, at one distance from their first place, come one after the
        other; where they overlap, they are one phrase there as here."""
        if self.open and meant and meant == self.open[2] and first[:2] == self.open[1][:2]:
            at = first[2] - self.open[1][2]
            if at <= len(self.open[0]):
                new = at + words.count(b" ") + 1 - len(self.open[0])  # words past the open phrase's end
                if new > 0:
                    self.open[0].extend(map(self.numbers.__getitem__, words.rsplit(b" ", new)[-new:]))
                return
        self.close()
        self.open = list(map(self.numbers.__getitem__, words.split())), first, meant

    def close(self) -> None:
        if self.open:
            phrase, first = tuple(self.open[0]), self.open[1]
            self.phrases[phrase] = min(self.phrases.get(phrase, first), first)
            self.open = None

    def compiled(self) -> ahocorasick.Automaton:
        if self.automaton is None:
            self.close()
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
            facts = np.empty((len(self.phrases), 4), np.int64)  # how long each phrase is, and its first place
            for i in range(len(facts)):
                phrase, first = self.phrases.popitem()
                facts[i] = len(phrase), *first
                self.automaton.add_word(phrase, i)
            self.automaton.make_automaton()
            self.facts = facts
        return self.automaton

    def hits(self, doc: int, rid: int, words: list[bytes]) -> np.ndarray | None:
        """Which words lie in phrases that occur earlier too; None where there are none."""
        if not self.numbers:
            return None
        found = list(self.compiled().iter(tuple(map(self.numbers.get, words, repeat(0)))))
        if not found:
            return None
        last, which = np.fromiter(chain.from_iterable(found), np.int64, 2 * len(found)).reshape(-1, 2).T
        size, first_doc, first_rid, first_pos = self.facts[which].T
        begin = last + 1 - size
        later = (first_doc < doc) | (first_doc == doc) & ((first_rid < rid) | (first_rid == rid) & (first_pos < begin))
        if not later.any():
            return None
        n = len(words) + 1
        return np.cumsum(np.bincount(begin[later], minlength=n) - np.bincount(last[later] + 1, minlength=n))[:-1] > 0


def streamed(keep: bool):
    """Rows (block, kind, row, phrase) in the order of ``_ORDER``, so a block's phrases before its documents -> the documents without what the hits cover.

    With ``keep`` a document is returned with all its columns and a rewritten text, or not at all once it has lost
    every word; else as its digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, shard = None, Shard()
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if here != blocks[a]:
                    here, shard = blocks[a], Shard()
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    for doc, rid, shift, *first, words in zip(*(part.column(c).to_pylist() for c in ("doc_id", "rid", "shift", *_FIRST, "words"))):
                        shard.add(words, tuple(first), () if doc is None else (doc, rid, shift))
                else:
                    row = part.column("row")
                    for at in range(0, len(row), 256):
                        yield stripped(shard, row.slice(at, 256))

    def stripped(shard: Shard, row: pa.StructArray) -> pa.RecordBatch:
        names = [f.name for f in row.type]
        columns = row.flatten()
        ids, rids = (columns[names.index(c)].to_pylist() for c in ("doc_id", "__rid"))
        text = names.index("text")
        kind = columns[text].type
        texts = columns[text].cast(pa.binary()).to_pylist()
        counts, gone, digests, left = [], [], [], []
        for i, (doc, rid, raw) in enumerate(zip(ids, rids, texts)):
            words = (raw or b"").split()
            mask = None if doc is None else shard.hits(doc, rid, words)
            counts.append(len(words))
            if mask is not None:
                words = list(compress(words, (~mask).tolist()))
            if mask is not None or not keep:
                texts[i] = b" ".join(words)
            if not keep:
                gone.append(counts[-1] - len(words))
                digests.append(hashlib.sha256(texts[i]).hexdigest())
            left.append(mask is None or bool(words))
        kept = pa.array(texts, pa.binary()).cast(kind)
        if not keep:
            return pa.RecordBatch.from_arrays([columns[names.index("doc_id")], pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), kept.cast(pa.string())], [x.split()[0] for x in RESULT.split(", ")])
        columns[text] = kept
        rest = [i for i, c in enumerate(names) if c != "__rid"]
        return pa.RecordBatch.from_arrays([columns[i] for i in rest], [names[i] for i in rest]).filter(pa.array(left, pa.bool_()))

    return run


def _stream(docs: DataFrame, mode: Spans, columns: list[str], keep: bool, schema) -> DataFrame:
    phrases, block = confirmed(docs, mode)
    rows = docs.select(*[docs[c] for c in columns], F.xxhash64(docs["text"]).alias("__rid"))
    of_row = F.struct(*rows.columns).alias("row")
    rows = rows.select(F.struct("doc_id", F.col("__rid").alias("rid")).alias("__at"), of_row).select(F.col("__at.doc_id").alias("doc_id"), F.col("__at.rid").alias("rid"), "row").select(block, F.lit(1).alias("kind"), "row")
    both = rows.unionByName(phrases.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    return both.repartition("block").sortWithinPartitions(*_ORDER).mapInArrow(streamed(keep), schema)


def phrase_dedup(docs: DataFrame, length: int = 20, k: int = 4, limit: int = 512) -> DataFrame:
    """Remove each word covered by a window of ``length`` words whose sequence also starts earlier.

    Earlier: in a smaller doc_id, or in the same document at an earlier start; judged on the input.  Words are runs
    of bytes that are no ASCII white space.  One row per input row: doc_id, n_words, n_removed, kept_sha256 and text
    (both of the kept words joined by one space).  A null text has no words; texts under ``length`` words keep all; a
    row with a null doc_id is returned whole and takes no part; rows that share a doc_id but not a text are documents
    of their own, ordered by a hash of the text; rows with equal doc_id and text are one document and all get its
    result; other columns are ignored; an empty table gives an empty result.
    """
    mode = Spans("words", length, min(k, max(1, length // 2)), limit)
    return _stream(docs, mode, ["doc_id", "text"], False, RESULT)


def strip_phrases(docs: DataFrame, length: int = 20, k: int = 4, limit: int = 512) -> DataFrame:
    """``docs`` with all columns, each text without the words that ``phrase_dedup`` removes.

    A text that loses nothing stays as it is; a document that loses all its words goes.
    """
    mode = Spans("words", length, min(k, max(1, length // 2)), limit)
    return _stream(docs, mode, docs.columns, True, docs.schema)
