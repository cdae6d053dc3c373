"""Edit-aware token counts.

A document is cut into leaves of some hundred characters where a pre-token is certain to end; a segment tree keeps
characters and tokens of every subtree.  An edit finds its leaves by descending on character sums; only those leaves
are encoded again, with neighbours taken in for as long as the cut beside them is no longer certain, and the sums on
the paths to the root are updated.  The leaves with their counts are a table, so that a later edit starts from them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import _rows
from .tokens import PieceEncoder, encoder
from .work import stored

COUNTS = "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_chars long, n_chars_encoded long"
TREES = "doc_id long, leaves array<string>, tokens array<long>"
LEAF_CHARS = 400
_CUT = re.compile(r"(?<=\S)(?= \S)")

#: (start, end, replacement) in characters of the text, ascending and apart.
Edit = tuple[int, int, str]


def leaves(text: str, size: int = LEAF_CHARS) -> list[str]:
    """The text in leaves of about ``size`` characters, cut only where a pre-token is certain to end."""
    out, at = [], 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    out.append(text[at:])
    return out


class SegmentTree:
    """Sums of characters and tokens over a document's leaves."""

    def __init__(self, parts: list[str], tokens: list[int]):
        self.parts, self.base = list(parts), 1
        while self.base < len(parts):
            self.base *= 2
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        for i, (p, n) in enumerate(zip(parts, tokens)):
            self.chars[self.base + i], self.tokens[self.base + i] = len(p), n
        for i in range(self.base - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
        self.encoded = 0

    @property
    def total(self) -> int:
        return self.tokens[1]

    def rows(self) -> tuple[list[str], list[int]]:
        """What is kept of the tree: texts and tokens of the leaves that hold something."""
        held = [(p, n) for p, n in zip(self.parts, self.tokens[self.base :]) if p] or [("", 0)]
        return [p for p, _ in held], [n for _, n in held]

    def locate(self, at: int) -> tuple[int, int]:
        """(leaf, offset in it) of a character position; the end belongs to the last leaf."""
        if at >= self.chars[1]:
            last = len(self.parts) - 1
            return last, len(self.parts[last])
        i = 1
        while i < self.base:
            i *= 2
            if at >= self.chars[i]:
                at -= self.chars[i]
                i += 1
        return i - self.base, at

    def _put(self, leaf: int, text: str, tokens: int) -> None:
        self.parts[leaf] = text
        i = self.base + leaf
        self.chars[i], self.tokens[i] = len(text), tokens
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @staticmethod
    def _certain(left: str, right: str) -> bool:
        return bool(left) and not left[-1].isspace() and len(right) > 1 and right[0] == " " and not right[1].isspace()

    def edit(self, start: int, end: int, text: str, encode: PieceEncoder) -> None:
        """Replace characters start..end; positions refer to the text as it is now."""
        first, a = self.locate(start)
        last, b = self.locate(end)
        new = self.parts[first][:a] + text + self.parts[last][b:]
        # boundary context: take in neighbours until both cuts are certain again
        while True:
            left = next((i for i in range(first - 1, -1, -1) if self.parts[i]), None)
            right = next((i for i in range(last + 1, len(self.parts)) if self.parts[i]), None)
            if left is not None and not self._certain(self.parts[left], new):
                first, new = left, self.parts[left] + new
            elif right is not None and not self._certain(new, self.parts[right]):
                last, new = right, new + self.parts[right]
            else:
                break
        for i in range(first + 1, last + 1):
            if self.parts[i]:
                self._put(i, "", 0)
        _, bounds = encode.encode([new])
        self.encoded += len(new)
        self._put(first, new, int(bounds[-1]))


_PERSONAL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|(?<![\w.])\+?\d[\d ()/-]{6,}\d(?!\w)")


def redactions(text: str) -> list[Edit]:
    """Mail addresses and telephone-like numbers, each replaced by a tag."""
    return [(m.start(), m.end(), "<MAIL>" if "@" in m.group() else "<NUMBER>") for m in _PERSONAL.finditer(text)]


def apart(edits: list[Edit], size: int) -> list[Edit]:
    """The edits in ascending order, clipped to a text of ``size`` characters; one that begins inside another before it goes."""
    out: list[Edit] = []
    for start, end, new in sorted((min(max(a, 0), size), min(max(b, 0), size), x) for a, b, x in edits):
        if end >= start and (not out or start >= out[-1][1]):
            out.append((start, end, new))
    return out


def _lists(rows: list[list], kind: pa.DataType) -> pa.ListArray:
    bounds = np.r_[0, np.cumsum([len(x) for x in rows])]
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(list(chain.from_iterable(rows)), kind))


def _build(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                parts = [leaves(x or "") for x in rows.column(1).to_pylist()]
                _, bounds = tokens.encode([p for own in parts for p in own])
                offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in parts])], pa.int32())
                counts = pa.ListArray.from_arrays(offsets, pa.array(np.diff(bounds), pa.int64()))
                kept = rows.columns[2:]
                yield pa.RecordBatch.from_arrays([rows.column(0), _lists(parts, pa.string()), counts, *kept], ["doc_id", "leaves", "tokens", "edits"][: 3 + len(kept)])

    return run


def _change(path: str, find: Callable[[str], list[Edit]] | None, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                given = rows.column(3).to_pylist() if find is None else repeat(None)
                out, parts, sizes = [], [], []
                for doc, own, mine, changes in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist(), given):
                    length = sum(map(len, own))
                    wanted = find("".join(own)) if find else [(e["start"], e["end"], e["text"] or "") for e in changes or ()]
                    edits = apart(wanted, length)
                    before = after = sum(mine)
                    encoded = 0
                    if edits:
                        tree = SegmentTree(own, mine)
                        for start, end, new in reversed(edits):  # from the end, so that positions hold
                            tree.edit(start, end, new, tokens)
                        after, encoded = tree.total, tree.encoded
                        if keep:
                            own, mine = tree.rows()
                    out.append((doc, before, len(edits), after, length, encoded))
                    if keep:
                        parts.append(own)
                        sizes.append(mine)
                done = _rows(out, COUNTS)
                if keep:
                    done = pa.RecordBatch.from_arrays([*done.columns, _lists(parts, pa.string()), _lists(sizes, pa.int64())], [*done.schema.names, "leaves", "tokens"])
                yield done

    return run


def count_trees(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per input row: doc_id, leaves, tokens (the texts of the tree's leaves and their counts), and ``edits`` where ``docs`` has it.

    This is what is kept of a document's segment tree; sums are rebuilt from it without encoding.  A null text is one
    empty leaf; a null doc_id and repeated rows are kept like others; an empty table gives no rows.
    """
    kept = ["edits"] if "edits" in docs.columns else []
    schema = TREES + "".join(f", edits {docs.schema[x].dataType.simpleString()}" for x in kept)
    return docs.select("doc_id", "text", *kept).mapInArrow(_build(tokenizer), schema)


def edit_trees(trees: DataFrame, tokenizer: str, find: Callable[[str], list[Edit]] | None = redactions, keep: bool = True) -> DataFrame:
    """``edited_counts`` of kept trees, and with ``keep`` the edited trees (leaves, tokens), ready for the next edit.

    Only leaves that an edit touches, with their boundary context, are encoded; no text is encoded whole.
    """
    columns = ["doc_id", "leaves", "tokens"] + (["edits"] if find is None else [])
    return trees.select(*columns).mapInArrow(_change(tokenizer, find, keep), COUNTS + (", leaves array<string>, tokens array<long>" if keep else ""))


def edited_counts(docs: DataFrame, tokenizer: str, find: Callable[[str], list[Edit]] | None = redactions) -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_edits, n_tokens_edited, n_chars, n_chars_encoded.

    Edits come from ``find(text)``, or with ``find=None`` from a column ``edits`` array<struct<start,end,text>> of
    character ranges; they are clipped to the text, and one that begins inside another is left out and not counted.
    n_tokens_edited is the count of the edited text, found by encoding again n_chars_encoded characters only.  A null
    text is empty (no tokens); null edits are none; a null doc_id is counted like others; other columns are ignored;
    an empty table gives no rows.  The trees are written once and the edits applied to what was written.
    """
    own = docs.select("doc_id", "text", *(["edits"] if find is None else []))
    return edit_trees(stored(count_trees(own, tokenizer), "trees"), tokenizer, find, keep=False)
