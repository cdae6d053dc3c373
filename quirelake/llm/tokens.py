"""Fast exact encoding with a byte-level BPE of the tokenizers library.

The tokenizer cuts a text into pre-tokens and merges inside each, so a text may be cut wherever a pre-token is
certain to end: before a space or line break that follows a visible character and precedes one, and before a comma
or full stop that follows a letter or digit.  The pieces repeat: Arrow finds the distinct ones of a run of texts, and
each is encoded by the library once per worker and remembered (up to ``CACHE`` pieces).  Texts are cut at every such
mark without looking; whether a cut was safe is a property of the two pieces beside it, so it is read off remembered
flags, and the few texts with an unsafe cut are cut again with care.  Texts that hold a special token's string are
handed to the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache as once
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import ByteLevel

from . import kernels as K

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core a task

CACHE = 1_600_000
#: Cuts that are always safe.
_SAFE = re.compile(r"(?<=\S)(?= \S)")
_BLANK, _CLOSES, _OPEN = 1, 2, 4
_MARKS = np.zeros(256, bool)
_MARKS[[0x20, 0x0A, 0x2C, 0x2E]] = True
#: Bytes of texts that are cut at once.
RUN_BYTES = 3 << 20


def _byte_names() -> dict[int, str]:
    """A byte-level vocabulary's name for each byte: itself where it prints, else the next character from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_NAMES = _byte_names()


def _flags(piece: str) -> int:
    """_BLANK: ends in white space, so a cut after it may be wrong; _CLOSES: begins with a closing mark; _OPEN: a closing mark may not be cut off after it."""
    last = piece[-1:]
    return _BLANK * last.isspace() | _CLOSES * (piece[:1] in (",", ".") and piece != "") | _OPEN * (not last.isalnum())


class PieceEncoder:
    """Token ids of texts, equal to ``tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        if not isinstance(self.tokenizer.model, BPE) or not isinstance(self.tokenizer.pre_tokenizer, ByteLevel):
            raise ValueError("a byte-level BPE is needed")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.ends, self.flags = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.uint8)

    def _learn(self, missing: list[bytes]) -> None:
        # letters, with a space before them or not, are one pre-token: the library's model takes them directly
        texts = [x.decode() for x in missing]
        single = [x[x[:1] == " " :].isalpha() for x in texts]
        rest = iter(self.tokenizer.encode_batch_fast([x for x, one in zip(texts, single) if not one], add_special_tokens=False))
        merge = self.tokenizer.model.tokenize
        found = [[t.id for t in merge(x.decode("latin-1").translate(_BYTE_NAMES))] if one else next(rest).ids for x, one in zip(missing, single)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        n, m, total = len(self.known), len(missing), int(size.sum())
        while n + m + 1 > len(self.ends):
            self.ends, self.flags = np.concatenate([self.ends, np.zeros_like(self.ends)]), np.concatenate([self.flags, np.zeros_like(self.flags)])
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.int32, total)
        self.ends[n + 1 : n + m + 1] = self.used + np.cumsum(size)
        self.flags[n : n + m] = np.fromiter(map(_flags, texts), np.uint8, m)
        self.used += total
        self.known.update(zip(missing, range(n, n + m)))

    def _numbers(self, pieces: list[bytes]) -> np.ndarray:
        """The numbers of distinct pieces."""
        found = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = np.arange(len(self.known), len(self.known) + len(new))
            self._learn([pieces[i] for i in new.tolist()])
        return found

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each piece, bounds of each text's pieces) of texts cut before every mark."""
        first = np.zeros(len(data) + 1, bool)
        first[:-1] = _MARKS[data]
        first[offsets[:-1]] = True
        starts = np.flatnonzero(first[:-1])
        bounds = np.searchsorted(starts, offsets)
        ends = np.append(starts[1:], len(data)).astype(np.int32)
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts[:1], ends).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        return self._numbers(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()], bounds

    def runs(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, their ids, how many each has) for runs of bounded size; a null is empty."""
        for a, b, data, offsets in K.chunks(texts, RUN_BYTES):
            if len(self.known) > CACHE:
                self.clear()
            yield a, b, *self._encode(data, offsets)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds)."""
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for _, _, x, size in self.runs(pa.array(texts, pa.string())):
            ids.append(x)
            sizes.append(size)
        return np.concatenate(ids), np.cumsum(np.concatenate(sizes))

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, bounds = self._cut(data, offsets)
        flags = self.flags[at]
        unsafe = (flags & _BLANK) > 0
        unsafe[1:] |= ((flags[1:] & _CLOSES) > 0) & ((flags[:-1] & _OPEN) > 0)
        begins = np.unique(bounds[:-1][np.diff(bounds) > 0])  # the first piece of a text follows nothing
        unsafe[begins] = (flags[begins] & _BLANK) > 0
        careful = set((np.searchsorted(bounds, np.flatnonzero(unsafe), side="right") - 1).tolist())
        raw = data.tobytes()
        special = [s.encode() for s in self.special]
        for s in special:
            where = raw.find(s)
            while where >= 0:
                careful.add(int(np.searchsorted(offsets, where, side="right")) - 1)
                where = raw.find(s, where + 1)
        counts = np.diff(bounds)
        if careful:
            own = {}
            for i in sorted(careful):
                text = raw[offsets[i] : offsets[i + 1]]
                own[i] = [text] if any(s in text for s in special) else [x.encode() for x in _SAFE.split(text.decode())]
            distinct = list(dict.fromkeys(chain.from_iterable(own.values())))
            number = dict(zip(distinct, self._numbers(distinct).tolist()))
            parts, done = [], 0
            for i, pieces in own.items():
                parts += [at[bounds[done] : bounds[i]], np.array([number[x] for x in pieces], np.int64)]
                done, counts[i] = i + 1, len(pieces)
            at = np.concatenate([*parts, at[bounds[done] :]])
        first = self.ends[at]
        size = self.ends[at + 1] - first
        total = np.r_[0, np.cumsum(size)]
        ids = self.ids[np.repeat(first - total[:-1], size) + np.arange(total[-1])]
        return ids, np.diff(total[np.r_[0, np.cumsum(counts)]])


@once
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def vocabulary_size(path: str) -> int:
    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
