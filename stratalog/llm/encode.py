"""Token ids of many texts: the tokenizers library on each distinct piece, a bounded cache for the rest.

Pieces are cut only where the tokenizer's own pre-tokenizer must cut as well, so the ids are those of the
whole text. The cache is bounded by bytes: pieces of more than ``LONG`` characters never enter it, and when it is full
the pieces that came only once go first. ``released`` empties it at the task's end, unless the next
task is to find it as it is.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Bytes that a worker's cache may take: per piece about ENTRY_BYTES (key, number, slot of the table) and 8 for each id.
CACHE_BYTES = 64 << 20
ENTRY_BYTES = 200
#: Longest piece that is kept, in characters.
LONG = 64
END_ID = 1

_OTHER_SPACE = re.compile("[\x01\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")


class Encoder:
    """What both kinds share; a kind says how to cut texts and how to encode many pieces at once."""

    def __init__(self, path: str, limit: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.names = [""] * (1 + max(names.values()))
        for name, i in names.items():
            self.names[i] = name
        self.empty()

    def empty(self) -> None:
        self.known: dict[str, int] = {}
        self.first, self.size, self.pool = (np.zeros(0, np.int64) for _ in range(3))
        self.again = np.zeros(0, bool)  # pieces that came up once more since the cache was last cut

    def held_bytes(self) -> int:
        return ENTRY_BYTES * len(self.known) + 8 * len(self.pool)

    def _cut(self) -> None:
        """Within the limit again: pieces that came only once go; all go where that isn't half of it, and long ones always."""
        stays = self.again & (self.size <= LONG)
        if ENTRY_BYTES * int(stays.sum()) + 8 * int(self.size[stays].sum()) > self.limit // 2:
            stays[:] = False
        number = np.cumsum(stays) - 1
        kept = stays.tolist()
        self.known = {p: int(number[i]) for p, i in self.known.items() if kept[i] and len(p) <= LONG}
        first, size = self.first[stays], self.size[stays]
        ends = np.cumsum(size)
        self.pool = self.pool[np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        self.first, self.size, self.again = ends - size, size, np.zeros(len(size), bool)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)

    def _whole(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [x.ids for x in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        return np.array([i for x in got for i in x], np.int64), np.array([len(x) for x in got], np.int64)

    def _learn(self, new: list[str]) -> None:
        """Encode new pieces in few texts, which the library does fastest; the kinds of tokenizer differ in how the
        pieces' ends are found again. What doesn't come out even is encoded piece by piece."""
        joins, others = [], []
        for p in new:
            (joins if self.joins(p) else others).append(p)
        found = [(joins, self._joined(joins))] if joins else []
        if found and found[0][1] is None:
            found, joins = [], []
        if len(joins) < len(new):
            alone = others if joins else new
            found.append((alone, self._others(alone)))
        for pieces, (ids, sizes) in found:
            n = len(self.size)
            self.known.update(zip(pieces, range(n, n + len(pieces)), strict=True))
            first = len(self.pool) + np.cumsum(sizes) - sizes
            self.first, self.size, self.pool = (np.concatenate(x) for x in ((self.first, first), (self.size, sizes), (self.pool, ids)))
            self.again = np.concatenate([self.again, np.zeros(len(pieces), bool)])

    def _find(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        every: list[str] = []
        ends_of = np.empty(len(texts), np.int64)
        for i, x in enumerate(texts):
            every += self.pieces(x)
            ends_of[i] = len(every)
        at = self._find(every)
        self.again[at[at >= 0]] = True
        missing = np.flatnonzero(at < 0)
        new = list({every[i] for i in missing.tolist()})
        if new:
            self._learn(new)
            at[missing] = self._find([every[i] for i in missing.tolist()])
        size = self.size[at]
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(self.first[at] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        total = np.concatenate([[0], ends])[np.concatenate([[0], ends_of])]
        if self.held_bytes() > self.limit:
            self._cut()
        return ids.astype(np.uint32), np.diff(total)


class ByteLevel(Encoder):
    """A byte-level BPE whose pre-tokenizer joins one blank to the word after it."""

    def __init__(self, path: str, limit: int = CACHE_BYTES):
        super().__init__(path, limit)
        self.width = np.array([len(x) for x in self.names], np.int64)  # a character of a name is a byte of text
        (self.newline,) = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def pieces(self, text: str) -> list[str]:
        """Cut before blanks and around line ends that stand alone; texts with other white space stay whole."""
        flat = text.replace("\n", " ")
        if "  " in flat or flat[:1] in (" ", "") or flat[-1] == " " or not flat.isprintable() and _OTHER_SPACE.search(text):
            return [text]
        return text.replace("\n", "\x01\n\x01").replace(" ", "\x01 ").split("\x01")

    def joins(self, piece: str) -> bool:
        return piece > " " and piece.isprintable() and " " not in piece[1:]

    def _joined(self, new: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Pieces without a blank get a line end in front, whose id is dropped; ends are found by bytes."""
        texts = [p if p[0] == " " else "\n" + p for p in new]
        ids = self._ids("".join(texts))
        ends = np.cumsum([len(p.encode()) for p in texts])
        reach = np.cumsum(self.width[ids])
        last = np.searchsorted(reach, ends)
        if reach[-1] != ends[-1] or (reach[last] != ends).any():
            return None
        stays = ids != self.newline
        return ids[stays], np.diff(np.cumsum(stays)[last], prepend=0)

    _others = Encoder._whole


class Spaced(Encoder):
    """A BPE with word ends that drops white space: no id ever crosses it."""

    MARK = "\x02"

    def __init__(self, path: str, limit: int = 2 * CACHE_BYTES):
        super().__init__(path, limit)
        self.ends = np.array([x.endswith("</w>") for x in self.names])
        (self.mark,) = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.folds = self.tokenizer.encode("QZ", add_special_tokens=False).ids == self.tokenizer.encode("qz", add_special_tokens=False).ids
        self.added = [x.content.lower() for x in self.tokenizer.get_added_tokens_decoder().values()]

    def pieces(self, text: str) -> list[str]:
        """Cut at blanks. The tokenizer lower-cases, which for ASCII is done before, so that a word in capitals is no other
        piece; not where an added token's name would arise."""
        flat = text.replace("\n", " ")
        if self.folds and flat.isascii():
            low = flat.lower()
            flat = flat if any(x in low for x in self.added) else low
        return flat.split(" ")

    def joins(self, piece: str) -> bool:
        """Letters up to U+00FF alone are one word to the pre-tokenizer; a comma or full stop behind them is another."""
        word = piece[:-1] if piece[-1:] in (",", ".") else piece
        return word.isalpha() and (word.isascii() or max(word) < "\u0100")

    def _joined(self, new: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        ids = self._ids(" ".join(new))
        last = np.flatnonzero(self.ends[ids])
        words = np.cumsum([2 if p[-1] in ",." else 1 for p in new])
        return (ids, np.diff(last[words - 1], prepend=-1)) if len(last) == words[-1] else None

    def _others(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Marks between the pieces, a character that is one token of its own."""
        if any(self.MARK in p for p in new):
            return self._whole(new)
        ids = self._ids(f" {self.MARK} ".join([*new, ""]))
        marks = np.flatnonzero(ids == self.mark)
        return ids[ids != self.mark], np.diff(marks, prepend=-1) - 1


_kept: dict[tuple[type, str], Encoder] = {}


@contextmanager
def released(kind: type[Encoder], path: str, keep: bool = False) -> Iterator[Encoder]:
    """This worker's encoder, for one task: the tokenizer stays for the next one, the cache is emptied, or kept as well."""
    encoder = _kept.setdefault((kind, path), None) or kind(path)
    _kept[kind, path] = encoder
    try:
        yield encoder
    finally:
        if not keep:
            encoder.empty()


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of rows whose texts have about ``limit`` bytes; a null text is empty."""
    for batch in runs(batches, column, limit):
        yield batch, [x or "" for x in batch.column(column).to_pylist()]


def runs(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same without the texts, of which no more than a run's are strings at once. What Arrow keeps of used batches goes
    back to the system at the end, for workers outlive their tasks."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()


def with_end(ids: np.ndarray, sizes: np.ndarray, end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Put the end id behind each text's ids."""
    ends = np.cumsum(sizes)
    return np.insert(ids, ends, end), sizes + 1
