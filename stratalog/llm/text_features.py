"""A fixed number of plain figures of a text, for models over whole documents: shares of characters, words and repetition.

Nothing but the text goes in. Shares enter by their roots, sizes by their logarithms, so that none dwarfs the others."""

from __future__ import annotations

import string
from collections import Counter

import numpy as np

MARKS = string.punctuation
_CLASSES = {"lower": string.ascii_lowercase, "upper": string.ascii_uppercase, "digit": string.digits, "blank": " \t", "line": "\n\r", **{m: m for m in MARKS}}
_GROUPS = [*_CLASSES, "control", "wide"]
_OF_BYTE = np.full(256, _GROUPS.index("wide"))
_OF_BYTE[:128] = _GROUPS.index("control")
for _k, _chars in enumerate(_CLASSES.values()):
    _OF_BYTE[list(_chars.encode())] = _k
NAMES = [
    *(f"share {g}" for g in _GROUPS), "empty", "words", "lines", "word length", "word length spread", "line words", "distinct words", "commonest word", "repeated lines", "repeated triples", "words with a mark inside or behind", "capitalized words",
]


def figures(text: str | None) -> np.ndarray:
    """The figures of one text, by ``NAMES``; a null text is empty."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(len(NAMES), np.float32)
    n = len(_GROUPS)
    if len(raw):
        out[:n] = np.sqrt(np.bincount(_OF_BYTE[raw], minlength=n) / len(raw))
    words = (text or "").split()
    if not words:
        out[n] = 1
        return out
    number: dict[str, int] = {}
    code = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    size = np.fromiter(map(len, words), np.float64, len(words))
    times = np.bincount(code)
    lines = Counter(x for x in text.split("\n") if x.strip())
    total = sum(lines.values())
    share = lambda flags: np.sqrt(sum(flags) / len(words))
    again = 0.0
    if len(words) > 2:
        triple = (code[:-2] * len(number) + code[1:-1]) * len(number) + code[2:] if len(number) < 1 << 20 else code[2:]
        _, first, count = np.unique(triple, return_index=True, return_counts=True)
        again = 1 - len(first) / len(triple)
    out[n + 1 :] = (
        np.log1p(len(words)), np.log1p(total), np.log1p(size.mean()), np.log1p(size.std()), np.log1p(len(words) / total), len(number) / len(words), np.sqrt(times.max() / len(words)), np.sqrt(1 - len(lines) / total), np.sqrt(again),
        share(not w.isalnum() for w in words), share(w[0].isupper() for w in words),
    )
    return out
