"""Hashes over the bytes of many texts at once, with numpy; shared by operators 1 and 2."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1 modulo 2 ** 64, kept for the next call."""
    key = int(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        have = _powers[key] = np.multiply.accumulate(out)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of data[i:j] times powers of the base from i on."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span that doesn't depend on where the span lies."""
    inverse = powers(_INVERSE, len(sums))
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z taken as a-z) one text after the other, and how many each text has."""
    raw = [x.encode("utf-8", "surrogatepass") for x in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    data = _LOWER[np.frombuffer(b" ".join(raw), np.uint8)]
    gap = np.concatenate([[True], _SPACE[data], [True]])
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edges[::2], edges[1::2]
    ends = np.cumsum(sizes + 1)  # a blank behind each text
    counts = np.diff(np.concatenate([[0], np.searchsorted(start, ends)]))
    return span_hashes(prefix_sums(data), start, end), counts


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than a shingle make one of all, none make none."""
    hashes, counts = word_hashes(texts)
    k = np.uint64(0x9FB21C651E98DF25)
    joined = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for i in range(words):
        joined = mix(joined * k + hashes[i : len(hashes) - words + 1 + i] + np.uint64(i + 1))
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            found = np.sort(joined[at : at + n - words + 1])
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        elif n:
            short = np.array([n], np.uint64) * k
            for h in hashes[at : at + n]:
                short = mix(short * k + h)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out
