"""Exact spectra of symmetric integer matrices without negative eigenvalues: the characteristic polynomial by Hessenberg
reduction modulo primes, its roots by counting sign changes, eigenvectors by inverse iteration in long fixed point.

Sizes depend on the matrix's dimension and the digits of its entries alone, never on the rows behind it."""

from __future__ import annotations

from fractions import Fraction
from math import comb, isqrt, prod

import numpy as np

#: Bits to which a root is narrowed, relative to itself, and bits behind the point in inverse iteration beyond the root's.
ROOT_BITS, POINT_BITS = 96, 160
ROUNDS = 4


def is_prime(n: int) -> bool:
    """For n below 3.2e9, by three bases that suffice there."""
    if n < 2 or n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if n == base or x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def coefficient_bound(matrix: np.ndarray) -> int:
    """No coefficient is larger: the k-th is at most C(d, k) times the k-th power of the mean eigenvalue."""
    d, trace = len(matrix), int(matrix.trace()) if len(matrix) else 0
    return max((comb(d, k) * trace**k // d**k + 1 for k in range(1, d + 1)), default=1)


def primes_for(matrix: np.ndarray) -> list[int]:
    """The largest primes below 2**31 whose product passes every coefficient."""
    found, need, n = [], coefficient_bound(matrix).bit_length() + 1, (1 << 31) - 1
    while 30 * len(found) < need + 30:
        if is_prime(n):
            found.append(n)
        n -= 2
    return found


def residues(matrix: np.ndarray, primes: np.ndarray) -> np.ndarray:
    """The characteristic polynomial's coefficients modulo each prime, highest first; all primes side by side."""
    d, count = len(matrix), len(primes)
    p = primes.astype(np.int64)
    a = np.stack([(matrix % int(q)).astype(np.int64) for q in p]).reshape(count, d, d)
    wide, each = p[:, None, None], np.arange(count)
    for k in range(d - 2):
        below = a[:, k + 1 :, k] != 0
        row = k + 1 + below.argmax(1)
        swap = a[each, row].copy()
        a[each, row], a[:, k + 1] = a[:, k + 1].copy(), swap
        swap = a[each, :, row].copy()
        a[each, :, row], a[:, :, k + 1] = a[:, :, k + 1].copy(), swap
        # A column without a pivot is done already: its factors are 0.
        inverse = np.array([pow(int(x), -1, int(q)) if x else 0 for x, q in zip(a[:, k + 1, k], p, strict=True)], np.int64)
        factor = a[:, k + 2 :, k] * inverse[:, None] % p[:, None]
        a[:, k + 2 :] = (a[:, k + 2 :] - factor[:, :, None] * a[:, k + 1][:, None, :] % wide) % wide
        a[:, :, k + 1] = (a[:, :, k + 1] + (a[:, :, k + 2 :] * factor[:, None, :] % wide).sum(2)) % p[:, None]
    # polys[:, k] is the polynomial of the leading k rows and columns, lowest coefficient first.
    polys = np.zeros((count, d + 1, d + 1), np.int64)
    polys[:, 0, 0] = 1
    for k in range(d):
        now = np.zeros((count, d + 1), np.int64)
        now[:, 1:] = polys[:, k, :-1]
        share, chain = np.zeros((count, k + 1), np.int64), np.ones(count, np.int64)
        for i in range(k, -1, -1):
            share[:, i] = a[:, i, k] * chain % p
            if i:
                chain = chain * a[:, i, i - 1] % p
        taken = (share[:, :, None] * polys[:, : k + 1] % wide).sum(1)
        polys[:, k + 1] = (now - taken) % p[:, None]
    return polys[:, d, ::-1]


def combined(primes: list[int], rows: list[list[int]]) -> list[int]:
    """Chinese remaindering. Eigenvalues aren't negative, so signs alternate and the size alone is open."""
    whole = prod(primes)
    weight = [(whole // q) * pow(whole // q, -1, q) for q in primes]
    out = []
    for k, column in enumerate(zip(*rows, strict=True)):
        value = sum(int(r) * w for r, w in zip(column, weight, strict=True)) % whole
        out.append(value if k % 2 == 0 else -(-value % whole))
    return out


class Roots:
    """Roots of a polynomial, highest coefficient first, all of whose roots are real and none negative."""

    def __init__(self, coefficients: list[int]):
        zeros = 0
        while zeros < len(coefficients) - 1 and coefficients[-1 - zeros] == 0:
            zeros += 1
        self.c = coefficients[: len(coefficients) - zeros]
        self.positive = len(self.c) - 1

    def above(self, m: int, s: int) -> int:
        """How many roots, by multiplicity, lie above m / 2**s: the sign changes after moving zero there, which for
        real roots is exact."""
        c = [x << (s * i) for i, x in enumerate(self.c)]
        for end in range(len(c) - 1, 0, -1):
            for i in range(1, end + 1):
                c[i] += m * c[i - 1]
        signs = [x > 0 for x in c if x]
        return sum(a != b for a, b in zip(signs, signs[1:], strict=False))

    def sign(self, m: int, s: int) -> int:
        value = 0
        for i, x in enumerate(self.c):
            value = value * m + (x << (s * i))
        return (value > 0) - (value < 0)

    def largest(self, count: int) -> list[Fraction]:
        """The largest positive roots, falling, each by its multiplicity."""
        if not self.positive:
            return []
        out: list[Fraction] = []
        top = -self.c[1] + 1  # their sum
        for j in range(1, min(count, self.positive) + 1):
            lo, hi, s = 0, top, 0
            many, fewer = self.positive, 0
            while (hi - lo) << ROOT_BITS > lo:
                if hi - lo == 1:
                    lo, hi, s = lo * 2, hi * 2, s + 1
                mid = (lo + hi) // 2
                if many - fewer == 1:  # alone: below it the polynomial has another sign than above
                    over = self.sign(mid, s) == (1 if fewer % 2 else -1)
                else:
                    n = self.above(mid, s)
                    over = n >= j
                    many, fewer = (n, fewer) if over else (many, n)
                lo, hi = (mid, hi) if over else (lo, mid)
            out.append(Fraction(lo + hi, 1 << (s + 1)))
        return out


def _unit(v: np.ndarray, bits: int) -> np.ndarray:
    """Scaled to length 1 in fixed point."""
    size = isqrt(int((v * v).sum()))
    return (v << bits) // size


def eigenvectors(matrix: np.ndarray, roots: list[Fraction]) -> np.ndarray:
    """A unit vector for each root, as rows of doubles: the null space of matrix - root by inverse iteration, orthogonal to
    the vectors before it, so that equal roots give a basis of what they share."""
    d, draw, found = len(matrix), np.random.default_rng(12), []
    for root in roots:
        bits = POINT_BITS + ROOT_BITS
        shift = (root.numerator << bits) // root.denominator
        a = np.array([[int(x) << bits for x in row] for row in matrix.tolist()], object).reshape(d, d)
        a[np.arange(d), np.arange(d)] -= shift
        order = list(range(d))
        for k in range(d):
            best = max(range(k, d), key=lambda i: abs(a[i, k]))  # noqa: B023
            a[[k, best]] = a[[best, k]]
            order[k], order[best] = order[best], order[k]
            a[k, k] = a[k, k] or 1
            if k + 1 < d:
                a[k + 1 :, k] = (a[k + 1 :, k] << bits) // a[k, k]
                a[k + 1 :, k + 1 :] -= (a[k + 1 :, k][:, None] * a[k, k + 1 :][None, :]) >> bits
        v = np.array([int(x) << (bits - 20) for x in draw.integers(1, 1 << 20, d)], object)
        for _ in range(ROUNDS):
            x = v[order].copy()
            for k in range(1, d):
                x[k] -= int((a[k, :k] * x[:k]).sum()) >> bits
            for k in range(d - 1, -1, -1):
                x[k] = ((x[k] - (int((a[k, k + 1 :] * x[k + 1 :]).sum()) >> bits)) << bits) // a[k, k]
            for w in found:
                x -= (w * (int((w * x).sum()) >> bits)) >> bits
            v = _unit(x, bits)
            for w in found:
                v -= (w * (int((w * v).sum()) >> bits)) >> bits
            v = _unit(v, bits)
        found.append(v)
    return np.array([[float(Fraction(int(x), 1 << (POINT_BITS + ROOT_BITS))) for x in v] for v in found]).reshape(len(found), d)
