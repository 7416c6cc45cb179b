"""Exact eigenvalues and accurate eigenvectors of a positive semidefinite matrix of whole numbers.

The characteristic polynomial is found modulo many primes (Hessenberg form, then a
recurrence) and put together by Chinese remainders. All its roots are real, so the number
of roots above a point is exactly the number of sign changes of the polynomial shifted to
that point; halving isolates each root, with its multiplicity, in exact arithmetic.
Vectors come from inverse iteration in whole-number fixed point at a shift so close to the
root that the solution lies in the null space to more than double precision.

Nothing here knows Spark: a residue, a root and a vector are each the work of one small task.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb, isqrt

import numpy as np

#: Bits of accuracy asked of vectors; a double holds 53.
VECTOR_BITS = 64
#: Roots whose distance is below the trace over 2 to this power are one multiple root.
CLUSTER_BITS = 192


def _is_prime(n: int) -> bool:
    """Miller-Rabin; these bases decide every number of 32 bits."""
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for base in (2, 3, 5, 7):
        x = pow(base, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes just under 2^31, largest first, whose product is beyond ``bound``."""
    found, product, n = [], 1, (1 << 31) - 1
    while product <= bound:
        if _is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def coefficient_bound(size: int, trace: int) -> int:
    """No coefficient is larger: eigenvalues are not negative, so their symmetric sums are largest when all are equal."""
    return max([1] + [comb(size, k) * trace ** k // size ** k + 1 for k in range(1, size + 1)])


def residue(matrix: np.ndarray, prime: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo ``prime``, lowest power first; ``matrix`` is reduced already."""
    h, size, p = matrix.astype(np.int64) % prime, len(matrix), prime
    for k in range(1, size - 1):
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        swap = k + int(below[0])
        if swap != k:
            h[[k, swap]] = h[[swap, k]]
            h[:, [k, swap]] = h[:, [swap, k]]
        factor = h[k + 1:, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1:] = (h[k + 1:] - factor[:, None] * h[k] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1:] * factor % p).sum(axis=1)) % p
    rows = np.zeros((size + 1, size + 1), np.int64)
    rows[0, 0] = 1
    for m in range(1, size + 1):
        row = -h[m - 1, m - 1] * rows[m - 1] % p
        row[1:] += rows[m - 1, :-1]
        below = 1
        for i in range(m - 1, 0, -1):
            below = below * int(h[i, i - 1]) % p
            if not below:
                break
            row -= below * int(h[i - 1, m - 1]) % p * rows[i - 1] % p
        rows[m] = row % p
    return rows[size]


def combine(residues: list[tuple[int, list[int]]]) -> list[int]:
    """The whole numbers of least size with these residues, one list per prime."""
    product = 1
    for prime, _ in residues:
        product *= prime
    total = [0] * len(residues[0][1])
    for prime, values in residues:
        rest = product // prime
        rest *= pow(rest % prime, -1, prime)
        total = [t + v * rest for t, v in zip(total, values)]
    half = product // 2
    return [(t + half) % product - half for t in total]


def _shifted(coefficients: list[int], point: int, scale: int) -> list[int]:
    """Coefficients of 2^(scale * degree) p((x + point) / 2^scale)."""
    size = len(coefficients) - 1
    out = [c << (scale * (size - k)) for k, c in enumerate(coefficients)]
    for first in range(size):
        for k in range(size - 1, first - 1, -1):
            out[k] += point * out[k + 1]
    return out


def roots_above(coefficients: list[int], point: int, scale: int = 0) -> int:
    """How many roots, with multiplicity, are above point / 2^scale; exact as all roots are real."""
    signs = [c > 0 for c in _shifted(coefficients, point, scale) if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(coefficients: list[int], point: int, scale: int) -> int:
    value = 0
    for k in range(len(coefficients) - 1, -1, -1):
        value = value * point + (coefficients[k] << (scale * (len(coefficients) - 1 - k)))
    return (value > 0) - (value < 0)


@dataclass(frozen=True)
class Root:
    """``times`` roots within (low, low + 1] / 2^scale; ``gap_bits``: the nearest other root is at least 2^-gap_bits of the trace away."""

    low: int
    scale: int
    times: int
    gap_bits: int

    def value(self, scale: int) -> int:
        """The middle of the interval times 2^scale."""
        return ((2 * self.low + 1) << scale) >> (self.scale + 1)


def top_roots(coefficients: list[int], trace: int, wanted: int) -> list[Root]:
    """The largest positive roots, falling, until ``wanted`` with multiplicity are found or none is left."""
    width = trace.bit_length()  # all roots lie in [0, 2^width]
    open_intervals = [(0, 0, width, roots_above(coefficients, 0), 0)]  # low * 2^width / 2^level: low, level, width, roots inside, above
    isolated: list[tuple[int, int, int]] = []
    found = 0
    while open_intervals and found < wanted:
        low, level, _, inside, above = open_intervals.pop()
        if not inside:
            continue
        if inside == 1 and level >= 4 or level >= CLUSTER_BITS:
            isolated.append((low, level, inside))
            found += inside
            continue
        scale = max(0, level + 1 - width)
        middle = (2 * low + 1) << max(0, width - level - 1)
        upper = roots_above(coefficients, middle, scale) - above
        open_intervals.append((2 * low, level + 1, width, inside - upper, above + upper))
        open_intervals.append((2 * low + 1, level + 1, width, upper, above))
    roots = []
    for low, level, times in isolated:
        gap = _gap_bits(coefficients, low, level, width, times)
        roots.append(_refined(coefficients, low, level, width, times, max(width, gap + VECTOR_BITS + 32), gap))
    return roots


def _counts_in(coefficients: list[int], low: int, high: int, level: int, width: int) -> int:
    scale, lift = max(0, level - width), max(0, width - level)
    return roots_above(coefficients, low << lift, scale) - roots_above(coefficients, high << lift, scale)


def _gap_bits(coefficients: list[int], low: int, level: int, width: int, times: int) -> int:
    """Narrow the interval until no other root lies within its own width on either side."""
    while level < CLUSTER_BITS and _counts_in(coefficients, low - 1, low + 2, level, width) > times:
        low, level = 2 * low, level + 1
        low += _counts_in(coefficients, low + 1, low + 2, level, width) == times
    return level + 1


def _refined(coefficients: list[int], low: int, level: int, width: int, times: int, want: int, gap: int) -> Root:
    """Halve to ``want`` levels; a simple root by signs of the polynomial, a multiple one by signs of its derivative of order times - 1."""
    for _ in range(times - 1):  # exactly one root of this derivative lies between the outer roots of the cluster
        coefficients = [k * c for k, c in enumerate(coefficients)][1:]
    end = _sign(coefficients, (low + 1) << max(0, width - level), max(0, level - width))
    while level < want:
        level += 1
        sign = _sign(coefficients, (2 * low + 1) << max(0, width - level), max(0, level - width))
        if sign == 0 or sign == end:  # the root is at the middle or below
            low, end = 2 * low, sign
        else:
            low = 2 * low + 1
    return Root(low, level - width, times, gap)


def null_vectors(matrix: list[list[int]], root: Root, trace: int, rounds: int = 2) -> np.ndarray:
    """``root.times`` orthonormal rows: the null space of ``matrix - root``, by inverse iteration in fixed point.

    Starting values are a fixed rule of row and column. The sign makes the entry of largest size positive.
    """
    size, bits = len(matrix), VECTOR_BITS + 2 * root.gap_bits + 64
    digits = trace.bit_length()
    # one unit is the trace: entries are at most one in size
    a = np.array([[(v << bits) >> digits if v >= 0 else -((-v << bits) >> digits) for v in row] for row in matrix], object)
    shift = root.value(bits) >> digits
    for k in range(size):
        a[k, k] -= shift
    order = np.arange(size)
    factors = np.zeros((size, size), object)
    for k in range(size):
        pivot = k + int(np.argmax(np.abs(a[k:, k])))
        if pivot != k:
            a[[k, pivot]], factors[[k, pivot]], order[[k, pivot]] = a[[pivot, k]], factors[[pivot, k]], order[[pivot, k]]
        if a[k, k] == 0:
            a[k, k] = 1
        factor = (a[k + 1:, k] << bits) // a[k, k]
        factors[k + 1:, k] = factor
        a[k + 1:, k:] -= (factor[:, None] * a[k, k:]) >> bits
    x = np.array([[((7 * r + 3) * (11 * c + 5) % 61 + 1) << bits for c in range(root.times)] for r in range(size)], object)
    for _ in range(rounds):
        x = x[order]
        for k in range(size - 1):
            x[k + 1:] -= (factors[k + 1:, k][:, None] * x[k]) >> bits
        for k in range(size - 1, -1, -1):
            x[k] = (x[k] << bits) // a[k, k]
            if k:
                x[:k] -= (a[:k, k][:, None] * x[k]) >> bits
        x = _orthonormal(x, bits)
    out = np.array([[v / (1 << bits) for v in column] for column in x.T])
    largest = out[np.arange(len(out)), np.abs(out).argmax(axis=1)]
    return out * np.where(largest < 0, -1.0, 1.0)[:, None]


def _orthonormal(x: np.ndarray, bits: int) -> np.ndarray:
    """Gram-Schmidt, twice, on columns in fixed point."""
    out = x.copy()
    for c in range(out.shape[1]):
        top = max(1, max(abs(v) for v in out[:, c]))
        out[:, c] = (out[:, c] << bits) // top
        for _ in range(2):
            for before in range(c):
                out[:, c] -= (out[:, before] * (int((out[:, before] * out[:, c]).sum()) >> bits)) >> bits
            norm = max(1, isqrt(int((out[:, c] * out[:, c]).sum())))
            out[:, c] = (out[:, c] << bits) // norm
    return out
