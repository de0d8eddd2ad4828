"""Exact integer matrix products in a residue number system.

Components are taken modulo several primes below 1024, centred on zero, and multiplied in float32: 64 products of two such residues
sum to less than 2**24, so every partial product is exact. Balanced mixed-radix digits (Chinese remaindering) put the residues
together; as all digits are centred, the sum is the signed score itself, and no intermediate leaves 64 bits. The number of
primes follows from the bound |a| |b| on the scores.
"""

from __future__ import annotations

import numpy as np

#: Scores below this are put together in 64 bits.
LIMIT = float(1 << 62)
EXACT = 1 << 24


def _primes(count: int, below: int = 1024) -> list[int]:
    found: list[int] = []
    for n in range(below - 1, 2, -2):
        if len(found) == count:
            break
        if all(n % k for k in range(3, int(n**0.5) + 1, 2)):
            found.append(n)
    return found


#: Their product is above 2**63, twice the largest bound.
PRIMES = _primes(7)


def centred(values: np.ndarray, prime: int) -> np.ndarray:
    """Residues from -(prime - 1) / 2 to (prime - 1) / 2."""
    half = prime // 2
    return (values + half) % prime - half


def norm_bound(a: np.ndarray, b: np.ndarray) -> float:
    """Above the size of every product of a row of ``a`` with a row of ``b``."""
    longest = [np.sqrt((m.astype(np.float64) ** 2).sum(axis=1)).max(initial=0.0) for m in (a, b)]
    return longest[0] * longest[1] * (1 + 1e-9) + 1


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Every product of a row of ``a`` with a row of ``b``; Python integers where 64 bits may not do."""
    bound = norm_bound(a, b)
    if bound >= LIMIT:
        return a.astype(object) @ b.T.astype(object)
    score = np.zeros((len(a), len(b)), np.int64)
    modulus = 1
    for prime in PRIMES:
        if modulus > 2 * bound:
            break
        left, right = (centred(m, prime).astype(np.float32) for m in (a, b))
        run = EXACT // (prime // 2) ** 2
        rest = np.zeros_like(score)
        for k in range(0, a.shape[1], run):
            rest += (left[:, k : k + run] @ right[:, k : k + run].T).astype(np.int64)
        # the digit that makes the sum so far agree with this prime
        digit = centred((rest - score) % prime * pow(modulus, -1, prime), prime)
        score += modulus * digit
        modulus *= prime
    return score
