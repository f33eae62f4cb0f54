"""Exact integer matrix products in a residue number system; numpy.

Integers are held as their remainders by several small primes, centred around zero. A float32 product of such
remainders is exact as long as its sums stay below 2**24, so the fast float32 matrix product does the work, once for
each prime; the Chinese remainder theorem makes signed 64-bit scores of the remainders of the products.
"""

from __future__ import annotations

import numpy as np

COLUMNS = 64  # summed at once: COLUMNS * (prime / 2)**2 must stay below 2**24
LARGEST = 1023  # 64 * 511**2 < 2**24
MAX_SCORE = 9 * 10**16  # times 100 still a 64-bit integer


def primes_for(bound: int) -> list[int]:
    """The fewest primes, from the largest usable one down, whose product tells all of -bound ... bound apart."""
    if bound > MAX_SCORE:
        raise ValueError(f"scores of up to {bound} are beyond the {MAX_SCORE} that windows can be computed for")
    primes, product, n = [], 1, LARGEST
    while product <= 2 * bound + 1:
        if all(n % k for k in range(2, int(n**0.5) + 1)):
            primes.append(n)
            product *= n
        n -= 1
    return primes


def split(values: np.ndarray, primes: list[int]) -> np.ndarray:
    """``[prime, row, column]``: centred remainders as float32."""
    out = np.empty((len(primes), *values.shape), np.float32)
    for k, prime in enumerate(primes):
        rest = values % prime
        out[k] = rest - prime * (rest > prime // 2)
    return out


def product(a: np.ndarray, b: np.ndarray, primes: list[int]) -> np.ndarray:
    """Inner products of the rows of two split matrices, as exact signed 64-bit integers."""
    value = np.zeros((a.shape[1], b.shape[1]), np.int64)
    modulus = 1
    for k, prime in enumerate(primes):
        rest = np.zeros(value.shape, np.int64)
        for at in range(0, a.shape[2], COLUMNS):
            rest += (a[k, :, at : at + COLUMNS] @ b[k, :, at : at + COLUMNS].T).astype(np.int64)
        # Mixed radix: the digit that makes the value so far agree with this prime too.
        digit = (rest - value) % prime
        if modulus > 1:
            digit = digit * pow(modulus, -1, prime) % prime
        value += digit * modulus
        modulus *= prime
    value[value > modulus // 2] -= modulus
    return value
