"""Seeded rotations: signed Hadamard and QR, built on the driver, applied by block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42
# The 64-bit linear congruential generator that draws the signs.
LCG_MULTIPLIER = 6364136223846793005
LCG_INCREMENT = 1442695040888963407


def lcg_signs(n: int, seed: int = SEED) -> list[int]:
    signs, state = [], seed
    for _ in range(n):
        state = (state * LCG_MULTIPLIER + LCG_INCREMENT) % (1 << 64)
        signs.append(1 if state >> 32 & 1 else -1)
    return signs


def hadamard(n: int) -> np.ndarray:
    if n & (n - 1):
        raise ValueError("a Hadamard rotation needs a power of two")
    i = np.arange(n)
    return np.where(np.bitwise_count(i[:, None] & i) % 2, -1.0, 1.0) / np.sqrt(n)


def hadamard_rotation(n: int, seed: int = SEED) -> np.ndarray:
    return hadamard(n) * np.array(lcg_signs(n, seed), float)


def qr_rotation(n: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))
    return q * np.sign(np.diag(r))


def rotation(n: int, seed: int = SEED) -> np.ndarray:
    """Hadamard for powers of two, QR otherwise."""
    return qr_rotation(n, seed) if n & (n - 1) else hadamard_rotation(n, seed)


def multiply(matrix: np.ndarray, column: Column | str) -> Column:
    """matrix @ vector for each row, in Arrow blocks."""

    @F.pandas_udf("array<double>")
    def product(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.stack(x.to_numpy()) @ matrix.T))

    return product(column)


def rotate(column: Column | str, n: int = 64, seed: int = SEED) -> Column:
    return multiply(rotation(n, seed), column)


def unrotate(column: Column | str, n: int = 64, seed: int = SEED) -> Column:
    return multiply(rotation(n, seed).T, column)
