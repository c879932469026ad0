"""Polar angles, sign sketches, radii modes, scalar grids and block codebooks, as expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vec import dot, total

PI2 = 2 * math.pi
F32_MIN = 1.1754943508222875e-38  # least positive normal f32
F32_EPS = 1.1920928955078125e-07


def _pairs(x: Column, f) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(x) - 1, F.lit(2)), lambda i: f(F.element_at(x, i), F.element_at(x, i + 1)))


def radii(x: Column) -> Column:
    return _pairs(x, lambda a, b: F.sqrt(a * a + b * b))


def angles(x: Column, bits: int) -> Column:
    """floor((atan2 + pi) / 2 pi 2^bits) mod 2^bits for each pair."""
    n = 1 << bits
    return _pairs(x, lambda a, b: F.pmod(F.floor(F.round((F.atan2(b, a) + math.pi) / PI2 * n, 12)).cast("int"), F.lit(n)))


def polar_decode(r: Column, k: Column, bits: int) -> Column:
    """Rotated vector at the lower edge of each angle bin."""
    n = 1 << bits
    both = F.zip_with(r, k, lambda a, i: F.array(a * F.cos(i / n * PI2 - math.pi), a * F.sin(i / n * PI2 - math.pi)))
    return F.flatten(both)


def polar_score(q: Column, r: Column, k: Column, bits: int) -> Column:
    """Inner product of a rotated query with a code, without decoding to a vector."""
    return dot(q, polar_decode(r, k, bits))


def polar_l2(q: Column, r: Column, score: Column) -> Column:
    return F.greatest(F.lit(0.0), dot(q, q) + dot(r, r) - 2 * score)


def projections(rows: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((rows, dim)).round(6)


def signs(p: Column) -> Column:
    return F.transform(p, lambda x: F.when(x >= 0, 1).otherwise(-1))


def qjl_score(sign: Column, p: Column, norm: Column | float) -> Column:
    """sqrt(pi/2) / m times the projected query over the signs, scaled by the source norm."""
    return math.sqrt(math.pi / 2) * F.lit(norm) * total(F.zip_with(sign, p, lambda s, x: s * x)) / F.size(p)


def half_away(x: Column) -> Column:
    return F.floor(F.abs(x) + 0.5) * F.signum(x)


def radii_u16(r: Column) -> Column:
    low, span = F.array_min(r), F.greatest(F.array_max(r) - F.array_min(r), F.lit(F32_EPS))
    return F.transform(r, lambda x: half_away((x - low) / span * 65535).cast("int"))


def radii_u16_decode(k: Column, low: Column, high: Column) -> Column:
    return F.transform(k, lambda i: low + i / 65535.0 * (high - low))


def radii_u8(r: Column) -> Column:
    logs = F.transform(r, lambda x: F.log(F.greatest(x, F.lit(F32_MIN))))
    low = F.array_min(logs)
    span = F.greatest(F.array_max(logs) - low, F.lit(F32_EPS))
    return F.transform(logs, lambda x: half_away((x - low) / span * 255).cast("int"))


def radii_u8_decode(k: Column, low: Column, high: Column) -> Column:
    """low and high are logarithms."""
    return F.transform(k, lambda i: F.exp(low + i / 255.0 * (high - low)))


def scalar_code(x: Column, low: float, high: float, levels: int) -> Column:
    clamped = F.least(F.greatest(x, F.lit(low)), F.lit(high))
    return F.least(F.floor(F.round((clamped - low) / (high - low) * levels, 9)), F.lit(levels - 1)).cast("int")


def scalar_value(k: Column, low: float, high: float, levels: int) -> Column:
    return low + (k + 0.5) * ((high - low) / levels)


def blocks(x: Column, k: int) -> Column:
    """The vector cut into blocks of k."""
    return F.transform(F.sequence(F.lit(1), F.size(x), F.lit(k)), lambda i: F.slice(x, i, k))


def nearest(block: Column, book: list[list[float]]) -> Column:
    """struct(d, i) of the nearest codeword; the least index wins ties."""
    ds = [F.struct(total(F.zip_with(block, F.array(*map(F.lit, w)), lambda a, b: (a - b) * (a - b))).alias("d"), F.lit(i).alias("i")) for i, w in enumerate(book)]
    return F.array_min(F.array(*ds))


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x > 0)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 400):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + term * d or tiny), 1 + term / c or tiny
            f *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * f


def beta_inv(q: float, a: float, b: float) -> float:
    """Inverse of beta_cdf by bisection."""
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(mid, a, b) < q else (low, mid)
    return (low + high) / 2


def beta_shape(dim: int, k: int) -> float:
    """Second shape of the companded law of a block's squared radius; 1 if the block is the vector."""
    if not 0 < k <= dim:
        raise ValueError("a block is 1 to dim long")
    return 1.0 if k == dim else k / (k + 2) * (dim - k - 2) / 2 + 1


def radius_quantile(dim: int, k: int, n: int, total: int) -> float:
    """Radius of codeword n of 1..total: the middle of its share of the law."""
    if not 1 <= n <= total:
        raise ValueError("codewords count from 1")
    q = (n - 0.5) / total
    if k == dim:
        return 1.0
    if k == 2:
        return math.sqrt(1 - (1 - q) ** (4 / dim))
    return math.sqrt(beta_inv(q, k / 2, beta_shape(dim, k)))


def directions(k: int, n: int) -> list[list[float]]:
    """n unit directions: golden angle for k = 2, Fibonacci sphere for 3, else Roberts-Kronecker points."""
    from statistics import NormalDist

    turn = 1 - 2 / (1 + 5**0.5)
    if k == 2:
        return [[math.cos(PI2 * i * turn), math.sin(PI2 * i * turn)] for i in range(n)]
    if k == 3:
        heights = [1 - (2 * i + 1) / n for i in range(n)]
        flat = [math.sqrt(max(0.0, 1 - z * z)) for z in heights]
        return [[r * math.cos(PI2 * i * turn), r * math.sin(PI2 * i * turn), z] for i, (r, z) in enumerate(zip(flat, heights, strict=True))]
    root = 1.5
    for _ in range(200):  # the root of x^(k+1) = x + 1
        root = (1 + root) ** (1 / (k + 1))
    out = []
    for i in range(n):
        u = [math.fmod((i + 0.5) * root ** -(j + 1), 1) for j in range(k)]
        g = [NormalDist().inv_cdf(min(max(x, 1e-12), 1 - 1e-12)) for x in u]
        size = math.sqrt(sum(x * x for x in g))
        out.append([x / size for x in g])
    return out


def initial_codebook(dim: int, k: int, n: int) -> list[list[float]]:
    """Start codebook for blocks of k of unit vectors of dim: radius times direction, to six places."""
    radii = [radius_quantile(dim, k, i + 1, n) for i in range(n)]
    return [[round(r * x, 6) for x in d] for r, d in zip(radii, directions(k, n), strict=True)]


def spherical_samples(n: int, dim: int, k: int, seed: int, project: bool = False) -> np.ndarray:
    """Blocks of k of random unit vectors of dim: by the radius law, or by projecting whole vectors."""
    rng = np.random.default_rng(seed)
    if project:
        x = rng.standard_normal((n, dim))
        return (x / np.linalg.norm(x, axis=1)[:, None])[:, :k]
    x = rng.standard_normal((n, k))
    radius = np.sqrt(rng.beta(k / 2, (dim - k) / 2, n)) if k < dim else np.ones(n)
    return x / np.linalg.norm(x, axis=1)[:, None] * radius[:, None]


# Centroids of a standard normal for so many levels.
GAUSSIAN_CENTROIDS = {
    4: (-1.510, -0.453, 0.453, 1.510),
    8: (-2.152, -1.344, -0.756, -0.245, 0.245, 0.756, 1.344, 2.152),
    16: (-2.637, -2.028, -1.579, -1.212, -0.891, -0.599, -0.327, -0.067, 0.067, 0.327, 0.599, 0.891, 1.212, 1.579, 2.028, 2.637),
}


def gaussian_centroids(levels: int) -> tuple[float, ...]:
    """The fixed ones, or the middles of equal shares of the normal law."""
    from statistics import NormalDist

    if levels < 2:
        raise ValueError("two levels at least")
    return GAUSSIAN_CENTROIDS.get(levels) or tuple(round(NormalDist().inv_cdf((i + 0.5) / levels), 6) for i in range(levels))


def scalar_blocks(x: Column, k: int, levels: int) -> Column:
    """array of (norm, levels): each block's norm and the nearest centroid of each scaled value; norm 0 gives level 0."""
    book = gaussian_centroids(levels)

    def level(v: Column) -> Column:
        gaps = F.array(*[F.struct(F.round(F.abs(v - c), 9).alias("gap"), F.lit(i).alias("i")) for i, c in enumerate(book)])
        return F.array_min(gaps)["i"]

    def one(block: Column) -> Column:
        size = F.sqrt(dot(block, block))
        return F.struct(size.alias("norm"), F.transform(block, lambda v: F.when(size > 1e-10, level(v / size)).otherwise(0)).alias("levels"))

    return F.transform(blocks(x, k), one)


def scalar_blocks_decode(coded: Column, levels: int) -> Column:
    book = F.array(*map(F.lit, gaussian_centroids(levels)))
    return F.flatten(F.transform(coded, lambda b: F.transform(b["levels"], lambda i: F.get(book, i) * b["norm"])))


def bits_for(n: int) -> int:
    return max(1, (n - 1).bit_length())


def fb2_bytes(n: int, d: int, k: int = 4, words: int = 32) -> int:
    return 19 + n * (2 + -(-(d // k) * bits_for(words) // 8))


def fb1_bytes(n: int, d: int, k: int = 4, words: int = 32) -> int:
    return n * (11 + 2 + -(-(d // k) * bits_for(words) // 8))


def turbo_payload(d: int, bits: int, projections: int, lossy: bool = False) -> int:
    r = d // 2 + 8 if lossy else 4 * (d // 2)
    return r + -(-(d // 2) * (bits - 1) // 8) + -(-projections // 8)


def tqb1_bytes(n: int, d: int, bits: int, projections: int, lossy: bool = False) -> int:
    return 38 + n * turbo_payload(d, bits, projections, lossy)


def tqw1_bytes(d: int, bits: int, projections: int) -> int:
    return 46 + turbo_payload(d, bits, projections)
