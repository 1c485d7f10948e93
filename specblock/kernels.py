"""Constant matrices and weights, made on the driver and used as literals."""

from __future__ import annotations

import numpy as np

# The base quantisation tables of ITU-T T.81, Annex K, row by row.
LUMINANCE = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMINANCE = [
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
]

U, V = np.divmod(np.arange(64), 8)


def dct_matrix(n: int = 8) -> np.ndarray:
    """The orthonormal DCT-II matrix D; a block X has coefficients D X D'."""
    k, i = np.mgrid[0:n, 0:n]
    d = np.cos(np.pi * (2 * i + 1) * k / (2 * n)) * np.sqrt(2 / n)
    d[0] /= np.sqrt(2)
    return d


def quality_scale(quality: int) -> float:
    """The factor that a quality of 1 to 100 puts on a base table."""
    if not 1 <= quality <= 100:
        raise ValueError("quality must lie in 1..100")
    return 50.0 / quality if quality < 50 else (100.0 - quality) / 50.0


def scaled_table(base: list, quality: int) -> list[float]:
    scale = quality_scale(quality)
    return [float(min(255.0, max(1.0, np.floor(t * scale + 0.5)))) for t in base]


def gaussian_envelope(sigma: float) -> np.ndarray:
    """exp(-(u^2 + v^2) / 2 sigma^2): a larger sigma keeps more detail."""
    if sigma <= 0:
        raise ValueError("sigma must be positive")
    return np.exp(-(U**2 + V**2) / (2.0 * sigma**2)).astype(np.float32)


def sharpen_weights(amount: float) -> np.ndarray:
    w = (1 + (amount - 1) * (U**2 + V**2) / 98.0).astype(np.float32)
    w[0] = 1
    return w


def unsharp_weights(sigma: float, amount: float) -> np.ndarray:
    w = (1 + amount * (1 - gaussian_envelope(max(sigma, 0.01)).astype(np.float64))).astype(np.float32)
    w[0] = 1
    return w


def box_weights(radius: int) -> np.ndarray:
    if radius < 1:
        raise ValueError("radius must be at least 1")
    return (np.sinc(U * radius / 8) * np.sinc(V * radius / 8)).astype(np.float32)


def emboss_weights(angle: float) -> np.ndarray:
    a = np.deg2rad(angle)
    w = np.abs((U * np.cos(a) + V * np.sin(a)) / 7).astype(np.float32)
    w[0] = 0
    return w


def _directed(h: np.ndarray, v: np.ndarray, direction: str) -> np.ndarray:
    if direction == "horizontal":
        return h.astype(np.float32)
    if direction == "vertical":
        return v.astype(np.float32)
    if direction == "both":
        return np.sqrt(h**2 + v**2).astype(np.float32)
    raise ValueError("direction must be horizontal, vertical or both")


def sobel_weights(direction: str) -> np.ndarray:
    return _directed(U / 7, V / 7, direction)


def scharr_weights(direction: str) -> np.ndarray:
    return _directed(U / 7 * (1 + 0.5 * np.cos(np.pi * V / 7)), V / 7 * (1 + 0.5 * np.cos(np.pi * U / 7)), direction)


def laplacian_weights() -> np.ndarray:
    return (-(U**2 + V**2) / 98.0).astype(np.float32)


def deblock_weights(strength: float) -> np.ndarray:
    f = np.sqrt((U**2 + V**2) / 98.0)
    return np.where(f > 0.5, np.clip(1 - strength * (f - 0.5) / 0.5, 0, 1), 1).astype(np.float32)


def downscale_sides() -> tuple[np.ndarray, np.ndarray]:
    """L and R: a 2 x 2 group of blocks shrinks to the sum of S_r C S_c', with S L or R by side."""
    d = dct_matrix()
    halve = np.zeros((8, 16))
    halve[np.arange(8), 2 * np.arange(8)] = halve[np.arange(8), 2 * np.arange(8) + 1] = 0.5
    return d @ halve[:, :8] @ d.T, d @ halve[:, 8:] @ d.T


def reflected_gaussian(sigma: float, n: int = 24, truncate: float = 4.0) -> np.ndarray:
    """The n x n matrix of a Gaussian filter whose border reflects (edge samples repeat)."""
    radius = int(truncate * sigma + 0.5)
    x = np.arange(-radius, radius + 1)
    w = np.exp(-0.5 * (x / sigma) ** 2)
    w /= w.sum()
    out = np.zeros((n, n))
    for i in range(n):
        for k, weight in zip(x, w, strict=True):
            at = (i + k) % (2 * n)
            out[i, at if at < n else 2 * n - 1 - at] += weight
    return out


def stencil_sides(sigma: float) -> list[np.ndarray]:
    """A_-1, A_0, A_1: the filtered middle block is the sum of A_a C_ab A_b' over its neighbours."""
    d = dct_matrix()
    g = reflected_gaussian(sigma)[8:16]
    return [d @ g[:, 8 * a : 8 * a + 8] @ d.T for a in range(3)]
