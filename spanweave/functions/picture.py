"""Pixel work on small grey pictures (arrays of numbers in rows): smoothing, masked change, opening."""

from __future__ import annotations

import numpy as np


def smooth(picture: np.ndarray, radius: int = 2) -> np.ndarray:
    """Gaussian smoothing by a binomial kernel of 2 radius + 1 (edges mirrored)."""
    kernel = np.ones(1)
    for _ in range(2 * radius):
        kernel = np.convolve(kernel, [0.5, 0.5])
    out = np.pad(picture.astype(float), radius, mode="reflect")
    for axis in (0, 1):
        out = np.apply_along_axis(lambda line: np.convolve(line, kernel, mode="valid"), axis, out)
    return out


def _spread(mask: np.ndarray, take) -> np.ndarray:
    padded = np.pad(mask, 1, constant_values=take is np.minimum)
    high, wide = mask.shape
    out = padded[1:-1, 1:-1]
    for dy in range(3):
        for dx in range(3):
            out = take(out, padded[dy : dy + high, dx : dx + wide])
    return out


def opened(mask: np.ndarray) -> np.ndarray:
    """Morphological opening with a 3 x 3 square: specks smaller than it go."""
    return _spread(_spread(mask, np.minimum), np.maximum)


def change_ratio(before: np.ndarray, after: np.ndarray, court: np.ndarray, threshold: float) -> float:
    """The share of the court's pixels that changed by more than ``threshold`` after smoothing, without specks."""
    changed = opened(np.abs(smooth(after) - smooth(before)) > threshold)
    inside = court.sum()
    return float((changed & court).sum() / inside) if inside else 0.0
