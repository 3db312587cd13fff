"""Isotonic calibration from binned counts."""

from __future__ import annotations

import numpy as np


def isotonic_blocks(value: np.ndarray, n: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ascending bins: block centres and their shares of positives.

    Each share is drawn a little to the overall share (one row's weight), so no
    block is certain.
    """
    if not len(value):
        return np.zeros(1), np.zeros(1)
    overall = positive.sum() / n.sum()
    blocks: list[list[float]] = []  # weight, positives, sum of values
    for v, k, p in zip(value, n, positive):
        blocks.append([k, p, v * k])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            k2, p2, s2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + k2, blocks[-1][1] + p2, blocks[-1][2] + s2]
    centres = np.array([s / k for k, _, s in blocks])
    chances = np.array([(p + overall) / (k + 1) for k, p, _ in blocks])
    return centres, np.maximum.accumulate(chances)


def calibrate(value: np.ndarray, centres: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Probability of each value, between the blocks by straight lines."""
    return np.clip(np.interp(np.asarray(value, dtype=float), centres, chances), 0.0, 1.0)
