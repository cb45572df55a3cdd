"""A volume (height, width, depth) as one picture: which slices are shown, and how. numpy only."""

from __future__ import annotations

import numpy as np

from ozalid.functions import enhance, pixels

#: How many slices are shown, their least distance as a share of the depth, the most that are scored, fixed depths.
SHOWN, LEAST_GAP, MOST_SCORED, DEPTHS, EDGE_WEIGHT = 3, 0.10, 128, (0.35, 0.50, 0.65), 1.0
# Cell and border of the channel grid, its colour, and where each channel lies.
CELL, BORDER, EMPTY = 448, 4, 40
QUADRANTS = {"blue": (0, 0), "green": (0, 1), "red": (1, 0), "yellow": (1, 1)}


def windowed(planes: list[np.ndarray]) -> list[np.ndarray]:
    """Bytes of several planes by one common window."""
    return list(enhance.stretch(np.stack(planes)))


def scaled(x: np.ndarray) -> np.ndarray:
    span = x.max() - x.min()
    return (x - x.min()) / span if span > 1e-6 else np.zeros_like(x)


def slice_scores(volume: np.ndarray, indexes: list[int]) -> np.ndarray:
    """Variance and mean gradient of each slice, both scaled to 0..1 and added."""
    shown = windowed([volume[..., i] for i in indexes])
    variance = np.array([p.astype(np.float64).var() for p in shown])
    edges = np.array([pixels.gradient(p).mean() for p in shown])
    return scaled(variance) + EDGE_WEIGHT * scaled(edges)


def spread_out(ranked: list[int], depth: int, k: int) -> list[int]:
    """The first k of a ranking that lie max(1, round(0.1 * depth)) apart; then, if they are too few, the best others."""
    gap = max(1, round(LEAST_GAP * depth))
    near: list[int] = []
    taken: list[int] = []
    for i in ranked:
        (taken if len(taken) < k and all(abs(i - t) >= gap for t in taken) else near).append(i)
    return sorted((taken + near)[:k])


def best_slices(volume: np.ndarray, k: int = SHOWN) -> list[int]:
    depth = volume.shape[-1]
    if depth <= k:
        return list(range(depth))
    indexes = list(range(0, depth, 1 if depth <= MOST_SCORED else depth // MOST_SCORED))
    scores = slice_scores(volume, indexes)
    order = sorted(range(len(indexes)), key=lambda i: (-scores[i], indexes[i]))
    return spread_out([indexes[i] for i in order], depth, k)


def fixed_slices(depth: int) -> list[int]:
    return [min(max(round(f * (depth - 1)), 0), depth - 1) for f in DEPTHS]


def strip_of(volume: np.ndarray, indexes: list[int]) -> np.ndarray:
    """The slices side by side as RGB, in one window."""
    row = np.concatenate(windowed([volume[..., i] for i in indexes]), axis=1)
    return np.repeat(row[..., None], 3, axis=2)


def representative(volume: np.ndarray) -> np.ndarray:
    """The picture of a volume. Where a way fails the next is tried: best slices, fixed depths, the middle one of these,
    the middle slice."""
    depth = volume.shape[-1]
    if depth == 0:
        raise ValueError("the volume has no slices")
    ways = (lambda: best_slices(volume), lambda: fixed_slices(depth), lambda: fixed_slices(depth)[1:2], lambda: [depth // 2])
    failure: Exception | None = None
    for way in ways:
        try:
            return strip_of(volume, way())
        except Exception as e:  # noqa: BLE001 - any failure of a way means the next one
            failure = e
    raise ValueError("no slice can be shown") from failure


def channel_grid(channels: dict[str, np.ndarray]) -> np.ndarray:
    """Up to four channel images in fixed quadrants; what is missing stays dark gray."""
    side = 2 * CELL + 3 * BORDER
    grid = np.full((side, side, 3), EMPTY, np.uint8)
    for name, (row, column) in QUADRANTS.items():
        if name in channels:
            y, x = BORDER + row * (CELL + BORDER), BORDER + column * (CELL + BORDER)
            grid[y : y + CELL, x : x + CELL] = pixels.resize(enhance.to_rgb(channels[name]), CELL, CELL, how="lanczos")
    return grid
