"""Pixel arrays: colour spaces, neighbourhoods, resampling, morphology, filling. numpy only, no Spark.

Borders mirror without repeating the edge. Bytes are rounded to nearest, as image libraries do, unless stated.
"""

from __future__ import annotations

import heapq

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view


def gray(rgb: np.ndarray) -> np.ndarray:
    """Luma in 14-bit fixed point: 0.299, 0.587, 0.114."""
    r, g, b = (rgb[..., i].astype(np.int64) for i in range(3))
    return ((4899 * r + 9617 * g + 1868 * b + 8192) >> 14).astype(np.uint8)


def hsv(rgb: np.ndarray) -> np.ndarray:
    """Hue in 0..179 (two degrees each), saturation and value in 0..255."""
    c = rgb.astype(np.float64)
    top, low = c.max(axis=-1), c.min(axis=-1)
    span = top - low
    safe = np.where(span == 0, 1.0, span)
    r, g, b = c[..., 0], c[..., 1], c[..., 2]
    sector = np.select([top == r, top == g], [(g - b) / safe, 2 + (b - r) / safe], 4 + (r - g) / safe)
    hue = np.where(span == 0, 0.0, (sector * 60) % 360) / 2
    saturation = np.where(top == 0, 0.0, span / np.where(top == 0, 1.0, top) * 255)
    return np.stack([np.rint(hue) % 180, np.rint(saturation), top], axis=-1).astype(np.uint8)


def _neighbours(plane: np.ndarray) -> np.ndarray:
    mode = "reflect" if min(plane.shape) > 1 else "edge"
    return sliding_window_view(np.pad(plane.astype(np.float64), 1, mode=mode), (3, 3))


def convolve3(plane: np.ndarray, kernel: list[list[float]]) -> np.ndarray:
    return np.einsum("ijkl,kl->ij", _neighbours(plane), np.asarray(kernel, float))


def laplacian(plane: np.ndarray) -> np.ndarray:
    return convolve3(plane, [[2, 0, 2], [0, -8, 0], [2, 0, 2]])


def gradient(plane: np.ndarray) -> np.ndarray:
    """Sobel magnitude."""
    x = convolve3(plane, [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    y = convolve3(plane, [[-1, -2, -1], [0, 0, 0], [1, 2, 1]])
    return np.hypot(x, y)


# -- resampling ------------------------------------------------------------------------------------------------------


def _area_weights(old: int, new: int) -> np.ndarray:
    """Share of each old cell in each new one when shrinking; linear interpolation of centres when growing."""
    w = np.zeros((new, old))
    scale = old / new
    if new <= old:
        for i in range(new):
            a, b = i * scale, (i + 1) * scale
            for j in range(int(a), min(old, int(np.ceil(b)))):
                w[i, j] = max(0.0, min(b, j + 1) - max(a, j))
    else:
        at = np.clip((np.arange(new) + 0.5) * scale - 0.5, 0, old - 1)
        left = np.floor(at).astype(int)
        right = np.minimum(left + 1, old - 1)
        w[np.arange(new), left] += 1 - (at - left)
        w[np.arange(new), right] += at - left
    return w / w.sum(axis=1, keepdims=True)


def _lanczos_weights(old: int, new: int, lobes: int = 3) -> np.ndarray:
    """Windowed sinc, widened when shrinking so that nothing aliases."""
    scale = max(1.0, old / new)
    centre = (np.arange(new) + 0.5) * old / new
    x = (np.arange(old)[None, :] + 0.5 - centre[:, None]) / scale
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resize(image: np.ndarray, height: int, width: int, how: str = "area") -> np.ndarray:
    """image (2-D or with channels last) at a new size by 'area' or 'lanczos'."""
    weights = _area_weights if how == "area" else _lanczos_weights
    if image.shape[:2] == (height, width):
        return image
    out = np.tensordot(weights(image.shape[0], height), image.astype(np.float64), axes=(1, 0))
    out = np.moveaxis(np.tensordot(weights(image.shape[1], width), out, axes=(1, 1)), 0, 1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


#: Least and most pixels of an image before it is looked at.
LEAST_PIXELS, MOST_PIXELS = 256 * 256, 1024 * 1024


def bounded_size(height: int, width: int) -> tuple[int, int]:
    """The size scaled into the pixel budget, growing included; each side at least 1."""
    n = height * width
    if n == 0 or LEAST_PIXELS <= n <= MOST_PIXELS:
        return height, width
    s = ((MOST_PIXELS if n > MOST_PIXELS else LEAST_PIXELS) / n) ** 0.5
    return max(1, round(height * s)), max(1, round(width * s))


def padded(image: np.ndarray, size: int) -> np.ndarray:
    """image as large as fits into a black square, its shape kept, centred."""
    h, w = image.shape[:2]
    s = min(size / w, size / h)
    nh, nw = max(1, round(h * s)), max(1, round(w * s))
    canvas = np.zeros((size, size, *image.shape[2:]), image.dtype)
    y, x = (size - nh) // 2, (size - nw) // 2
    canvas[y : y + nh, x : x + nw] = resize(image, nh, nw)
    return canvas


# -- morphology and filling ------------------------------------------------------------------------------------------


def disc(size: int) -> np.ndarray:
    """An elliptical structuring element."""
    r = size // 2
    rows = np.arange(-r, r + 1)
    reach = np.rint(r * np.sqrt(np.maximum(0.0, 1 - (rows / max(r, 1)) ** 2))).astype(int)
    return np.abs(rows)[None, :] <= reach[:, None]


def _spread(plane: np.ndarray, element: np.ndarray, pick, fill: float) -> np.ndarray:
    r = element.shape[0] // 2
    windows = sliding_window_view(np.pad(plane, r, constant_values=fill), element.shape)
    return pick(windows[..., element], axis=-1)


def dilate(plane: np.ndarray, element: np.ndarray) -> np.ndarray:
    return _spread(plane, element, np.max, 0)


def erode(plane: np.ndarray, element: np.ndarray) -> np.ndarray:
    return _spread(plane, element, np.min, 255)


def black_hat(plane: np.ndarray, size: int) -> np.ndarray:
    """What closing by a disc adds: thin dark things."""
    closed = erode(dilate(plane, disc(size)), disc(size))
    return closed.astype(np.int16) - plane


def fill_in(rgb: np.ndarray, mask: np.ndarray, radius: int = 3) -> np.ndarray:
    """Masked pixels from the outside in, each the weighted mean of known ones within radius: near and already deep
    ones weigh more. A fast-marching order; behaves like Telea's filling, not bit by bit."""
    out, known = rgb.astype(np.float64).copy(), ~mask.astype(bool)
    if known.all() or not known.any():
        return rgb
    h, w = known.shape
    time = np.where(known, 0.0, np.inf)
    heap = []

    def touch(y: int, x: int, t: float) -> None:
        for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)):
            v, u = y + dy, x + dx
            if 0 <= v < h and 0 <= u < w and not known[v, u] and t + 1 < time[v, u]:
                time[v, u] = t + 1
                heapq.heappush(heap, (t + 1, v, u))

    edge = known & (dilate((~known).astype(np.uint8), np.ones((3, 3), bool)) > 0)
    for y, x in zip(*np.nonzero(edge), strict=True):
        touch(int(y), int(x), 0.0)
    while heap:
        t, y, x = heapq.heappop(heap)
        if known[y, x]:
            continue
        y0, y1, x0, x1 = max(0, y - radius), min(h, y + radius + 1), max(0, x - radius), min(w, x + radius + 1)
        ys, xs = np.mgrid[y0:y1, x0:x1]
        far = np.hypot(ys - y, xs - x)
        good = known[y0:y1, x0:x1] & (far <= radius) & (far > 0)
        if good.any():
            weight = 1.0 / (far[good] ** 2 * (1 + np.abs(time[y0:y1, x0:x1][good] - t)))
            out[y, x] = (out[y0:y1, x0:x1][good] * weight[:, None]).sum(axis=0) / weight.sum()
        known[y, x] = True
        touch(y, x, t)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)
