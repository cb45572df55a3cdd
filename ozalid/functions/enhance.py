"""Preprocessing of an image by stream and subtype. numpy only; every kernel takes and gives RGB or gray bytes."""

from __future__ import annotations

import numpy as np

from ozalid.functions import features, pixels

# Contrast limits and tiles by radiology subtype; the stain matrix and concentrations aimed at.
CONTRAST = {"xray": (2.5, 8), "mri": (1.5, 8), "ct": (2.0, 16)}
STAINS = np.array([[0.5626, 0.2159], [0.7201, 0.8012], [0.4062, 0.5581]])
CONCENTRATIONS = np.array([1.9705, 1.0308])
#: Side of the finished square, of a tile, and the most pixels that are tiled or stain-normalised as they are.
SIDE, TILE, SLIDE_PIXELS, STAIN_PIXELS = 896, 512, 1536 * 1536, 512 * 512
LETTERBOXED, HAIRY, GLOSSY = ("fundus", "iri"), ("dermoscopy",), ("endoscopy", "colposcopy")
#: Costly steps, off unless asked for.
OPTIONS = {"fill_hair": False, "fill_glare": False, "diffuse": False}


def stretch(plane: np.ndarray, low: float = 0.5, high: float = 99.5) -> np.ndarray:
    """Bytes by the window between two percentiles, cut off after the point; by the whole range if that is empty."""
    a, b = np.percentile(plane, [low, high])
    values = plane.astype(np.float64)
    if b <= a:
        a, b = float(values.min()), float(values.max())
        b = b if b > a else a + 1.0
    return ((np.clip(values, a, b) - a) / (b - a) * 255.0).astype(np.uint8)


def to_rgb(data: np.ndarray) -> np.ndarray:
    """RGB bytes of any decoded image: (h, w), (h, w, 1..4), bytes or wider. Alpha lies over white; wide or real gray is
    stretched by percentiles. RGB bytes come back as they are."""
    image = data[..., 0] if data.ndim == 3 and data.shape[2] == 1 else data
    if image.dtype == np.uint16 and image.ndim == 3:
        image = (image >> 8).astype(np.uint8)
    if image.ndim == 3 and image.shape[2] in (2, 4):
        colour, alpha = image[..., :-1].astype(np.float64), image[..., -1:] / 255.0
        image = np.rint(colour * alpha + 255.0 * (1 - alpha)).astype(np.uint8)
        image = image[..., 0] if image.shape[2] == 1 else image
    if image.ndim == 2:
        plane = image if image.dtype == np.uint8 else stretch(image)
        return np.repeat(plane[..., None], 3, axis=2)
    return image.astype(np.uint8)


def load_stains(path: str) -> np.ndarray:
    """A site's own 3 x 2 stain matrix from a .npy file; the published one if there is none or it has another shape."""
    try:
        found = np.load(path)
    except (OSError, ValueError):
        return STAINS
    return found if found.shape == STAINS.shape else STAINS


def bounded(rgb: np.ndarray) -> np.ndarray:
    return pixels.resize(rgb, *pixels.bounded_size(*rgb.shape[:2]), how="lanczos")


def equalised(plane: np.ndarray, limit: float, tiles: int) -> np.ndarray:
    """Histogram equalisation by tiles with limited contrast; between tile centres the tables blend."""
    h, w = plane.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    mode = "reflect" if min(h, w) > max(th * tiles - h, tw * tiles - w) else "edge"
    full = np.pad(plane, ((0, th * tiles - h), (0, tw * tiles - w)), mode=mode)
    area = th * tw
    most = max(1, int(limit * area / 256))
    tables = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(full[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            spare = int(np.maximum(n - most, 0).sum())
            n = np.minimum(n, most) + spare // 256
            rest = spare % 256
            if rest:
                n[:: max(1, 256 // rest)][:rest] += 1
            tables[i, j] = np.clip(np.rint(np.cumsum(n) * 255.0 / area), 0, 255)

    def between(size: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(size) / step - 0.5
        left = np.floor(at).astype(int)
        return np.clip(left, 0, tiles - 1), np.clip(left + 1, 0, tiles - 1), at - left

    y0, y1, fy = between(h, th)
    x0, x1, fx = between(w, tw)
    fy, fx = fy[:, None], fx[None, :]

    def look(ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
        return tables[ys[:, None], xs[None, :], plane]

    out = (look(y0, x0) * (1 - fx) + look(y0, x1) * fx) * (1 - fy) + (look(y1, x0) * (1 - fx) + look(y1, x1) * fx) * fy
    return np.rint(out).astype(np.uint8)


def radiology(rgb: np.ndarray, subtype: str, options: dict) -> np.ndarray:
    plane = pixels.gray(rgb)
    low, high = np.percentile(plane, [0.5, 99.5])
    plane = stretch(plane) if high > low else plane  # an empty window leaves the image alone
    plane = equalised(plane, *CONTRAST.get(subtype, CONTRAST["xray"]))
    return np.repeat(pixels.padded(plane, SIDE)[..., None], 3, axis=2)


def balanced(rgb: np.ndarray) -> np.ndarray:
    """Each channel scaled to the common mean."""
    means = rgb.reshape(-1, 3).mean(axis=0)
    gain = np.where(means > 1e-6, means.mean() / np.maximum(means, 1e-6), 1.0)
    return np.clip(rgb * gain, 0, 255).astype(np.uint8)


def macroscopic(rgb: np.ndarray, subtype: str, options: dict) -> np.ndarray:
    rgb = balanced(rgb)
    if options["fill_glare"] and subtype in GLOSSY:
        rgb = pixels.fill_in(rgb, pixels.dilate(features.glare(rgb).astype(np.uint8), pixels.disc(5)) > 0)
    if options["fill_hair"] and subtype in HAIRY:
        rgb = pixels.fill_in(rgb, pixels.black_hat(pixels.gray(rgb), 9) > 10)
    return pixels.padded(rgb, SIDE) if subtype in LETTERBOXED or features.dark_corners(pixels.gray(rgb)) else rgb


def fullest_tile(rgb: np.ndarray, size: int = TILE) -> np.ndarray:
    """The tile with most tissue (darker than 235), steps of half a tile, the first of equals; sums by an integral image."""
    h, w = rgb.shape[:2]
    ty, tx = min(size, h), min(size, w)
    sums = np.pad((pixels.gray(rgb) < 235).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    ys, xs = np.arange(0, h - ty + 1, max(1, ty // 2)), np.arange(0, w - tx + 1, max(1, tx // 2))
    y, x = ys[:, None], xs[None, :]
    tissue = sums[y + ty, x + tx] - sums[y, x + tx] - sums[y + ty, x] + sums[y, x]
    i, j = divmod(int(tissue.argmax()), len(xs))
    return rgb[ys[i] : ys[i] + ty, xs[j] : xs[j] + tx]


def stain_normalised(rgb: np.ndarray, stains: np.ndarray = STAINS, beta: float = 0.15, tail: float = 1.0) -> np.ndarray:
    """Macenko's method: the two stains from the extreme angles in the plane of greatest variance of optical density,
    their concentrations rescaled, then seen through the reference stains. Too little stain: unchanged."""
    density = -np.log10((rgb.reshape(-1, 3).astype(np.float64) + 1) / 255)
    stained = density[(density > beta).all(axis=1)]
    if len(stained) < 10:
        return rgb
    try:
        _, vectors = np.linalg.eigh(np.cov(stained, rowvar=False))
        plane = vectors[:, 1:] * np.where(vectors[0, 1:] < 0, -1, 1)
        flat = stained @ plane
        ends = np.percentile(np.arctan2(flat[:, 1], flat[:, 0]), [tail, 100 - tail])
        found = plane @ np.stack([np.cos(ends), np.sin(ends)])
        found = found if found[0, 0] > found[0, 1] else found[:, ::-1]
        amounts = np.linalg.lstsq(found, density.T, rcond=None)[0]
    except np.linalg.LinAlgError:
        return rgb
    top = np.percentile(amounts, 99, axis=1, keepdims=True)
    amounts *= CONCENTRATIONS[:, None] / np.where(top == 0, 1e-6, top)
    return np.clip(255 * 10 ** -(stains @ amounts), 0, 255).T.reshape(rgb.shape).astype(np.uint8)


def microscopy(rgb: np.ndarray, subtype: str, options: dict) -> np.ndarray:
    if rgb.shape[0] * rgb.shape[1] > SLIDE_PIXELS:
        rgb = fullest_tile(rgb)
    return stain_normalised(rgb) if rgb.shape[0] * rgb.shape[1] <= STAIN_PIXELS else rgb


def region(rgb: np.ndarray) -> np.ndarray:
    """The box round all that isn't black; the whole image if the box is below 30 % of a side."""
    bright = pixels.gray(rgb) > 10
    rows, columns = np.flatnonzero(bright.any(axis=1)), np.flatnonzero(bright.any(axis=0))
    if not len(rows):
        return rgb
    h, w = rows[-1] - rows[0] + 1, columns[-1] - columns[0] + 1
    return rgb if h < 0.3 * rgb.shape[0] or w < 0.3 * rgb.shape[1] else rgb[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1]


def diffused(plane: np.ndarray, rounds: int = 8, kappa: float = 30.0, gamma: float = 0.1) -> np.ndarray:
    """Perona-Malik diffusion; opposite edges are neighbours."""
    u = plane.astype(np.float64)
    for _ in range(rounds):
        steps = [np.roll(u, s, axis) - u for axis in (0, 1) for s in (-1, 1)]
        u = u + gamma * sum(np.exp(-((d / kappa) ** 2)) * d for d in steps)
    return np.clip(u, 0, 255).astype(np.uint8)


def ultrasound(rgb: np.ndarray, subtype: str, options: dict) -> np.ndarray:
    if subtype == "oct":
        return rgb
    rgb = region(rgb)
    if options["diffuse"]:
        rgb = np.repeat(diffused(pixels.gray(rgb))[..., None], 3, axis=2)
    return rgb


#: What is done in each stream; more can be registered.
STREAM_KERNELS = {"radiology": radiology, "macroscopic": macroscopic, "microscopy": microscopy, "ultrasound": ultrasound}


def preprocess(data: np.ndarray, stream: str | None, subtype: str | None, options: dict | None = None) -> np.ndarray:
    """Normalise, bound the size, then what the stream asks for; an unknown stream stops there."""
    rgb = bounded(to_rgb(data))
    kernel = STREAM_KERNELS.get(stream or "")
    return kernel(rgb, subtype or "", OPTIONS | (options or {})) if kernel else rgb


def gray_canvas() -> np.ndarray:
    return np.full((512, 512, 3), 128, np.uint8)
