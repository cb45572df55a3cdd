"""What an image looks like: the features that route it, and the subtype within its stream. numpy only."""

from __future__ import annotations

import numpy as np

from ozalid.functions import pixels

# Hue ranges in degrees, both ends included, and the least saturation at which a hue counts.
HUES = {"purple_pink_fraction": ((260, 335),), "blue_ihc_fraction": ((190, 250),), "skin_red_fraction": ((0, 40), (340, 360))}
COLOURED = 0.15


def _corners(plane: np.ndarray) -> float:
    """Mean brightness 0..1 of the four corner patches, each by itself."""
    h, w = plane.shape
    n = max(1, round(0.06 * min(h, w)))
    patches = (plane[y, x] for y in (slice(None, n), slice(-n, None)) for x in (slice(None, n), slice(-n, None)))
    return float(np.mean([p.mean() for p in patches]) / 255)


def dark_corners(plane: np.ndarray) -> bool:
    """Black corners on a nearly square frame."""
    h, w = plane.shape
    return _corners(plane) < 0.12 and 0.8 <= w / h <= 1.25


def vignette(plane: np.ndarray) -> bool:
    """Dark corners round a bright middle fifth."""
    h, w = plane.shape
    middle = plane[int(0.4 * h) : int(0.6 * h), int(0.4 * w) : int(0.6 * w)]
    return middle.size > 0 and dark_corners(plane) and float(middle.mean() / 255) > 0.25


def roughness(plane: np.ndarray) -> float:
    v = float(pixels.laplacian(plane).var())
    return v / (v + 500.0)


def hue_fraction(colour: np.ndarray, name: str) -> float:
    """Share of the coloured pixels whose hue lies in the named ranges; 0 without coloured pixels."""
    coloured = colour[..., 1] / 255.0 >= COLOURED
    if not coloured.any():
        return 0.0
    degrees = colour[..., 0][coloured] * 2.0
    inside = np.zeros(len(degrees), bool)
    for low, high in HUES[name]:
        inside |= (degrees >= low) & (degrees <= high)
    return float(inside.mean())


def hue_entropy(colour: np.ndarray) -> float:
    """Entropy of 32 hue bins over pixels above the least saturation, 0..1."""
    hues = colour[..., 0][colour[..., 1] / 255.0 > COLOURED]
    if not len(hues):
        return 0.0
    n = np.bincount(np.minimum(hues.astype(int) * 32 // 180, 31), minlength=32)
    p = n[n > 0] / n.sum()
    return float(-(p * np.log2(p)).sum() / 5)


def border_darkness(plane: np.ndarray) -> float:
    """1 for a black frame; four bands of 3 %, corners in two of them."""
    n = max(1, round(0.03 * min(plane.shape)))
    bands = (plane[:n], plane[-n:], plane[:, :n], plane[:, -n:])
    return float(1 - np.concatenate([b.ravel() for b in bands]).mean() / 255)


def measure(rgb: np.ndarray) -> dict[str, float | bool]:
    """The ten measured features of an RGB image."""
    plane, colour = pixels.gray(rgb), pixels.hsv(rgb)
    c = rgb.astype(np.float64)
    apart = sum(np.abs(c[..., i] - c[..., j]) for i, j in ((0, 1), (1, 2), (0, 2))) / 3
    return {
        "saturation_mean": float(colour[..., 1].mean() / 255), "saturation_std": float(colour[..., 1].std() / 255),
        "grayscale_deviation": float(apart.mean() / 255), "border_darkness": border_darkness(plane),
        "texture_roughness": roughness(plane), "hue_entropy": hue_entropy(colour),
        **{name: hue_fraction(colour, name) for name in HUES}, "has_vignette": vignette(plane),
    }


# -- subtypes --------------------------------------------------------------------------------------------------------

# For each subtype a constant and weights of signals; ties go to the earlier one.
SUBTYPE_WEIGHTS = {
    "radiology": {"xray": (1.5, {"square": -1.5, "black": 2.0, "rough": 1.0, "vignette": -1.0}), "mri": (1.5, {"square": 1.0, "rough": -1.5, "vignette": -0.5, "black": -1.0}), "ct": (0.0, {"square": 1.0, "vignette": 2.0, "rough": 1.0, "black": -1.0})},
    "macroscopic": {"gross_pathology": (1.0, {"red": -0.5, "glare": -0.5, "hair": -0.5, "vignette": -0.5}), "dermoscopy": (0.0, {"hair": 2.0, "vignette": 0.5, "saturation": 0.5}), "fundus": (0.0, {"vignette": 1.5, "red": 1.5, "saturation": 0.5, "hair": -1.0}), "endoscopy": (0.0, {"glare": 2.0, "red": 1.0, "vignette": 0.5}), "colposcopy": (0.0, {"glare": 2.0, "red": 1.0, "vignette": -0.5}), "iri": (2.0, {"saturation": -2.0, "vignette": 1.5})},
    "ultrasound": {"ultrasound": (1.0, {"corner": 2.0, "band": -1.0}), "oct": (1.5, {"band": 2.0, "corner": -1.5, "wide": 0.5})},
}


def glare(rgb: np.ndarray) -> np.ndarray:
    """Very bright, hardly coloured pixels."""
    colour = pixels.hsv(rgb)
    return (colour[..., 2] / 255.0 > 0.92) & (colour[..., 1] / 255.0 < 0.15)


def signals(stream: str, rgb: np.ndarray) -> dict[str, float]:
    plane = pixels.gray(rgb)
    h, w = plane.shape
    if stream == "radiology":
        return {"square": 1 - min(abs(w / h - 1), 1.0), "vignette": float(vignette(plane)), "black": float((plane < 10).mean()), "rough": roughness(plane)}
    if stream == "macroscopic":
        colour = pixels.hsv(rgb)
        return {"vignette": float(vignette(plane)), "saturation": float(colour[..., 1].mean() / 255), "red": hue_fraction(colour, "skin_red_fraction"), "glare": float(glare(rgb).mean()), "hair": float((pixels.black_hat(plane, 9) > 10).mean())}
    return {"corner": 1 - _corners(plane), "band": float(plane.mean(axis=1).std() / (plane.std() + 1e-6)), "wide": float(w / h > 1.6)}


def subtype(stream: str, rgb: np.ndarray, default: str) -> str:
    """The subtype of greatest score; streams without rules have their default alone."""
    rules = SUBTYPE_WEIGHTS.get(stream)
    if not rules:
        return default
    s = signals(stream, rgb)
    scores = {k: base + sum(weight * s[name] for name, weight in parts.items()) for k, (base, parts) in rules.items()}
    return max(rules, key=lambda k: scores[k])
