"""Stream and subtype of an image from its features, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ozalid.operators.intent import best_label

STREAMS = ("radiology", "macroscopic", "microscopy", "ultrasound")
# The subtypes of each stream, in the order in which ties are decided, and the one meant by default.
SUBTYPES = {"radiology": ("xray", "mri", "ct"), "macroscopic": ("gross_pathology", "dermoscopy", "fundus", "endoscopy", "colposcopy", "iri"), "microscopy": ("histopathology",), "ultrasound": ("ultrasound", "oct")}
DEFAULTS = {"radiology": "xray", "macroscopic": "gross_pathology", "microscopy": "histopathology", "ultrasound": "ultrasound"}
# Weights of the features in the score of each stream.
WEIGHTS = {
    "radiology": {"grayness": 2.0, "border_darkness": 1.0, "native": 1.5, "texture_roughness": -1.5},
    "macroscopic": {"saturation_mean": 2.0, "skin_red_fraction": 1.5, "vignette": 1.5, "stain": -1.0},
    "microscopy": {"stain": 2.0, "hue_entropy": 1.2, "saturation_std": 1.0, "vignette": -1.0},
    "ultrasound": {"grayness": 1.8, "texture_roughness": 2.0, "border_darkness": 1.2, "native": -1.0},
}


def stream_scores(f: dict[str, Column], weights: dict[str, dict[str, float]] = WEIGHTS) -> Column:
    """array<struct<stream, score>>; f has the measured features by name, has_vignette and native as booleans."""
    derived = dict(f)
    derived["grayness"] = 0.6 * (1.0 - f["saturation_mean"]) + 0.4 * (1.0 - f["grayscale_deviation"])
    derived["stain"] = F.greatest(f["purple_pink_fraction"], f["blue_ihc_fraction"])
    derived["vignette"], derived["native"] = f["has_vignette"].cast("double"), f["native"].cast("double")

    def score(parts: dict[str, float]) -> Column:
        out = F.lit(0.0)
        for name, weight in parts.items():
            out = out + F.lit(weight) * derived[name]
        return out

    return F.array(*[F.struct(F.lit(s).alias("stream"), score(parts).alias("score")) for s, parts in weights.items()])


def best_stream(scores: Column) -> Column:
    return best_label(scores, "stream", "score")


def valid_subtype(stream: Column, subtype: Column) -> Column:
    """subtype if it belongs to stream, else the stream's default; NULL for an unknown stream."""
    out = F.lit(None).cast("string")
    for s in STREAMS:
        out = F.when(stream == s, F.when(subtype.isin(*SUBTYPES[s]), subtype).otherwise(F.lit(DEFAULTS[s]))).otherwise(out)
    return out
