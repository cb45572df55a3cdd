"""Images of every kind as one table: files by kind, decoded, and one picture per sample.

Files come from the binaryFile source, so listing, splitting and retries are Spark's. A row is never dropped: what can't
be decoded keeps its key with load_error. Pixels go through Arrow in small batches and are not shuffled, except slices
of a DICOM series, which must meet: one group per folder, of at most a series' size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ozalid.functions import enhance, planes
from ozalid.sources import formats

RASTERS = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".gif", ".webp", ".ppm", ".pgm")
CHANNEL = r"(?i)_(red|green|blue|yellow)( \([0-9]+\))?\.\w+$"
PICTURE = "height int, width int, data binary, load_error string"
#: Names of rasters but PNG, as a glob pattern in any case: other files aren't opened by the image source.
_OTHERS = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in suffix[1:]) for suffix in RASTERS if suffix != ".png") + "}"
#: Rows of a batch that holds pixels.
BATCH = 32


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, length, content) of all files below path; content is only read if it is selected."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "length", "content")


def kind_of(path: Column, content: Column) -> Column:
    """nifti, dicom, channel or raster by the name; of unknown suffixes, dicom by the mark at byte 128, nifti by that at
    byte 344; else other."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    suffix = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    return (
        F.when(name.rlike(r"\.nii(\.gz)?$"), "nifti").when(suffix.isin(".dcm", ".dicom"), "dicom").when(name.rlike(CHANNEL), "channel").when(suffix.isin(*RASTERS), "raster")
        .when(F.substring(content, 129, 4) == F.lit(b"DICM"), "dicom").when(F.substring(content, 345, 4).isin(b"n+1\0", b"ni1\0"), "nifti").otherwise("other")
    )


def corrected(d: dict) -> np.ndarray:
    """DICOM pixels in real units (a missing or zero slope is 1), dark where they mean dark."""
    values = d["pixels"].astype(np.float32) * (d["slope"] or 1.0) + (d["intercept"] or 0.0)
    return values.max() + values.min() - values if d["inverse"] else values


def dicom_picture(data: bytes) -> np.ndarray:
    d = formats.read_dicom(data)
    if d["coloured"]:
        image = d["pixels"]
        return np.clip(image[len(image) // 2] if image.ndim == 4 else image, 0, 255).astype(np.uint8)
    values = corrected(d)
    if values.ndim == 3:
        return planes.representative(np.moveaxis(values, 0, -1))
    return np.repeat(enhance.stretch(values)[..., None], 3, axis=2)


def series_picture(parts: list[tuple[str, bytes]]) -> np.ndarray:
    """The picture of a folder of DICOM slices: unreadable, coloured and multi-frame files left out; ordered by number
    if all have one, else by z if all have, else by name; of several shapes the most frequent, the first of equals."""
    slices = []
    for name, data in sorted(parts):
        try:
            d = formats.read_dicom(data)
        except formats.DecodeError:
            continue
        if not d["coloured"] and d["pixels"].ndim == 2:
            slices.append(d | {"name": name})
    if not slices:
        raise formats.DecodeError("no readable slice in the series")
    for key in ("number", "z"):
        if all(s[key] is not None for s in slices):
            slices.sort(key=lambda s: (s[key], s["name"]))
            break
    values = [corrected(s) for s in slices]
    shape = Counter(v.shape for v in values).most_common(1)[0][0]
    return planes.representative(np.stack([v for v in values if v.shape == shape], axis=-1))


def decode(kind: str, data: bytes) -> np.ndarray:
    """The picture of one file as an array that enhance.to_rgb understands."""
    if kind == "nifti":
        return planes.representative(formats.read_nifti(data))
    if kind == "dicom":
        return dicom_picture(data)
    return formats.read_png(data)


def packed(make, *args) -> tuple:
    try:
        rgb = enhance.to_rgb(make(*args))
    except Exception as e:  # noqa: BLE001 - a row that fails keeps its reason
        return None, None, None, f"{type(e).__name__}: {e}"[:500]
    return rgb.shape[0], rgb.shape[1], np.ascontiguousarray(rgb).tobytes(), None


def unpacked(height: int, width: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(int(height), int(width), 3)


def _single(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for i in range(0, len(pdf), BATCH):
            part = pdf.iloc[i : i + BATCH]
            rows = [(p, *packed(decode, k, c)) for p, k, c in zip(part["path"], part["kind"], part["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["sample", "height", "width", "data", "load_error"])


def _folder(pdf: pd.DataFrame) -> pd.DataFrame:
    sample = pdf["sample"].iloc[0]
    if (pdf["kind"] == "channel").any():
        first = pdf[pdf["kind"] == "channel"].sort_values("path").drop_duplicates("channel")
        make = lambda: planes.channel_grid({c: formats.read_png(d) for c, d in zip(first["channel"], first["content"], strict=True)})
    else:
        make = lambda: series_picture(list(zip(pdf["path"], pdf["content"], strict=True)))
    return pd.DataFrame([(sample, *packed(make))], columns=["sample", "height", "width", "data", "load_error"])


def pictures(spark: SparkSession, path: str) -> DataFrame:
    """(sample, height, width, data, load_error): one RGB picture per sample below path.

    A sample is a NIfTI, DICOM or raster file, or a folder: of channel files ('<id>_<colour>.<ext>'), or, of DICOM files
    only, a series. PNG is decoded here with all its depths; other rasters by Spark's own image source.
    """
    found = files(spark, path).withColumn("kind", kind_of(F.col("path"), F.col("content")))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    tagged = found.withColumn("folder", folder).withColumn("channel", F.lower(F.regexp_extract("path", CHANNEL, 1)))
    # what a folder is depends on names alone: an aggregate of a few bytes per folder
    kinds = tagged.groupBy("folder").agg(F.bool_or(F.col("kind") == "channel").alias("channels"), F.count_if(F.col("kind") == "dicom").alias("dicoms"), F.bool_and(F.col("kind") == "dicom").alias("all_dicom"))
    placed = tagged.join(kinds, "folder")
    as_folder = F.col("channels") | (F.col("all_dicom") & (F.col("dicoms") > 1))
    grouped = placed.filter(as_folder & F.col("kind").isin("channel", "dicom")).select(F.col("folder").alias("sample"), "path", "kind", "channel", "content")
    by_folder = grouped.groupBy("sample").applyInPandas(_folder, f"sample string, {PICTURE}")
    alone = placed.filter(~as_folder)
    png = F.lower("path").endswith(".png")
    own = alone.filter(F.col("kind").isin("nifti", "dicom") | (F.col("kind") == "raster") & png).select("path", "kind", "content")
    single = own.mapInPandas(_single, f"sample string, {PICTURE}")
    others = alone.filter((F.col("kind") == "raster") & ~png).select("path")
    return by_folder.unionByName(single).unionByName(rasters(spark, path).join(others.withColumnRenamed("path", "sample"), "sample", "left_semi"))


def rasters(spark: SparkSession, path: str) -> DataFrame:
    """Rasters by Spark's image source (JVM decoders, channels blue first); broken files keep a row with load_error."""
    image = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", _OTHERS).load(path).select("image.*")

    @F.pandas_udf(PICTURE)
    def rgb(height: pd.Series, width: pd.Series, n: pd.Series, data: pd.Series) -> pd.DataFrame:
        def one(h: int, w: int, c: int, d: bytes) -> np.ndarray:
            if h <= 0 or w <= 0:
                raise formats.DecodeError("undecodable raster")
            a = np.frombuffer(d, np.uint8).reshape(h, w, c)
            return a if c == 1 else np.concatenate([a[..., 2::-1], a[..., 3:]], axis=2)

        return pd.DataFrame([packed(one, *r) for r in zip(height, width, n, data, strict=True)], columns=["height", "width", "data", "load_error"])

    return image.select(F.col("origin").alias("sample"), rgb("height", "width", "nChannels", "data").alias("p")).select("sample", "p.*")
