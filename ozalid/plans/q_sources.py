"""Queries: files written and read again, and what folders and contents say. Files lie below the shared checkpoint folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ozalid.operators.choices import letters_of
from ozalid.plans.q_questions import _LETTERS, _META, _TEXTS, OPTIONS, WIDE, _strip, table
from ozalid.plans.q_scoring import ORACLE as _SCORING
from ozalid.session import cut_lineage
from ozalid.sources import folders, formats, images, tables


def _kept(spark, folder, df):
    """df, read now, and its files removed."""
    rows = cut_lineage(df)
    folders.remove(spark, folder)
    return rows


def metadata_file(spark, sf_dir):
    """Query rows as CSV and back: quoted line breaks and quotes stay, blank images and choices go."""
    at = folders.scratch(spark)
    tables.write_csv(table(spark, sf_dir, "dev_metadata").select("query_id", "image", "question", *WIDE), f"{at}/dev_metadata.csv")
    got = tables.read_metadata(spark, at, encoding="UTF-8")
    return _kept(spark, at, got.select("query_id", "image", "question", letters_of(F.col("choices")).alias("letters"), F.array_join(F.transform("choices", lambda c: c["text"]), "|").alias("texts")))


def submission_file(spark, sf_dir):
    at = folders.scratch(spark)
    tables.write_csv(tables.submission(table(spark, sf_dir, "diagnostics")), at)
    return _kept(spark, at, spark.read.option("header", True).option("escape", '"').csv(at).select("query_id", "answer", "inference_time"))


def diagnostic_file(spark, sf_dir):
    at = folders.scratch(spark)
    tables.write_csv(tables.diagnostic(table(spark, sf_dir, "diagnostics").withColumn("predicted_intent", F.coalesce("predicted_intent", F.lit("")))), at)
    shape = "query_id string, answer string, gold string, correct string, inference_time double, predicted_modality string, predicted_intent string, n_choices int, fallback_triggered string, fallback_reason string, top1_logit double, top2_logit double, logit_margin double"
    got = spark.read.option("header", True).option("escape", '"').schema(shape).csv(at)
    return _kept(spark, at, got.select("query_id", "answer", "correct", "n_choices", "fallback_triggered", F.coalesce("fallback_reason", F.lit("")).alias("fallback_reason"), F.coalesce("predicted_modality", F.lit("")).alias("predicted_modality"), "top1_logit", "inference_time"))


def items_files(spark, sf_dir):
    """Items as <root>/QA_information/Open-access/<dataset>.json, listed and read as the union of all datasets."""
    root = folders.scratch(spark)
    items = table(spark, sf_dir, "qa_items").select(F.coalesce("dataset", F.lit("none")).alias("dataset"), "question_id", "question", "gt_answer", *OPTIONS, "modality_type")
    tables.write_datasets(items, root)
    got, missing = tables.read_datasets(spark, root, [*tables.list_datasets(spark, root), "absent"])
    return _kept(spark, root, got.select("dataset", "question_id", "question", "gt_answer", *OPTIONS, F.lit(",".join(missing)).alias("missing")))


def _paths(spark, sf_dir, *parts):
    return tables.with_names(table(spark, sf_dir, "part").select(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("path")))


def _one_of(key, *values: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


_GRADES, _KINDS = ("CT-0", "ct_1", "Ct-2", "CT-3", "CT-4", "CT-9", "other"), (".nii", ".nii.gz", ".NII", ".png")
_CLASSES, _PICTURES = ("Benign", "malignant", "NORMAL", "unknown"), (").png", ")_mask.png", ").PNG", ").jpg")
_SCANS = ("_t1.nii", "_FLAIR.nii.gz", "_seg.nii", "_t2.nii", ".txt")


def graded_folders(spark, sf_dir):
    return tables.graded_scans(_paths(spark, sf_dir, "raw/studies/", _one_of("p_size", *_GRADES), "/", F.when(F.col("p_partkey") % 11 == 0, "._").otherwise(""), "study_", F.col("p_partkey").cast("string"), _one_of("p_partkey", *_KINDS)))


def prepared_items(spark, sf_dir):
    """Numbered items with fixed question and options, and their split, of the graded scans."""
    items = tables.items_of_cases(graded_folders(spark, sf_dir), "MosMedData")
    return items.select("question_id", "question_type", "question", "gt_answer", "image_path", "option_A", "option_D", "modality_type", "split")


def class_folders(spark, sf_dir):
    return tables.class_folders(_paths(spark, sf_dir, "raw/", _one_of("p_size", *_CLASSES), "/c (", F.col("p_partkey").cast("string"), _one_of("p_partkey", *_PICTURES)))


def case_folders(spark, sf_dir):
    """One scan per case: FLAIR before others, masks never."""
    return tables.brain_scans(_paths(spark, sf_dir, "raw/P", F.floor(F.col("p_partkey") / 7).cast("string"), "/P", F.col("p_partkey").cast("string"), _one_of("p_size", *_SCANS)))


_NAMES, _MARKS = ("scan.nii.gz", "IMG.DCM", "eye_red.png", "eye_Blue (2).jpg", "a.JPEG", "noname", "x.bin", "b.tiff"), ("D", "N", "")


def image_kinds(spark, sf_dir):
    """The kind of a file by its name, or by the mark in its contents."""
    mark = _one_of("p_partkey", *_MARKS)
    content = F.when(mark == "D", F.concat(F.repeat(F.lit(" "), F.lit(128)), F.lit("DICM"))).when(mark == "N", F.concat(F.repeat(F.lit(" "), F.lit(344)), F.lit("n+1\0"))).otherwise("short")
    p = table(spark, sf_dir, "part").select("p_partkey", images.kind_of(F.concat(F.lit("d/"), _one_of("p_size", *_NAMES)), F.encode(content, "US-ASCII")).alias("kind"))
    return p


def decoded_files(spark, sf_dir):
    """Contents of gray and coloured PNG files and of broken ones, decoded: sizes and sums of the pixels."""
    e = table(spark, sf_dir, "embeddings").select("vec_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for n in pdf["vec_id"]:
                gray = ((int(n) * 7 + np.arange(64) * 13) % 256).astype(np.uint8).reshape(8, 8)
                colours = np.stack([gray, gray + np.uint8(50), gray + np.uint8(90)], axis=-1)
                data = (formats.write_png(gray), formats.write_png(colours), b"no picture")[int(n) % 3]
                h, w, pixels, error = images.packed(images.decode, "raster", data)
                rows.append((int(n), h, w, int(np.frombuffer(pixels, np.uint8).sum()) if pixels else None, error is not None))
            yield pd.DataFrame(rows, columns=["vec_id", "height", "width", "pixel_sum", "failed"]).astype({"height": "Int32", "width": "Int32", "pixel_sum": "Int64"})

    return e.mapInPandas(run, "vec_id long, height int, width int, pixel_sum long, failed boolean")


QUERIES = {f.__name__: f for f in (metadata_file, submission_file, diagnostic_file, items_files, graded_folders, prepared_items, class_folders, case_folders, image_kinds, decoded_files)}


def _sql_of(key: str, *values: str) -> str:
    return f"list_value({', '.join(repr(v) for v in values)})[{key} % {len(values)} + 1]"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_GRADED = f"""SELECT 'raw/studies/' || g || '/study_' || p_partkey || k AS path, CASE upper(replace(g, '_', '-')) WHEN 'CT-0' THEN 'A' WHEN 'CT-1' THEN 'B' WHEN 'CT-2' THEN 'C' ELSE 'D' END AS letter
FROM (SELECT p_partkey, {_sql_of('p_size', *_GRADES)} AS g, {_sql_of('p_partkey', *_KINDS)} AS k FROM part) WHERE p_partkey % 11 <> 0 AND g NOT IN ('CT-9', 'other') AND k <> '.png'"""
_SUBMITTED = _SCORING["submission_rows"]
ORACLE = {
    "metadata_file": _META + f"SELECT query_id, nullif({_strip('image')}, '') AS image, nullif(question, '') AS question, {_LETTERS} AS letters, {_TEXTS} AS texts FROM d",
    "submission_file": f"SELECT query_id, answer, inference_time FROM ({_SUBMITTED})",
    "diagnostic_file": "SELECT query_id, answer, CASE WHEN correct THEN 'True' WHEN NOT correct THEN 'False' END AS correct, n_choices, CASE WHEN fallback_triggered THEN 'True' WHEN NOT fallback_triggered THEN 'False' END AS fallback_triggered, coalesce(fallback_reason, '') AS fallback_reason, coalesce(predicted_modality, '') AS predicted_modality, top1_logit, inference_time FROM diagnostics",
    "items_files": f"SELECT coalesce(dataset, 'none') AS dataset, question_id, question, gt_answer, {', '.join(OPTIONS)}, 'absent' AS missing FROM qa_items",
    "graded_folders": _GRADED,
    "prepared_items": f"""WITH g AS ({_GRADED}), r AS (SELECT *, row_number() OVER (ORDER BY path) - 1 AS i, row_number() OVER (ORDER BY md5('42|' || path), path) AS s, count(*) OVER () AS n FROM g)
SELECT printf('MosMedData_%05d', i) AS question_id, 'External-Prepared' AS question_type, {_text(tables.CT_QUESTION)} AS question, [{', '.join(map(_text, tables.CT_OPTIONS))}][ascii(letter) - 64] AS gt_answer, path AS image_path,
{_text(tables.CT_OPTIONS[0])} AS option_A, {_text(tables.CT_OPTIONS[3])} AS option_D, 'CT(Computed Tomography)' AS modality_type, CASE WHEN s <= greatest(1, round_even(n * 0.2, 0)) THEN 'eval' ELSE 'train' END AS split FROM r""",
    "class_folders": f"""SELECT 'raw/' || c || '/c (' || p_partkey || k AS path, CASE lower(c) WHEN 'benign' THEN 'A' WHEN 'malignant' THEN 'B' ELSE 'C' END AS letter
FROM (SELECT p_partkey, {_sql_of('p_size', *_CLASSES)} AS c, {_sql_of('p_partkey', *_PICTURES)} AS k FROM part) WHERE c <> 'unknown' AND k IN (').png', ').PNG')""",
    "case_folders": f"""SELECT path, 'A' AS letter FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY (s = '_FLAIR.nii.gz') DESC, path) AS r
FROM (SELECT p_partkey // 7 AS c, s, 'raw/P' || (p_partkey // 7) || '/P' || p_partkey || s AS path FROM (SELECT p_partkey, {_sql_of('p_size', *_SCANS)} AS s FROM part) WHERE s NOT IN ('_seg.nii', '.txt'))) WHERE r = 1""",
    "image_kinds": f"""SELECT p_partkey, CASE WHEN n = 'scan.nii.gz' THEN 'nifti' WHEN n = 'IMG.DCM' THEN 'dicom' WHEN n LIKE 'eye%' THEN 'channel' WHEN n IN ('a.JPEG', 'b.tiff') THEN 'raster' WHEN m = 'D' THEN 'dicom' WHEN m = 'N' THEN 'nifti' ELSE 'other' END AS kind
FROM (SELECT p_partkey, {_sql_of('p_size', *_NAMES)} AS n, {_sql_of('p_partkey', *_MARKS)} AS m FROM part)""",
    "decoded_files": """SELECT vec_id, CASE WHEN vec_id % 3 < 2 THEN 8 END AS height, CASE WHEN vec_id % 3 < 2 THEN 8 END AS width,
CASE vec_id % 3 WHEN 0 THEN 3 * s WHEN 1 THEN s + t + u END AS pixel_sum, vec_id % 3 = 2 AS failed
FROM (SELECT vec_id, sum(v)::BIGINT AS s, sum((v + 50) % 256)::BIGINT AS t, sum((v + 90) % 256)::BIGINT AS u FROM (SELECT vec_id, (vec_id * 7 + i * 13) % 256 AS v FROM embeddings CROSS JOIN range(64) r(i)) GROUP BY vec_id)""",
}
