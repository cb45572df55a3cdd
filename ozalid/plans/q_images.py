"""Queries on pixels: images are made from the embeddings (64 values, 8 x 8). What they show, no SQL can say."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ozalid.functions import enhance, features, planes
from ozalid.operators.choices import choices_of
from ozalid.operators.skew import latest_rows
from ozalid.plans.pipeline import evaluate, image_features, predict, predict_letters, prepared
from ozalid.plans.q_questions import _GOLD, _LETTERS, _OP, _PBEST, _PCASE, _PSC, OPTIONS, table
from ozalid.sources import formats, images

SIDE = 48


def _image(values: np.ndarray, label: int) -> np.ndarray:
    """A coloured or gray picture of an embedding, by its label."""
    cell = np.kron(np.asarray(values, float).reshape(8, 8), np.ones((SIDE // 8, SIDE // 8)))
    plane = (cell - cell.min()) / max(np.ptp(cell), 1e-9) * 255
    tint = ((1, 1, 1), (1, 0.4, 0.3), (0.8, 0.3, 0.9), (0.6, 0.6, 0.7))[label % 4]
    return np.clip(plane[..., None] * np.array(tint), 0, 255).astype(np.uint8)


def _pictures(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(str(i), SIDE, SIDE, _image(v, int(k)).tobytes(), None) for i, v, k in zip(pdf["vec_id"], pdf["embedding"], pdf["label"], strict=True)]
            yield pd.DataFrame(rows, columns=["sample", "height", "width", "data", "load_error"])

    return e.mapInPandas(run, f"sample string, {images.PICTURE}")


def _files(spark, sf_dir, make, *columns: str) -> DataFrame:
    """What `make` gives for each embedding: (sample, part, ...) rows of a file's picture, as sizes and a digest."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, v, k in zip(pdf["vec_id"], pdf["embedding"], pdf["label"], strict=True):
                h, w, data, error = images.packed(make, np.asarray(v, float).reshape(8, 8), int(k))
                rows.append((int(i), h, w, hashlib.md5(data).hexdigest() if data else None, error))
            yield pd.DataFrame(rows, columns=["vec_id", "height", "width", "digest", "load_error"])

    return e.mapInPandas(run, "vec_id long, height int, width int, digest string, load_error string")


def image_features_of(spark, sf_dir):
    return image_features(_pictures(spark, sf_dir))


def route_modality(spark, sf_dir):
    return image_features(_pictures(spark, sf_dir)).groupBy("stream", "subtype").agg(F.count("*").alias("images"))


def preprocess_images(spark, sf_dir):
    return prepared(_pictures(spark, sf_dir)).select("sample", "stream", "subtype", "height", "width", F.md5("data").alias("digest"), "load_error", "stage_error")


def hue_measures(spark, sf_dir):
    """The kernels for hue entropy, share of a hue range and dark border, on planes that SQL can spell, too."""
    e = table(spark, sf_dir, "embeddings").select("vec_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        i = np.arange(64)
        for pdf in batches:
            rows = []
            for n in map(int, pdf["vec_id"]):
                colour = np.stack([(n * 7 + i * 13) % 180, (n * 5 + i * 11) % 256, (n * 3 + i * 17) % 256], axis=-1).astype(np.uint8).reshape(8, 8, 3)
                rows.append((n, features.hue_entropy(colour), features.hue_fraction(colour, "skin_red_fraction"), features.border_darkness(colour[..., 2])))
            yield pd.DataFrame(rows, columns=["vec_id", "entropy", "red", "border"])

    measured = e.mapInPandas(run, "vec_id long, entropy double, red double, border double")
    return measured.select("vec_id", *[F.round(c, 6).alias(c) for c in ("entropy", "red", "border")])


def nifti_volume(spark, sf_dir):
    def make(v, k):
        depth = np.stack([np.roll(v, s, axis=0) * (1 + s % 3) for s in range(12)], axis=-1).astype(np.float32)
        turn = np.array([[-1.0, 0, 0], [0, 1, 0], [0, 0, 1]]) if k % 2 else None
        return planes.representative(formats.read_nifti(formats.write_nifti(depth, turn)))

    return _files(spark, sf_dir, make)


def dicom_series(spark, sf_dir):
    def make(v, k):
        plane = ((v - v.min()) * 100).astype(np.uint16)
        parts = [(f"s{n:02d}", formats.write_dicom(np.roll(plane, n, 1), "MONOCHROME1" if k % 3 == 0 else "MONOCHROME2", number=20 - n if k % 2 else None, z=float(n), slope=2.0, intercept=-5.0)) for n in range(6)]
        return images.series_picture([*parts, ("broken", b"no image"), ("scout", formats.write_dicom(plane[:4]))])

    return _files(spark, sf_dir, make)


def channel_grid(spark, sf_dir):
    def make(v, k):
        plane = ((v - v.min()) / max(np.ptp(v), 1e-9) * 255).astype(np.uint8)
        present = list(planes.QUADRANTS)[: k % 4 + 1]
        return planes.channel_grid({c: formats.read_png(formats.write_png(np.roll(plane, i, 0))) for i, c in enumerate(present)})

    return _files(spark, sf_dir, make)


def macenko(spark, sf_dir):
    return _files(spark, sf_dir, lambda v, k: enhance.stain_normalised(_image(v, 2)))


def _draw(*parts) -> Column:
    """A number that any engine draws alike."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 6), 16, 10).cast("long")


def _scorer(requests: DataFrame, pictures: DataFrame) -> DataFrame:
    """A stand-in for the model: logits from a hash of query and letter, slow for every ninth query."""
    letter = F.explode(F.transform("choices", lambda c: c["letter"])).alias("letter")
    each = requests.select("query_id", letter)
    logit = (_draw("query_id", "letter") % 1000).cast("double")
    return each.select("query_id", "letter", F.lit("plain").alias("variant"), logit.alias("logit"), F.when(_draw("query_id") % 9 == 0, 6.0).otherwise(0.5).alias("seconds"))


def _answered(spark, sf_dir, run):
    """The latest row of each item, with embeddings as pictures; one in 25 has none, and one in 40 a picture that isn't there."""
    e = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n")).first()["n"]
    q = latest_rows(table(spark, sf_dir, "qa_items"), "question_id", "loaded_at", ["question", "gt_answer", *OPTIONS])
    n = _draw(F.lit("s"), "question_id")
    sample = F.when(n % 25 == 0, None).when(n % 40 == 1, F.lit("gone")).otherwise((n % F.lit(max(e, 1))).cast("string"))
    queries = q.select(F.col("question_id").alias("query_id"), sample.alias("sample"), "question", choices_of([F.col(c) for c in OPTIONS], stripped=False).alias("choices"), "gt_answer")
    return run(queries.drop("gt_answer"), prepared(_pictures(spark, sf_dir)), _scorer), queries.select("query_id", "gt_answer", "choices")


def predict_pipeline(spark, sf_dir):
    """Items with embeddings as their pictures, answered, and evaluated by intent and reason."""
    log = evaluate(*_answered(spark, sf_dir, predict))
    return log.groupBy("predicted_intent", "fallback_reason").agg(F.count("*").alias("total"), F.count_if("correct").alias("correct_rows"), F.sum("n_choices").alias("n_choices"), F.sum("top1_logit").alias("logits"), F.count("logit_margin").alias("margins"), F.count("predicted_modality").alias("routed"))


def predict_letters_answers(spark, sf_dir):
    """Answers of the competition's order of steps: a picture that isn't there decides first."""
    return _answered(spark, sf_dir, predict_letters)[0].groupBy("answer").agg(F.count("*").alias("answers"))


QUERIES = {f.__name__: f for f in (image_features_of, route_modality, preprocess_images, hue_measures, nifti_volume, dicom_series, channel_grid, macenko, predict_pipeline, predict_letters_answers)}

_PREDICTED = f"""
WITH q AS (SELECT question_id, arg_max({{'question': question, 'gt_answer': gt_answer, 'option_A': option_A, 'option_B': option_B, 'option_C': option_C, 'option_D': option_D}}, {{'o': loaded_at, 'q': question, 'g': gt_answer, 'a': option_A, 'b': option_B, 'c': option_C, 'd': option_D}}) AS x FROM qa_items WHERE question_id IS NOT NULL GROUP BY question_id),
c AS (SELECT question_id, x.*, ('0x' || substr(md5('s|' || question_id), 1, 6))::BIGINT AS n FROM q),
d AS (SELECT *, list_filter([{_OP}], lambda c: c IS NOT NULL) AS choices FROM c),
t AS (SELECT *, {_PSC}, {_LETTERS} IN ('AB', 'ABCD') AS fit, n % 25 <> 0 AND n % 40 <> 1 AS loaded, ('0x' || substr(md5(question_id), 1, 6))::BIGINT % 9 = 0 AS late, {_GOLD} AS gold FROM d),
l AS (SELECT question_id, unnest(choices).letter AS letter FROM t),
s AS (SELECT question_id, letter, ('0x' || substr(md5(question_id || '|' || letter), 1, 6))::BIGINT % 1000 AS logit FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY logit DESC, letter) AS k, lead(logit) OVER (PARTITION BY question_id ORDER BY logit DESC, letter) AS second FROM s),
b AS (SELECT t.*, r.letter, r.logit, r.second, CASE WHEN {_PBEST} > 0 THEN {_PCASE} ELSE 'diagnostic' END AS track FROM t LEFT JOIN r ON r.question_id = t.question_id AND r.k = 1),
f AS (SELECT *, CASE WHEN NOT fit THEN 'malformed_choices' WHEN late AND loaded THEN 'inference_timeout' WHEN late THEN 'image_load_failed+inference_timeout' WHEN NOT loaded THEN 'image_load_failed' ELSE '' END AS fallback_reason FROM b)
"""
_PIXELS = "p AS (SELECT vec_id, i, (vec_id * 7 + i * 13) % 180 AS h, (vec_id * 5 + i * 11) % 256 AS s, (vec_id * 3 + i * 17) % 256 AS v FROM embeddings CROSS JOIN range(64) r(i))"
ORACLE = {
    "hue_measures": f"""WITH {_PIXELS},
f AS (SELECT vec_id, coalesce(count(*) FILTER (s / 255 >= 0.15 AND (h * 2 <= 40 OR h * 2 >= 340))::DOUBLE / nullif(count(*) FILTER (s / 255 >= 0.15), 0), 0) AS red,
  1 - sum(v * ((i // 8 IN (0, 7))::INT + (i % 8 IN (0, 7))::INT)) / 32.0 / 255 AS border FROM p GROUP BY vec_id),
b AS (SELECT vec_id, h * 32 // 180 AS bin, count(*) AS n FROM p WHERE s / 255 > 0.15 GROUP BY ALL),
e AS (SELECT vec_id, -sum(q * log2(q)) / 5 AS entropy FROM (SELECT vec_id, n / sum(n) OVER (PARTITION BY vec_id) AS q FROM b) GROUP BY vec_id)
SELECT vec_id, round(coalesce(entropy, 0), 6) AS entropy, round(red, 6) AS red, round(border, 6) AS border FROM f LEFT JOIN e USING (vec_id)""",
    "predict_pipeline": _PREDICTED + """SELECT CASE WHEN fit THEN track END AS predicted_intent, fallback_reason, count(*) AS total, count(*) FILTER (gold = CASE WHEN fit AND NOT late THEN letter ELSE 'A' END) AS correct_rows, sum(len(choices)) AS n_choices,
sum(CASE WHEN fit AND NOT late THEN logit END)::DOUBLE AS logits, count(CASE WHEN fit AND NOT late THEN second END) AS margins, count(CASE WHEN fit THEN 1 END) AS routed FROM f WHERE gold IS NOT NULL GROUP BY ALL""",
    "predict_letters_answers": _PREDICTED + "SELECT CASE WHEN fit AND loaded AND NOT late THEN letter ELSE 'A' END AS answer, count(*) AS answers FROM f GROUP BY 1",
}
