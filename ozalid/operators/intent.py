"""What a question asks for: phrases first, nearest centroid for the rest."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ozalid.functions.scalars import total

# The phrases of each track, in the order in which ties are decided.
PHRASES = {
    "diagnostic": ("what is the diagnosis", "which condition", "most likely disease", "most likely diagnosis", "what is the most likely"),
    "spatial": ("which lobe", "located in", "left or right", "which quadrant", "which side", "anatomical location"),
    "severity": ("grade", "stage", "severity", "bi-rads", "birads", "how advanced", "gleason", "tnm", "fitzpatrick", "isup"),
    "modality_id": ("what imaging modality", "which sequence", "contrast used", "imaging technique", "which modality", "what type of scan"),
    "differential": ("which of the following is not", "best explains", "most consistent with", "rule out", "differential diagnosis"),
}


def phrase_pattern(phrase: str) -> str:
    """phrase as whole words, any case; the boundaries hold for letters of every script in Java, Python and RE2 alike."""
    return rf"(?i)(^|[^\p{{L}}\p{{N}}_]){re.escape(phrase)}($|[^\p{{L}}\p{{N}}_])".replace(r"\ ", " ").replace(r"\-", "-")


def track_scores(question: Column, phrases: dict[str, tuple[str, ...]] = PHRASES) -> Column:
    """array<struct<track, score>>: how many different phrases of each track the question has, 0 for NULL."""
    hit = {t: total([F.coalesce(question.rlike(phrase_pattern(p)), F.lit(False)).cast("int") for p in ps]) for t, ps in phrases.items()}
    return F.array(*[F.struct(F.lit(t).alias("track"), s.alias("score")) for t, s in hit.items()])


def _best(scores: Column, label: str, score: str) -> Column:
    """struct<s, i, l> of the greatest score, of equal ones the earliest; scores is evaluated once."""
    return F.array_max(F.transform(scores, lambda x, i: F.struct(x[score].alias("s"), (-i).alias("i"), x[label].alias("l"))))


def best_label(scores: Column, label: str, score: str) -> Column:
    """The label of the greatest score; of equal ones the earliest."""
    return _best(scores, label, score)["l"]


def phrase_track(question: Column, phrases: dict[str, tuple[str, ...]] = PHRASES) -> Column:
    """The track with most phrases, NULL if there is none at all."""
    return track_of(track_scores(question, phrases))


def track_of(scores: Column) -> Column:
    """The track with most phrases of track_scores, NULL if there is none at all."""
    best = F.array(_best(scores, "track", "score"))
    return F.get(F.filter(best, lambda b: b["s"] > 0), F.lit(0))["l"]


def with_track(df: DataFrame, question: str, fallback, phrases: dict[str, tuple[str, ...]] = PHRASES, out: str = "track") -> DataFrame:
    """df with out: the phrase track, or what `fallback` (DataFrame -> DataFrame with out) says where no phrase matches.

    The rows are split first, so the fallback, which may be a model, never sees a row that phrases decide.
    """
    tagged = df.withColumn(out, phrase_track(F.col(question), phrases))
    return tagged.filter(F.col(out).isNotNull()).unionByName(fallback(tagged.filter(F.col(out).isNull()).drop(out)))


# -- centroids -------------------------------------------------------------------------------------------------------


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centroid): the mean of the unit vectors of each label, itself not scaled; labels are few."""
    unit = df.filter(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(label).alias("label"), F.expr(f"transform({vector}, x -> cast(x as double) / sqrt(aggregate({vector}, 0D, (s, y) -> s + cast(y as double) * cast(y as double))))").alias("_u"))
    means = unit.select("label", F.posexplode("_u").alias("_i", "_x")).groupBy("label", "_i").agg(F.avg("_x").alias("_m"))
    return means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("centroid"))


#: Most centroids that are broadcast; with more the caller needs a search index, not a product.
MOST_CENTROIDS = 10_000


def nearest_centroid(df: DataFrame, vector: str, table: DataFrame, decimals: int = 9) -> DataFrame:
    """df with predicted, similarity and margin (top 1 less top 2, NULL for a single centroid).

    The centroids are broadcast as unit vectors, and a batch of rows meets them in one matrix product, so the rows neither
    multiply nor shuffle. Similarities are rounded before they are compared; ties go to the smallest label. A vector
    without length, or of another length than the centroids, is similar to none: 0. No centroids: NULLs.
    """
    spark = df.sparkSession
    few = sorted(table.limit(MOST_CENTROIDS + 1).collect(), key=lambda r: r["label"])
    if len(few) > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} centroids")
    kind = table.schema["label"].dataType.simpleString()
    matrix = _units([r["centroid"] for r in few], len(few[0]["centroid"]) if few else 0)
    shared = spark.sparkContext.broadcast((matrix, [r["label"] for r in few]))

    @F.pandas_udf(f"predicted {kind}, similarity double, margin double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        matrix, labels = shared.value
        if not labels:
            return pd.DataFrame({"predicted": [None] * len(vectors), "similarity": None, "margin": None})
        near = np.round(_units(vectors.array, matrix.shape[1]) @ matrix.T, decimals)
        order = np.argsort(-near, axis=1, kind="stable")  # labels are sorted, so the smallest comes first
        top = np.take_along_axis(near, order[:, :2], axis=1)
        margin = top[:, 0] - top[:, 1] if len(labels) > 1 else None
        return pd.DataFrame({"predicted": [labels[k] for k in order[:, 0]], "similarity": top[:, 0], "margin": margin})

    found = df.withColumn("_n", nearest(F.col(vector)))
    return found.withColumns({c: F.col(f"_n.{c}") for c in ("predicted", "similarity", "margin")}).drop("_n")


def _units(vectors, width: int) -> np.ndarray:
    """Vectors as rows of length 1; zeros for NULL ones, those without length and those of another width."""
    rows = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == width:
            rows[i] = v
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)
