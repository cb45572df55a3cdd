"""From queries and pictures to answers: load, route, preprocess, prompt, score, fall back, report.

Pixels cross into Python once: routing and preprocessing share one Arrow step, whose rows are written to the checkpoint
folder; from then on queries name their picture by `sample`, and pixels are in no shuffle. The scorer is a parameter, a
function of the table of requests and that of the pictures to (query_id, letter, variant, logit) or, with losses,
(query_id, letter, pos, nll), either with the seconds it took, if it measures them. It is called once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ozalid.functions import enhance, features
from ozalid.operators.choices import gold_letter, is_accepted
from ozalid.operators.intent import with_track
from ozalid.operators.prompts import system_prompts, user_prompt, with_system_prompt
from ozalid.operators.routing import DEFAULTS, STREAMS, WEIGHTS
from ozalid.operators.scoring import answers, candidate_losses, fallback_reason, final_answer, letter_scores, only_offered
from ozalid.operators.skew import join_by_share
from ozalid.session import cut_lineage
from ozalid.sources.images import BATCH, unpacked

Scorer = Callable[[DataFrame, DataFrame], DataFrame]
_MEASURED = ("saturation_mean", "saturation_std", "grayscale_deviation", "border_darkness", "texture_roughness", "hue_entropy", "purple_pink_fraction", "blue_ihc_fraction", "skin_red_fraction")
FEATURES = ", ".join(f"{f} double" for f in _MEASURED) + ", has_vignette boolean"


def stream_of(f: dict, native: bool = False, boost: Callable[[dict, dict], dict] | None = None) -> str:
    """The stream of greatest score, the same weights as routing.stream_scores, for use beside the pixels. boost, a
    learned router, may change the scores by stream, given the features."""
    derived = dict(f) | {"grayness": 0.6 * (1 - f["saturation_mean"]) + 0.4 * (1 - f["grayscale_deviation"]), "stain": max(f["purple_pink_fraction"], f["blue_ihc_fraction"]), "vignette": float(f["has_vignette"]), "native": float(native)}
    scores = {s: sum(w * derived[name] for name, w in parts.items()) for s, parts in WEIGHTS.items()}
    scores = boost(f, scores) if boost else scores
    return max(STREAMS, key=lambda s: scores[s])


def route(rgb: np.ndarray) -> tuple[str, str]:
    stream = stream_of(features.measure(rgb))
    return stream, features.subtype(stream, rgb, DEFAULTS[stream])


def image_features(pictures: DataFrame) -> DataFrame:
    """(sample, the ten features, stream, subtype) of pictures; NULLs for what couldn't be loaded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for sample, h, w, d in zip(pdf["sample"], pdf["height"], pdf["width"], pdf["data"], strict=True):
                if d is None:
                    rows.append({"sample": sample})
                    continue
                rgb = unpacked(h, w, d)
                f = features.measure(rgb)
                s = stream_of(f)
                rows.append({"sample": sample, **f, "stream": s, "subtype": features.subtype(s, rgb, DEFAULTS[s])})
            yield pd.DataFrame(rows, columns=["sample", *_MEASURED, "has_vignette", "stream", "subtype"])

    return pictures.select("sample", "height", "width", "data").mapInPandas(run, f"sample string, {FEATURES}, stream string, subtype string")


def _on_canvas(options: dict | None) -> tuple[str | None, str | None, np.ndarray | None]:
    """(stream, subtype, picture) of the gray canvas; NULLs where even that fails."""
    canvas = enhance.gray_canvas()
    try:
        stream, subtype = route(canvas)
        return stream, subtype, enhance.preprocess(canvas, stream, subtype, options)
    except Exception:  # noqa: BLE001 - the last resort is the fallback letter
        return None, None, None


def prepared(pictures: DataFrame, options: dict | None = None) -> DataFrame:
    """(sample, stream, subtype, height, width, data, load_error, stage_error): normalised, bounded, routed and
    preprocessed in one step. What can't be loaded becomes a gray canvas, as does what fails on the way; where the canvas
    fails, too, stream and data are NULL."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), BATCH):
                rows = []
                for sample, h, w, d, e in zip(*[pdf[c].iloc[i : i + BATCH] for c in ("sample", "height", "width", "data", "load_error")], strict=True):
                    failed = out = stream = subtype = None
                    if d is not None:
                        try:
                            rgb = unpacked(h, w, d)
                            stream, subtype = route(rgb)
                            out = enhance.preprocess(rgb, stream, subtype, options)
                        except Exception as x:  # noqa: BLE001 - the row goes on with a gray canvas
                            failed = f"{type(x).__name__}: {x}"[:500]
                            out = None
                    if out is None:
                        stream, subtype, out = _on_canvas(options)
                    size = out.shape[:2] if out is not None else (None, None)
                    rows.append((sample, stream, subtype, *size, np.ascontiguousarray(out).tobytes() if out is not None else None, e if d is None else None, failed))
                yield pd.DataFrame(rows, columns=["sample", "stream", "subtype", "height", "width", "data", "load_error", "stage_error"])

    return pictures.select("sample", "height", "width", "data", "load_error").mapInPandas(run, "sample string, stream string, subtype string, height int, width int, data binary, load_error string, stage_error string")


def _with_picture(queries: DataFrame, images: DataFrame) -> DataFrame:
    """queries with what is known of their picture (all but its pixels) and whether it was loaded; those without one get
    what is known of the gray canvas. A picture that many queries share is joined apart."""
    stream, subtype, canvas = _on_canvas(None)
    known = images.select("sample", "stream", "subtype", F.col("data").isNotNull().alias("has_pixels"), (F.col("load_error").isNull() & F.col("data").isNotNull()).alias("loaded"), "stage_error")
    named = queries.filter("sample IS NOT NULL")
    asked = named.groupBy("sample").agg(F.count("*").alias("rows"))
    table = asked.join(known, "sample", "left")
    total = asked.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    met = join_by_share(named, table, "sample", "rows", total)
    every = met.unionByName(queries.filter("sample IS NULL"), allowMissingColumns=True)
    absent = F.col("has_pixels").isNull()
    return every.withColumns({
        "stream": F.when(absent, F.lit(stream)).otherwise(F.col("stream")), "subtype": F.when(absent, F.lit(subtype)).otherwise(F.col("subtype")),
        "loaded": F.coalesce("loaded", F.lit(False)), "has_pixels": F.coalesce("has_pixels", F.lit(canvas is not None)),
    })


def requests(queries: DataFrame, images: DataFrame, fallback_track: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """queries (query_id, sample, question, choices) with track, prompts and what is known of the picture; all queries stay.

    The track is that of the question's phrases; where there are none, what fallback_track (say, the nearest centroid of
    the question's embedding) adds as `track`, by default the diagnostic one.
    """
    by_phrases = with_track(queries, "question", fallback_track or (lambda rest: rest.withColumn("track", F.lit("diagnostic"))))
    asked = by_phrases.withColumn("prompt", user_prompt(F.coalesce("question", F.lit("")), F.col("choices")))
    return with_system_prompt(_with_picture(asked, images), "stream", "track", system_prompts(queries.sparkSession))


def predict(queries: DataFrame, images: DataFrame, scorer: Scorer, by_loss: bool = False, limit_seconds: float = 5.0, allow_three: bool = False, prefix_len: int = 0, fallback_track: Callable[[DataFrame], DataFrame] | None = None, blind: bool = True) -> DataFrame:
    """One row per query: query_id, answer, predicted_modality, subtype, predicted_intent, n_choices,
    fallback_triggered, fallback_reason, top1_logit, top2_logit, logit_margin, inference_time.

    Queries with malformed choices are not scored: nothing but their reason and number of choices is known. Without blind,
    neither are those whose picture couldn't be loaded or failed on the way; with it they are scored on the gray canvas.
    seconds above limit_seconds, or no score at all, count as late: then no logits are told. by_loss: the scorer gives
    token losses, tracks are NULL and nothing is late. query_id is unique.
    """
    kept = cut_lineage(images)
    every = cut_lineage(requests(queries, kept, fallback_track))
    fit = is_accepted(F.col("choices"), allow_three)
    fine = F.col("loaded") & F.col("stage_error").isNull()
    scorable = every.filter(fit & F.col("has_pixels") & (F.lit(True) if blind else fine))
    scored = cut_lineage(scorer(scorable, kept.select("sample", "height", "width", "data")))
    scores = candidate_losses(scored, prefix_len) if by_loss else letter_scores(scored)
    offered = queries.select("query_id", F.explode("choices").alias("c")).select("query_id", "c.letter")
    best = answers(only_offered(scores, offered))
    took = scored.groupBy("query_id").agg(F.max("seconds").alias("inference_time")) if "seconds" in scored.columns else best.select("query_id", F.lit(0.0).alias("inference_time"))
    met = every.join(best, "query_id", "left").join(took, "query_id", "left")
    in_time = F.lit(True) if by_loss else F.col("answer").isNotNull() & (F.coalesce("inference_time", F.lit(0.0)) <= limit_seconds)
    if not blind:
        in_time = in_time | ~fine
    out = met.withColumn("fallback_reason", fallback_reason(fit, F.col("loaded"), F.col("stage_error").isNull(), F.col("has_pixels"), in_time))
    void = F.coalesce(F.col("fallback_reason").isin("malformed_choices", "pipeline_failed_on_gray_canvas"), F.lit(False))
    late = F.coalesce(F.col("fallback_reason").endswith("inference_timeout"), F.lit(False))
    seen = {"predicted_modality": F.col("stream"), "subtype": F.col("subtype"), "predicted_intent": F.lit(None).cast("string") if by_loss else F.col("track")}
    return out.select(
        "query_id", final_answer(F.col("answer"), F.col("fallback_reason")).alias("answer"), *[F.when(~void, c).alias(name) for name, c in seen.items()], F.size("choices").alias("n_choices"),
        F.col("fallback_reason").isNotNull().alias("fallback_triggered"), F.coalesce("fallback_reason", F.lit("")).alias("fallback_reason"), *[F.when(~void & ~late, F.col(c)).alias(c) for c in ("top1_logit", "top2_logit", "logit_margin")], F.coalesce("inference_time", F.lit(0.0)).alias("inference_time"),
    )


def predict_letters(queries: DataFrame, images: DataFrame, scorer: Scorer, limit_seconds: float = 5.0, allow_three: bool = False) -> DataFrame:
    """(query_id, answer) as a competition asks for: a picture that can't be loaded decides before the choices are looked
    at, and any failure gives the fallback letter without the scorer."""
    return predict(queries, images, scorer, limit_seconds=limit_seconds, allow_three=allow_three, blind=False).select("query_id", "answer")


def evaluate(predictions: DataFrame, items: DataFrame) -> DataFrame:
    """The evaluation log: predictions of items whose gold letter is known, with gold and correct.

    items: query_id, gt_answer, choices, and what else is wanted of them.
    """
    gold = items.withColumn("gold", gold_letter(F.col("gt_answer"), F.col("choices"))).filter("gold IS NOT NULL")
    return predictions.join(gold.drop("choices"), "query_id").withColumn("correct", F.col("answer") == F.col("gold"))
