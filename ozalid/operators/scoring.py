"""From letter logits or token losses to an answer, and the states in which an answer falls back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FALLBACK_LETTER = "A"


def letter_scores(logits: DataFrame) -> DataFrame:
    """(query_id, letter, score): the greatest logit over the token variants of each letter."""
    return logits.groupBy("query_id", "letter").agg(F.max("logit").alias("score"))


def candidate_losses(losses: DataFrame, prefix_len: int | Column) -> DataFrame:
    """(query_id, letter, score): minus the mean loss of the tokens after the prefix."""
    after = losses.filter(F.col("pos") >= prefix_len)
    return after.groupBy("query_id", "letter").agg((-F.avg("nll")).alias("score"))


def only_offered(scores: DataFrame, offered: DataFrame) -> DataFrame:
    """The scores of letters that a query offers. offered: query_id, letter."""
    return scores.join(offered.select("query_id", "letter"), ["query_id", "letter"], "left_semi")


def answers(scores: DataFrame) -> DataFrame:
    """(query_id, answer, top1_logit, top2_logit, logit_margin): the best letter, ties to the earlier one.

    One shuffle, on query_id; a query has a handful of letters. top2 and margin are NULL for a single letter.
    """
    every = F.collect_list(F.struct(F.col("score"), F.col("letter")))
    ranked = F.array_sort(every, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["letter"] < b["letter"], -1).when(a["letter"] > b["letter"], 1).otherwise(0))
    top = scores.groupBy("query_id").agg(ranked.alias("_r"))
    one, two = F.get("_r", F.lit(0)), F.get("_r", F.lit(1))
    return top.select("query_id", one["letter"].alias("answer"), one["score"].alias("top1_logit"), two["score"].alias("top2_logit"), (one["score"] - two["score"]).alias("logit_margin"))


def fallback_reason(accepted: Column, loaded: Column, stage_ok: Column, gray_ok: Column, in_time: Column) -> Column:
    """Why an answer fell back, NULL if it didn't: malformed choices first; then image and stage states, to which a
    timeout is joined with '+'; a timeout alone last. What can't be loaded or fails is tried on a gray canvas once: gray_ok
    says whether that went well."""
    state = F.when((~loaded | ~stage_ok) & ~gray_ok, F.lit("pipeline_failed_on_gray_canvas")).when(~loaded, F.lit("image_load_failed")).when(~stage_ok, F.lit("pipeline_stage_failed"))
    ended = state == F.lit("pipeline_failed_on_gray_canvas")
    late = F.when(state.isNull(), F.lit("inference_timeout")).otherwise(F.concat(state, F.lit("+inference_timeout")))
    return F.when(~accepted, F.lit("malformed_choices")).when(F.coalesce(ended, F.lit(False)), state).when(~in_time, late).otherwise(state)


def final_answer(answer: Column, reason: Column) -> Column:
    """The answer, or the fallback letter where none was made or what was made doesn't count."""
    void = reason.isin("malformed_choices", "pipeline_failed_on_gray_canvas") | reason.endswith("inference_timeout")
    return F.when(F.coalesce(void, F.lit(False)), F.lit(FALLBACK_LETTER)).otherwise(F.coalesce(answer, F.lit(FALLBACK_LETTER)))
