"""Prompts: the question with its choices, system prompts per (stream, track), loss prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ozalid.operators.choices import choice_lines

STREAMS = ("radiology", "macroscopic", "microscopy", "ultrasound")
TRACKS = ("diagnostic", "spatial", "severity", "modality_id", "differential")
CLOSING = "Answer with only the letter."

_TRACK_TEXT = {
    "diagnostic": "Name the condition that the picture shows best.",
    "spatial": "Decide where in the picture, or on which side, the change lies.",
    "severity": "Judge how far the disease has advanced by the scale that the question names.",
    "modality_id": "Recognise how the picture was acquired.",
    "differential": "Weigh the options against each other and find the one that the question singles out.",
}
_STREAM_TEXT = {
    "radiology": "a grey-scale projection or section image",
    "macroscopic": "a colour photograph of tissue or skin",
    "microscopy": "a stained section under the microscope",
    "ultrasound": "an echo or interference image with speckle",
}


def user_prompt(question: Column, choices: Column) -> Column:
    return F.concat(question, F.lit("\n\n"), choice_lines(choices), F.lit(f"\n\n{CLOSING}"))


def prefix_prompt(question: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit(" The answer is"))


def system_prompts(spark: SparkSession, tracks: dict[str, str] | None = None, streams: dict[str, str] | None = None) -> DataFrame:
    """(stream, track, system_prompt): the product of two small fixed tables."""
    t = spark.createDataFrame(list((tracks or _TRACK_TEXT).items()), "track string, track_text string")
    s = spark.createDataFrame(list((streams or _STREAM_TEXT).items()), "stream string, stream_text string")
    both = s.crossJoin(F.broadcast(t))
    return both.select("stream", "track", F.concat("track_text", F.lit("\n\nImaging context: "), "stream_text").alias("system_prompt"))


def with_system_prompt(df: DataFrame, stream: str, track: str, prompts: DataFrame) -> DataFrame:
    """df with system_prompt; prompts has one row per (stream, track), 20 in all unless tables are given."""
    table = F.broadcast(prompts.select(F.col("stream").alias("_s"), F.col("track").alias("_t"), "system_prompt"))
    return df.join(table, (F.col(stream) == F.col("_s")) & (F.col(track) == F.col("_t")), "left").drop("_s", "_t")
