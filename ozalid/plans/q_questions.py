"""Queries: choices, guard, gold, prompts and intent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ozalid.operators.choices import choices_of, gold_letter, is_accepted, letters_of
from ozalid.operators.intent import PHRASES, best_label, centroids, nearest_centroid, phrase_track, track_of, track_scores, with_track
from ozalid.operators.prompts import STREAMS, TRACKS, prefix_prompt, system_prompts, user_prompt, with_system_prompt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WIDE = [f"choice_{k}" for k in "ABCD"]
OPTIONS = [f"option_{k}" for k in "ABCD"]


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "dev_metadata").withColumn("choices", choices_of([F.col(c) for c in WIDE]))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "qa_items").withColumn("choices", choices_of([F.col(c) for c in OPTIONS], stripped=False))


def choices_from_wide(spark, sf_dir):
    return metadata(spark, sf_dir).select("query_id", "loaded_at", F.size("choices").alias("n_choices"), letters_of(F.col("choices")).alias("letters"), F.array_join(F.transform("choices", lambda c: c["text"]), "|").alias("texts"))


def choices_from_items(spark, sf_dir):
    return items(spark, sf_dir).select("question_id", "loaded_at", F.size("choices").alias("n_choices"), F.array_join(F.transform("choices", lambda c: c["text"]), "|").alias("texts"))


def choice_set_guard(spark, sf_dir):
    d = metadata(spark, sf_dir)
    return d.groupBy(letters_of(F.col("choices")).alias("letters"), is_accepted(F.col("choices")).alias("accepted"), is_accepted(F.col("choices"), allow_three=True).alias("accepted_with_three")).agg(F.count("*").alias("row_count"))


def gold_resolution(spark, sf_dir):
    return items(spark, sf_dir).select("question_id", "loaded_at", gold_letter(F.col("gt_answer"), F.col("choices")).alias("gold"))


def gold_dropped(spark, sf_dir):
    """Items with and without a gold letter: what an evaluation keeps and skips."""
    gold = items(spark, sf_dir).withColumn("gold", gold_letter(F.col("gt_answer"), F.col("choices")))
    return gold.groupBy(F.coalesce("modality_type", F.lit("unknown")).alias("modality_type")).agg(F.count("*").alias("requested"), F.count("gold").alias("kept"), F.count_if(F.col("gold").isNull()).alias("skipped"))


def prompt_text(spark, sf_dir):
    d = metadata(spark, sf_dir)
    return d.select("query_id", "loaded_at", user_prompt(F.col("question"), F.col("choices")).alias("prompt"), prefix_prompt(F.col("question")).alias("prefix"))


def system_prompt_join(spark, sf_dir):
    """Prompt lengths by stream and track of the events, which stand in for routed queries."""
    e = table(spark, sf_dir, "events")
    routed = e.select("event_id", F.element_at(F.array(*map(F.lit, STREAMS)), (F.col("event_id") % 4 + 1).cast("int")).alias("stream"), F.element_at(F.array(*map(F.lit, TRACKS)), (F.col("user_id") % 5 + 1).cast("int")).alias("track"))
    return with_system_prompt(routed, "stream", "track", system_prompts(spark, {t: t for t in TRACKS}, {s: s for s in STREAMS})).groupBy("stream", "track", "system_prompt").agg(F.count("*").alias("queries"))


#: Phrases that occur in the corpus here; the production ones are those of the intent operator.
TEST_PHRASES = {"diagnostic": ("which diagnosis", "best explains", "finding"), "spatial": ("left half", "right half", "upper border"), "severity": ("grade", "how severe", "degree"), "modality_id": ("acquisition method", "technique", "imaging"), "differential": ("most probable", "rule out")}


def _scores(spark, sf_dir, phrases):
    q = table(spark, sf_dir, "qa_items").select("question_id", "loaded_at", "question")
    return q.withColumn("s", track_scores(F.col("question"), phrases))


def track_regex_scores(spark, sf_dir):
    return _scores(spark, sf_dir, TEST_PHRASES).select("question_id", "loaded_at", *[F.get("s", F.lit(i))["score"].alias(t) for i, t in enumerate(TEST_PHRASES)])


def track_regex_argmax(spark, sf_dir):
    return _scores(spark, sf_dir, TEST_PHRASES).select("question_id", "loaded_at", track_of(F.col("s")).alias("track"), best_label(F.col("s"), "track", "score").alias("always"))


def track_production(spark, sf_dir):
    """Tracks by the production phrases over the questions of both tables."""
    q = table(spark, sf_dir, "qa_items").select("question").unionByName(table(spark, sf_dir, "dev_metadata").select("question"))
    return q.groupBy(F.coalesce(phrase_track(F.col("question")), F.lit("none")).alias("track")).agg(F.count("*").alias("questions"))


def track_with_fallback(spark, sf_dir):
    """Phrases first; where none matches, a stand-in for the encoder: the track of the question's length."""
    q = table(spark, sf_dir, "qa_items").select("question_id", "loaded_at", "question")
    by_length = lambda df: df.withColumn("track", F.element_at(F.array(*map(F.lit, TRACKS)), (F.coalesce(F.length("question"), F.lit(0)) % 5 + 1)))
    return with_track(q, "question", by_length, TEST_PHRASES).select("question_id", "loaded_at", "track")


def _nearest(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return nearest_centroid(e, "embedding", centroids(e, "label", "embedding"))


def centroid_accuracy_by_label(spark, sf_dir):
    n = _nearest(spark, sf_dir).groupBy("label").agg(F.count("*").alias("total"), F.count_if(F.col("predicted") == F.col("label")).alias("correct_rows"))
    return n.withColumn("accuracy", F.round(100 * F.col("correct_rows") / F.col("total"), 6)).orderBy(F.desc("total"), "label")


def centroid_top2_margin(spark, sf_dir):
    return _nearest(spark, sf_dir).select("vec_id", "predicted", F.round("similarity", 6).alias("similarity"), F.round("margin", 6).alias("margin"))


QUERIES = {f.__name__: f for f in (choices_from_wide, choices_from_items, choice_set_guard, gold_resolution, gold_dropped, prompt_text, system_prompt_join, track_regex_scores, track_regex_argmax, track_production, track_with_fallback, centroid_accuracy_by_label, centroid_top2_margin)}

_SP = r"[\s\p{Z}\x{0B}\x{85}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_SP}+|{_SP}+$', '', 'g')"


_CH = ", ".join(f"CASE WHEN {_strip(c)} <> '' THEN {{'letter': '{c[-1]}', 'text': {_strip(c)}}} END" for c in WIDE)
_OP = ", ".join(f"CASE WHEN {c} <> '' THEN {{'letter': '{c[-1]}', 'text': {c}}} END" for c in OPTIONS)
_META = f"WITH d AS (SELECT *, list_filter([{_CH}], lambda c: c IS NOT NULL) AS choices FROM dev_metadata) "
_ITEMS = f"WITH d AS (SELECT *, list_filter([{_OP}], lambda c: c IS NOT NULL) AS choices FROM qa_items) "
_LETTERS = "coalesce(list_aggregate(list_transform(choices, lambda c: c.letter), 'string_agg', ''), '')"
_TEXTS = "coalesce(list_aggregate(list_transform(choices, lambda c: c.text), 'string_agg', '|'), '')"
_GOLD = f"CASE WHEN upper({_strip('gt_answer')}) IN ('A', 'B', 'C', 'D') THEN upper({_strip('gt_answer')}) ELSE list_filter(choices, lambda c: lower({_strip('c.text')}) = lower({_strip('gt_answer')}))[1].letter END"


def _hits(phrases) -> str:
    return " + ".join(f"coalesce(regexp_matches(question, '(?i)(^|[^\\p{{L}}\\p{{N}}_]){p}($|[^\\p{{L}}\\p{{N}}_])')::INT, 0)" for p in phrases)


def _argmax(phrases: dict, otherwise: str) -> str:
    scored = ", ".join(f"{_hits(ps)} AS s{i}" for i, ps in enumerate(phrases.values()))
    best = "greatest(" + ", ".join(f"s{i}" for i in range(len(phrases))) + ")"
    case = "CASE " + " ".join(f"WHEN s{i} = {best} THEN '{t}'" for i, t in enumerate(phrases)) + " END"
    return scored, best, case, otherwise


_SC, _BEST, _CASE, _ = _argmax(TEST_PHRASES, "NULL")
_PSC, _PBEST, _PCASE, _ = _argmax(PHRASES, "NULL")
_CENTROIDS = """
WITH u AS (SELECT vec_id, label, embedding, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM u GROUP BY vec_id),
c AS (SELECT label, list(m ORDER BY i) AS centroid FROM (SELECT label, i, avg(x / n) AS m FROM u JOIN n USING (vec_id) GROUP BY label, i) GROUP BY label),
s AS (SELECT e.vec_id, e.label, c.label AS predicted, round(list_cosine_similarity(e.embedding::DOUBLE[], c.centroid), 9) AS sim FROM embeddings e CROSS JOIN c),
r AS (SELECT *, row_number() OVER w AS k, sim - lead(sim) OVER w AS margin FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY sim DESC, predicted))
"""
ORACLE = {
    "choices_from_wide": _META + f"SELECT query_id, loaded_at, len(choices) AS n_choices, {_LETTERS} AS letters, {_TEXTS} AS texts FROM d",
    "choices_from_items": _ITEMS + f"SELECT question_id, loaded_at, len(choices) AS n_choices, {_TEXTS} AS texts FROM d",
    "choice_set_guard": _META + f"SELECT {_LETTERS} AS letters, {_LETTERS} IN ('AB', 'ABCD') AS accepted, {_LETTERS} IN ('AB', 'ABCD', 'ABC') AS accepted_with_three, count(*) AS row_count FROM d GROUP BY ALL",
    "gold_resolution": _ITEMS + f"SELECT question_id, loaded_at, {_GOLD} AS gold FROM d",
    "gold_dropped": _ITEMS + f"SELECT coalesce(modality_type, 'unknown') AS modality_type, count(*) AS requested, count({_GOLD}) AS kept, count(*) - count({_GOLD}) AS skipped FROM d GROUP BY 1",
    "prompt_text": _META + "SELECT query_id, loaded_at, question || chr(10) || chr(10) || coalesce(list_aggregate(list_transform(choices, lambda c: c.letter || ') ' || c.text), 'string_agg', chr(10)), '') || chr(10) || chr(10) || 'Answer with only the letter.' AS prompt, 'Question: ' || question || ' The answer is' AS prefix FROM d",
    "system_prompt_join": "WITH e AS (SELECT list_value('radiology', 'macroscopic', 'microscopy', 'ultrasound')[event_id % 4 + 1] AS stream, list_value('diagnostic', 'spatial', 'severity', 'modality_id', 'differential')[user_id % 5 + 1] AS track FROM events) SELECT stream, track, track || chr(10) || chr(10) || 'Imaging context: ' || stream AS system_prompt, count(*) AS queries FROM e GROUP BY ALL",
    "track_regex_scores": "SELECT question_id, loaded_at, " + ", ".join(f"{_hits(ps)} AS {t}" for t, ps in TEST_PHRASES.items()) + " FROM qa_items",
    "track_regex_argmax": f"SELECT question_id, loaded_at, CASE WHEN {_BEST} > 0 THEN {_CASE} END AS track, {_CASE} AS always FROM (SELECT *, {_SC} FROM qa_items)",
    "track_production": f"SELECT coalesce(CASE WHEN {_PBEST} > 0 THEN {_PCASE} END, 'none') AS track, count(*) AS questions FROM (SELECT *, {_PSC} FROM (SELECT question FROM qa_items UNION ALL SELECT question FROM dev_metadata)) GROUP BY 1",
    "track_with_fallback": f"SELECT question_id, loaded_at, CASE WHEN {_BEST} > 0 THEN {_CASE} ELSE list_value('diagnostic', 'spatial', 'severity', 'modality_id', 'differential')[coalesce(length(question), 0) % 5 + 1] END AS track FROM (SELECT *, {_SC} FROM qa_items)",
    "centroid_accuracy_by_label": _CENTROIDS + "SELECT label, count(*) AS total, count(*) FILTER (predicted = label) AS correct_rows, round(100.0 * count(*) FILTER (predicted = label) / count(*), 6) AS accuracy FROM r WHERE k = 1 GROUP BY label",
    "centroid_top2_margin": _CENTROIDS + "SELECT vec_id, predicted, round(sim, 6) AS similarity, round(margin, 6) AS margin FROM r WHERE k = 1",
}
