"""Queries: scores to answers, fallbacks, evaluation, extensions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ozalid.functions.scalars import python_bool, seconds_text
from ozalid.operators import evaluation as ev
from ozalid.operators.choices import choices_of, is_accepted
from ozalid.operators.scoring import answers, candidate_losses, fallback_reason, final_answer, letter_scores, only_offered
from ozalid.plans.q_questions import WIDE, table
from ozalid.streaming.predict import latency_windows


def _letter(c):
    return F.element_at(F.array(*map(F.lit, "ABCD")), (c % 4 + 1).cast("int"))


def letter_logit_argmax(spark, sf_dir):
    """Order lines as letters with three token variants; only letters up to D that an order offers count."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), _letter(F.col("l_linenumber") - 1).alias("letter"), F.col("l_suppkey").alias("s"), F.explode(F.array(F.col("l_tax") * 50, F.col("l_discount") * 40, F.col("l_quantity") / 10)).alias("logit"))
    offered = li.filter(F.col("s") % 7 != 0).select("query_id", "letter").distinct()
    got = answers(only_offered(letter_scores(li.select("query_id", "letter", "logit")), offered))
    return got.select("query_id", "answer", *[F.round(c, 6).alias(c) for c in ("top1_logit", "top2_logit", "logit_margin")])


def prefix_loss_argmin(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), _letter(F.col("l_suppkey")).alias("letter"), F.col("l_linenumber").alias("pos"), (F.col("l_discount") * 100).cast("long").alias("nll"))
    got = answers(candidate_losses(li, 2))
    return got.select("query_id", "answer", F.round("top1_logit", 6).alias("top1_logit"), F.round("logit_margin", 6).alias("logit_margin"))


def fallback_reason_counts(spark, sf_dir):
    d = table(spark, sf_dir, "dev_metadata").withColumn("choices", choices_of([F.col(c) for c in WIDE]))
    n = F.substring("query_id", 3, 8).cast("long")
    reason = fallback_reason(is_accepted(F.col("choices")), F.coalesce(F.col("image") != "", F.lit(False)), n % 11 != 0, n % 22 != 0, n % 7 != 0)
    e = d.withColumn("reason", reason)
    return e.groupBy(F.coalesce("reason", F.lit("")).alias("fallback_reason"), final_answer(_letter(n), F.col("reason")).alias("answer")).agg(F.count("*").alias("row_count"))


def _diag(spark, sf_dir):
    return table(spark, sf_dir, "diagnostics")


def accuracy_overall(spark, sf_dir):
    return ev.summary(_diag(spark, sf_dir))


def accuracy_by_stratum(spark, sf_dir):
    return ev.summary(_diag(spark, sf_dir), ["modality", "n_choices"]).orderBy(F.desc("total"), "modality", "n_choices")


def accuracy_grouping_sets(spark, sf_dir):
    return ev.strata(_diag(spark, sf_dir), ["modality", "n_choices"])


def evaluation_report(spark, sf_dir):
    """The whole report; rows without a gold letter count as skipped. Intervals, which no other engine draws alike, as
    whether they hold the accuracy and are at most as wide as chance allows."""
    d = _diag(spark, sf_dir)
    r = ev.report(d.filter("gold IS NOT NULL AND correct IS NOT NULL"), d, ["modality", "n_choices"])
    inside = F.col("accuracy").isNull() | ((F.col("low") <= F.col("accuracy") + 1e-9) & (F.col("high") >= F.col("accuracy") - 1e-9) & (F.col("high") - F.col("low") <= 250 / F.sqrt("total")))
    return r.select("key", "value", "requested", "total", "skipped", "correct_rows", "accuracy", "fallback_rate", "mean_time", inside.alias("inside"))


def latency_by_window(spark, sf_dir):
    """The windows of the stream of diagnostics, over the table as one batch."""
    w = latency_windows(_diag(spark, sf_dir).select("logged_at", "modality", "fallback_triggered", "inference_time"))
    return w.select("start", "end", "modality", "row_count", "fallbacks", F.round("mean_time", 9).alias("mean_time"))


def run_objective(spark, sf_dir):
    s = ev.summary(_diag(spark, sf_dir), ["run_id"])
    return s.select("run_id", F.round(ev.objective(F.col("accuracy"), F.col("mean_time"), 0.5), 6).alias("objective"))


def bootstrap_ci(spark, sf_dir):
    """Intervals per modality by binomial draws (10 000 resamples)."""
    return ev.bootstrap(_diag(spark, sf_dir), ["modality"])


def bootstrap_ci_portable(spark, sf_dir):
    """The md5 draw, whose rows any engine can repeat, over the accuracy of the runs (few rows by nature)."""
    runs = ev.summary(_diag(spark, sf_dir).filter("run_id IS NOT NULL"), ["run_id"])
    flags = runs.select((F.row_number().over(Window.orderBy("run_id")) - 1).alias("i"), (F.col("accuracy") >= 60).cast("int").alias("f"))  # one row per run
    return ev.bootstrap_portable(flags, 200)


def submission_rows(spark, sf_dir):
    d = _diag(spark, sf_dir)
    return d.select("query_id", F.coalesce("answer", F.lit("A")).alias("answer"), seconds_text(F.col("inference_time")).alias("inference_time"), F.col("run_id"), F.col("logged_at"))


def diagnostic_rows(spark, sf_dir):
    d = _diag(spark, sf_dir)
    return d.select("query_id", "run_id", "logged_at", "answer", "gold", python_bool(F.col("correct")).alias("correct"), "n_choices", python_bool(F.col("fallback_triggered")).alias("fallback_triggered"), F.coalesce("fallback_reason", F.lit("")).alias("fallback_reason"))


# -- extensions: beside what the pipeline itself does ---------------------------------------------------------------


def position_bias(spark, sf_dir):
    d = _diag(spark, sf_dir).filter("answer IS NOT NULL")
    return d.groupBy("answer").agg(F.count("*").alias("answered"), F.count_if(F.col("gold") == F.col("answer")).alias("right"), F.round(100 * F.avg((F.col("gold") == F.col("answer")).cast("int")), 6).alias("precision"))


def mcnemar(spark, sf_dir):
    """The hot run against all others, per question: right at least once."""
    d = _diag(spark, sf_dir).filter("correct IS NOT NULL")
    best = lambda x: x.groupBy("query_id").agg(F.bool_or("correct").alias("correct"))
    return ev.mcnemar(best(d.filter("run_id = 'run-0017'")), best(d.filter("run_id <> 'run-0017'")), "query_id")


def calibration(spark, sf_dir):
    d = _diag(spark, sf_dir).filter("NOT isnan(logit_margin)").withColumn("confidence", F.round(1 / (1 + F.exp(-F.col("logit_margin"))), 6))
    return ev.calibration_error(d, "confidence", "correct")


def visual_reliance(spark, sf_dir):
    """Accuracy with and without fallback, as real and blind runs, against chance by number of choices."""
    d = _diag(spark, sf_dir).filter("correct IS NOT NULL AND n_choices > 0")
    s = d.groupBy("n_choices").agg(F.avg(F.when(~F.col("fallback_triggered"), F.col("correct").cast("int"))).alias("real"), F.avg(F.when(F.col("fallback_triggered"), F.col("correct").cast("int"))).alias("blind"))
    return s.select("n_choices", F.round(ev.visual_reliance(F.col("real"), F.col("blind"), 1.0 / F.col("n_choices")), 6).alias("reliance"))


def latency_percentiles(spark, sf_dir):
    d = _diag(spark, sf_dir)
    return d.groupBy("modality").agg(F.round(F.percentile("inference_time", F.lit(0.5)), 8).alias("p50"), F.round(F.percentile("inference_time", F.lit(0.95)), 8).alias("p95"), F.round(100 * F.avg((F.col("inference_time") > 5.0).cast("int")), 6).alias("timeout_rate"))


def null_prompt_calibration(spark, sf_dir):
    """Softmax of an order's line scores over the prior of each letter, which is its share of all lines."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), _letter(F.col("l_linenumber") - 1).alias("letter"), (F.col("l_discount") * 40).alias("logit"))
    s = letter_scores(li)
    prior = li.groupBy("letter").agg(F.count("*").alias("n"))
    total = prior.agg(F.sum("n").alias("t"))
    w = Window.partitionBy("query_id")
    p = F.exp("score") / F.sum(F.exp("score")).over(w)
    both = s.withColumn("p", p).join(F.broadcast(prior.crossJoin(total)), "letter")  # four letters
    return answers(both.select("query_id", "letter", F.round(F.col("p") / (F.col("n") / F.col("t")), 6).alias("score"))).select("query_id", "answer", F.col("top1_logit").alias("score"))


def cyclic_ensemble(spark, sf_dir):
    """Scores of the four cyclic shifts of an order's options, added up by original letter."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_linenumber") % 4).alias("place"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("shift"), (F.col("l_discount") * 100).cast("long").alias("points"))
    back = _letter((F.col("place") + 4 - F.col("shift")) % 4)
    sums = li.groupBy("query_id", back.alias("letter")).agg(F.sum(F.col("points") * (F.col("shift") + 1)).cast("double").alias("score"))
    return answers(sums).select("query_id", "answer", F.col("top1_logit").alias("score"))


def soft_route(spark, sf_dir):
    """Answers whose margin is below 0.5 are routed softly."""
    d = _diag(spark, sf_dir)
    soft = F.col("logit_margin").isNull() | F.isnan("logit_margin") | (F.col("logit_margin") < 0.5)
    return d.groupBy(soft.alias("soft")).agg(F.count("*").alias("row_count"))


QUERIES = {f.__name__: f for f in (letter_logit_argmax, prefix_loss_argmin, fallback_reason_counts, accuracy_overall, accuracy_by_stratum, accuracy_grouping_sets, evaluation_report, latency_by_window, run_objective, bootstrap_ci, bootstrap_ci_portable, submission_rows, diagnostic_rows, position_bias, mcnemar, calibration, visual_reliance, latency_percentiles, null_prompt_calibration, cyclic_ensemble, soft_route)}

from ozalid.plans.q_questions import _LETTERS, _META  # noqa: E402

_L = "list_value('A', 'B', 'C', 'D')"
_SUMMARY = "count(*) AS total, coalesce(sum(correct::INT), 0) AS correct_rows, round(100 * avg(correct::INT), 6) AS accuracy, round(100 * avg(fallback_triggered::INT), 6) AS fallback_rate, round(avg(inference_time), 4) AS mean_time"
_RANKED = "SELECT query_id, letter, score, row_number() OVER w AS k, lead(score) OVER w AS next FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, letter)"
ORACLE = {
    "letter_logit_argmax": f"""WITH l AS (SELECT l_orderkey AS query_id, {_L}[(l_linenumber - 1) % 4 + 1] AS letter, l_suppkey, greatest(l_tax * 50, l_discount * 40, l_quantity / 10) AS logit FROM lineitem),
s AS (SELECT query_id, letter, max(logit) AS score FROM l GROUP BY ALL HAVING count(*) FILTER (l_suppkey % 7 <> 0) > 0), r AS ({_RANKED})
SELECT query_id, letter AS answer, round(score, 6) AS top1_logit, round(next, 6) AS top2_logit, round(score - next, 6) AS logit_margin FROM r WHERE k = 1""",
    "prefix_loss_argmin": f"""WITH s AS (SELECT l_orderkey AS query_id, {_L}[l_suppkey % 4 + 1] AS letter, 0 - avg(trunc(l_discount * 100)::BIGINT) AS score FROM lineitem WHERE l_linenumber >= 2 GROUP BY ALL), r AS ({_RANKED})
SELECT query_id, letter AS answer, round(score, 6) AS top1_logit, round(score - next, 6) AS logit_margin FROM r WHERE k = 1""",
    "fallback_reason_counts": _META + f""", n AS (SELECT *, substr(query_id, 3, 8)::BIGINT AS n, {_LETTERS} IN ('AB', 'ABCD') AS ok, coalesce(image <> '', false) AS loaded FROM d),
t AS (SELECT *, CASE WHEN (NOT loaded OR n % 11 = 0) AND n % 22 = 0 THEN 'pipeline_failed_on_gray_canvas' WHEN NOT loaded THEN 'image_load_failed' WHEN n % 11 = 0 THEN 'pipeline_stage_failed' END AS state FROM n),
u AS (SELECT *, CASE WHEN NOT ok THEN 'malformed_choices' WHEN state = 'pipeline_failed_on_gray_canvas' THEN state WHEN n % 7 = 0 THEN coalesce(state || '+', '') || 'inference_timeout' ELSE coalesce(state, '') END AS fallback_reason FROM t)
SELECT fallback_reason, CASE WHEN fallback_reason IN ('malformed_choices', 'pipeline_failed_on_gray_canvas') OR fallback_reason LIKE '%inference_timeout' THEN 'A' ELSE {_L}[n % 4 + 1] END AS answer, count(*) AS row_count FROM u GROUP BY ALL""",
    "accuracy_overall": f"SELECT {_SUMMARY} FROM diagnostics",
    "latency_by_window": """SELECT time_bucket(INTERVAL '10 minutes', logged_at) AS start, time_bucket(INTERVAL '10 minutes', logged_at) + INTERVAL '10 minutes' AS "end", modality, count(*) AS row_count,
count(*) FILTER (fallback_triggered) AS fallbacks, round(avg(inference_time), 9) AS mean_time FROM diagnostics WHERE logged_at IS NOT NULL GROUP BY ALL""",
    "evaluation_report": f"""WITH d AS (SELECT *, gold IS NOT NULL AND correct IS NOT NULL AS kept, unnest([{{'key': 'all', 'value': NULL::VARCHAR}}, {{'key': 'modality', 'value': modality}}, {{'key': 'n_choices', 'value': n_choices::VARCHAR}}]) AS c FROM diagnostics)
SELECT c.key AS key, c.value AS value, count(*) AS requested, count(*) FILTER (kept) AS total, count(*) FILTER (NOT kept) AS skipped, coalesce(sum(correct::INT) FILTER (kept), 0) AS correct_rows, round(100 * avg(correct::INT) FILTER (kept), 6) AS accuracy,
round(100 * avg(fallback_triggered::INT) FILTER (kept), 6) AS fallback_rate, round(avg(inference_time) FILTER (kept), 4) AS mean_time, true AS inside FROM d GROUP BY c.key, c.value""",
    "accuracy_by_stratum": f"SELECT modality, n_choices, {_SUMMARY} FROM diagnostics GROUP BY ALL",
    "accuracy_grouping_sets": "SELECT CASE WHEN grouping(modality) = 0 THEN 'modality' WHEN grouping(n_choices) = 0 THEN 'n_choices' ELSE 'all' END AS key, CASE WHEN grouping(modality) = 0 THEN modality WHEN grouping(n_choices) = 0 THEN n_choices::VARCHAR END AS value, count(*) AS total, coalesce(sum(correct::INT), 0) AS correct_rows, round(100 * avg(correct::INT), 6) AS accuracy FROM diagnostics GROUP BY GROUPING SETS ((modality), (n_choices), ())",
    "run_objective": "SELECT run_id, round(round(100 * avg(correct::INT), 6) - 0.5 * round(avg(inference_time), 4), 6) AS objective FROM diagnostics GROUP BY run_id",
    "bootstrap_ci_portable": """WITH a AS (SELECT run_id, round(100 * avg(correct::INT), 6) AS accuracy FROM diagnostics WHERE run_id IS NOT NULL GROUP BY run_id),
f AS (SELECT row_number() OVER (ORDER BY run_id) - 1 AS i, (accuracy >= 60)::INT AS f FROM a), n AS (SELECT count(*) AS n FROM f), b AS (SELECT unnest(range(200)) AS b),
d AS (SELECT b, ('0x' || substr(md5('42|' || b || '|' || i), 1, 8))::BIGINT % n AS j FROM f CROSS JOIN b CROSS JOIN n), m AS (SELECT b, avg(f.f) AS m FROM d JOIN f ON f.i = d.j GROUP BY b)
SELECT (SELECT n FROM n) AS n, round(100 * quantile_cont(m, 0.025), 6) AS low, round(100 * quantile_cont(m, 0.975), 6) AS high FROM m""",
    "submission_rows": "SELECT query_id, coalesce(answer, 'A') AS answer, printf('%.4f', inference_time) AS inference_time, run_id, logged_at FROM diagnostics",
    "diagnostic_rows": "SELECT query_id, run_id, logged_at, answer, gold, CASE WHEN correct THEN 'True' WHEN NOT correct THEN 'False' END AS correct, n_choices, CASE WHEN fallback_triggered THEN 'True' WHEN NOT fallback_triggered THEN 'False' END AS fallback_triggered, coalesce(fallback_reason, '') AS fallback_reason FROM diagnostics",
    "position_bias": "SELECT answer, count(*) AS answered, count(*) FILTER (gold = answer) AS \"right\", round(100 * avg((gold = answer)::INT), 6) AS precision FROM diagnostics WHERE answer IS NOT NULL GROUP BY answer",
    "mcnemar": """WITH a AS (SELECT query_id, bool_or(correct) AS c FROM diagnostics WHERE correct IS NOT NULL AND run_id = 'run-0017' GROUP BY 1), b AS (SELECT query_id, bool_or(correct) AS c FROM diagnostics WHERE correct IS NOT NULL AND run_id <> 'run-0017' GROUP BY 1),
n AS (SELECT count(*) FILTER (a.c AND NOT b.c) AS only_a, count(*) FILTER (NOT a.c AND b.c) AS only_b FROM a JOIN b USING (query_id))
SELECT only_a, only_b, round(CASE WHEN only_a + only_b > 0 THEN greatest(abs(only_a - only_b) - 1, 0) ** 2 / (only_a + only_b) ELSE 0 END, 6) AS statistic FROM n""",
    "calibration": """WITH c AS (SELECT round(1 / (1 + exp(-logit_margin)), 6) AS c, correct::INT AS k FROM diagnostics WHERE NOT isnan(logit_margin) AND correct IS NOT NULL), b AS (SELECT least(9, floor(c * 10)) AS bin, count(*) AS n, avg(c) AS c, avg(k) AS k FROM c GROUP BY 1)
SELECT coalesce(sum(n), 0) AS rows, round(sum(n * abs(c - k)) / sum(n), 6) AS ece FROM b""",
    "visual_reliance": "SELECT n_choices, round((r - b) / greatest(r - 1.0 / n_choices, 1e-6), 6) AS reliance FROM (SELECT n_choices, avg(correct::INT) FILTER (NOT fallback_triggered) AS r, avg(correct::INT) FILTER (fallback_triggered) AS b FROM diagnostics WHERE correct IS NOT NULL AND n_choices > 0 GROUP BY 1)",
    "latency_percentiles": "SELECT modality, round(quantile_cont(inference_time, 0.5), 8) AS p50, round(quantile_cont(inference_time, 0.95), 8) AS p95, round(100 * avg((inference_time > 5.0)::INT), 6) AS timeout_rate FROM diagnostics GROUP BY modality",
    "null_prompt_calibration": f"""WITH l AS (SELECT l_orderkey AS query_id, {_L}[(l_linenumber - 1) % 4 + 1] AS letter, l_discount * 40 AS logit FROM lineitem), m AS (SELECT query_id, letter, max(logit) AS x FROM l GROUP BY ALL),
q AS (SELECT letter, count(*) / (SELECT count(*) FROM l) AS prior FROM l GROUP BY 1), s AS (SELECT query_id, letter, round(exp(x) / sum(exp(x)) OVER (PARTITION BY query_id) / prior, 6) AS score FROM m JOIN q USING (letter)), r AS ({_RANKED})
SELECT query_id, letter AS answer, score FROM r WHERE k = 1""",
    "cyclic_ensemble": f"""WITH s AS (SELECT l_orderkey AS query_id, {_L}[(l_linenumber % 4 + 4 - shift) % 4 + 1] AS letter, sum(trunc(l_discount * 100)::BIGINT * (shift + 1))::DOUBLE AS score FROM lineitem CROSS JOIN (SELECT unnest(range(4)) AS shift) GROUP BY ALL), r AS ({_RANKED})
SELECT query_id, letter AS answer, score FROM r WHERE k = 1""",
    "soft_route": "SELECT logit_margin IS NULL OR isnan(logit_margin) OR logit_margin < 0.5 AS soft, count(*) AS row_count FROM diagnostics GROUP BY 1",
}
