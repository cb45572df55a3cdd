"""Queries: slices, windows, series, routing and histograms on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ozalid.operators import volumes as vol
from ozalid.operators.routing import best_stream, stream_scores, valid_subtype
from ozalid.plans.q_questions import table


def _slices(spark, sf_dir):
    """Events as volumes: the type is the volume, the day its slice, the value a pixel."""
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return e.filter("value IS NOT NULL").select(F.col("event_type").alias("volume"), day.alias("slice"), "event_id", "value")


def percentile_window(spark, sf_dir):
    s = _slices(spark, sf_dir)
    b = vol.window_bounds(s, ["volume"], "value")
    w = s.join(b, "volume")
    return w.select("event_id", vol.to_byte(F.col("value"), F.col("lo"), F.col("hi"), F.col("least"), F.col("most")).alias("byte"))


def _scores(spark, sf_dir):
    s = _slices(spark, sf_dir)
    step = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("volume", "slice").orderBy("event_id")))
    per = s.withColumn("_e", step).groupBy("volume", "slice").agg(F.round(F.var_pop("value"), 6).alias("variance"), F.round(F.coalesce(F.avg("_e"), F.lit(0.0)), 6).alias("edges"))
    scaled = vol.min_max(vol.min_max(per, "volume", "variance", "v"), "volume", "edges", "e")
    depth = (F.max("slice").over(Window.partitionBy("volume")) + 1).cast("int")
    return scaled.withColumn("score", F.round(F.col("v") + F.col("e"), 6)).withColumn("depth", depth)


def slice_scores_minmax(spark, sf_dir):
    return _scores(spark, sf_dir).select("volume", "slice", "variance", "edges", "score")


def slice_topk_min_gap(spark, sf_dir):
    return vol.pick_slices(_scores(spark, sf_dir), "volume", "slice", "score", "depth")


def fixed_depth_indexes(spark, sf_dir):
    d = spark.range(1, 200).select(F.col("id").cast("int").alias("depth"))
    return d.select("depth", vol.fixed_depths(F.col("depth")).alias("picked"))


def strided_candidates(spark, sf_dir):
    """Days since the first order as slices of one volume per priority: deeper than 128, so strided."""
    o = table(spark, sf_dir, "orders")
    days = o.select("o_orderpriority", F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).alias("day")).distinct()
    return vol.candidates(days, "o_orderpriority", "day")


def series_order(spark, sf_dir):
    """Lines of an order as slices: a number if all lines have one, else a place, else the file."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_orderkey") % 3 != 0, F.col("l_linenumber")).alias("number"), F.when(F.col("l_suppkey") % 50 != 0, F.col("l_extendedprice")).alias("z"), F.concat_ws("/", F.col("l_orderkey"), F.format_string("%09d", F.col("l_partkey")), F.format_string("%09d", F.col("l_suppkey")), F.col("l_linenumber")).alias("path"))
    return vol.series_order(li, "l_orderkey", "number", "z", "path").select("path", "position")


def majority_shape(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat_ws("x", "l_returnflag", "l_linestatus").alias("shape"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("position"))
    return vol.majority_shape(li, "l_orderkey", "shape", "position")


def rescale_invert(spark, sf_dir):
    s = _slices(spark, sf_dir)
    slope = F.when(F.col("event_id") % 5 == 0, F.lit(0.0)).when(F.col("event_id") % 7 != 0, F.lit(2.0))
    intercept = F.when(F.col("event_id") % 3 != 0, F.lit(-10.0))
    scaled = s.withColumn("value", vol.rescaled(F.col("value"), slope, intercept))
    return vol.inverted(scaled, "volume", "value", F.length("volume") % 2 == 0).select("event_id", F.round("value", 6).alias("value"))


def _features(p):
    n = F.col("p_partkey")
    f = {name: ((n * k) % 101).cast("double") / 100.0 for name, k in (("saturation_mean", 7), ("saturation_std", 11), ("grayscale_deviation", 13), ("border_darkness", 17), ("texture_roughness", 19), ("hue_entropy", 23), ("purple_pink_fraction", 29), ("blue_ihc_fraction", 31), ("skin_red_fraction", 37))}
    return f | {"has_vignette": F.col("p_size") % 3 == 0, "native": F.col("p_size") % 5 == 0}


def weighted_stream_scores(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    s = p.withColumn("s", F.transform(stream_scores(_features(p)), lambda x: F.struct(x["stream"].alias("stream"), F.round(x["score"], 6).alias("score"))))
    return s.select("p_partkey", best_stream(F.col("s")).alias("stream"), *[F.get("s", F.lit(i))["score"].alias(k) for i, k in enumerate(("radiology", "macroscopic", "microscopy", "ultrasound"))])


def subtype_default_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    stream = F.element_at(F.array(*map(F.lit, ("radiology", "macroscopic", "microscopy", "ultrasound", "other"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    subtype = F.element_at(F.array(*map(F.lit, ("ct", "fundus", "oct", "nothing"))), (F.col("p_size") % 4 + 1))
    return p.select("p_partkey", valid_subtype(stream, subtype).alias("subtype"))


def hist_entropy(spark, sf_dir):
    """Entropy in base 2 of 32 equal bins, over its greatest value 5."""
    s = _slices(spark, sf_dir)
    top = s.groupBy("volume").agg(F.max("value").alias("m"))
    b = s.join(top, "volume").filter("value >= 0 AND m > 0").select("volume", F.least(F.lit(31), F.floor(F.col("value") / F.col("m") * 32)).alias("bin"))
    n = b.groupBy("volume", "bin").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("volume"))
    return n.withColumn("p", p).groupBy("volume").agg(F.round(-F.sum(F.col("p") * F.log2("p")) / 5, 6).alias("entropy"))


def masked_fraction(spark, sf_dir):
    s = _slices(spark, sf_dir)
    mask, inside = F.col("value") >= 50, F.col("value").between(60, 90)
    return s.groupBy("volume", "slice").agg(F.round(F.when(F.count_if(mask) > 0, F.count_if(mask & inside) / F.count_if(mask)).otherwise(0.0), 6).alias("fraction"))


def projection_policies(spark, sf_dir):
    """Other ways to show a volume: its brightest value per pixel column, its middle and its fullest slice."""
    s = _slices(spark, sf_dir).withColumn("cell", F.col("event_id") % 16)
    mip = s.groupBy("volume", "cell").agg(F.max("value").alias("brightest"))
    full = s.groupBy("volume", "slice").agg(F.count_if(F.col("value") > 50).alias("n")).groupBy("volume").agg(F.min(F.struct(-F.col("n"), F.col("slice"))).alias("m"), F.floor((F.max("slice") + 1) / 2).cast("int").alias("middle"))
    return mip.join(full, "volume").select("volume", "cell", F.round("brightest", 6).alias("brightest"), F.col("m.slice").alias("fullest"), "middle")


def ct_keyword_windows(spark, sf_dir):
    """Documents by the window that their text asks for (an extension)."""
    d = table(spark, sf_dir, "documents").withColumn("w", vol.keyword_window(F.col("text")))
    return d.groupBy(F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi")).agg(F.count("*").alias("documents"))


QUERIES = {f.__name__: f for f in (ct_keyword_windows, percentile_window, slice_scores_minmax, slice_topk_min_gap, fixed_depth_indexes, strided_candidates, series_order, majority_shape, rescale_invert, weighted_stream_scores, subtype_default_lookup, hist_entropy, masked_fraction, projection_policies)}

_S = "s AS (SELECT event_type AS volume, date_diff('day', DATE '2024-01-01', ts::DATE) AS slice, event_id, value FROM events WHERE value IS NOT NULL)"
_SCORED = f"""{_S}, d AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY volume, slice ORDER BY event_id)) AS e FROM s),
p AS (SELECT volume, slice, round(var_pop(value), 6) AS variance, round(coalesce(avg(e), 0), 6) AS edges FROM d GROUP BY ALL),
m AS (SELECT *, CASE WHEN max(variance) OVER w - min(variance) OVER w <= 1e-6 THEN 0 ELSE (variance - min(variance) OVER w) / (max(variance) OVER w - min(variance) OVER w) END AS v, CASE WHEN max(edges) OVER w - min(edges) OVER w <= 1e-6 THEN 0 ELSE (edges - min(edges) OVER w) / (max(edges) OVER w - min(edges) OVER w) END AS e, max(slice) OVER w + 1 AS depth FROM p WINDOW w AS (PARTITION BY volume)),
f AS (SELECT *, round(v + e, 6) AS score FROM m)"""
_GAP = "greatest(1, round_even(0.1::DOUBLE * f.depth, 0))"
_N = "p_partkey"
_FX = {k: f"(({_N} * {m}) % 101) / 100.0" for k, m in (("sm", 7), ("ss", 11), ("gd", 13), ("bd", 17), ("tr", 19), ("he", 23), ("pp", 29), ("bi", 31), ("sr", 37))}
_CT = " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(words)}') THEN {c} - {w} // 2" for words, (c, w) in vol.CT_WINDOWS)
_CT_HI = " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(words)}') THEN {c} + {w} // 2" for words, (c, w) in vol.CT_WINDOWS)
ORACLE = {
    "ct_keyword_windows": f"SELECT (CASE {_CT} END)::INT AS lo, (CASE {_CT_HI} END)::INT AS hi, count(*) AS documents FROM documents GROUP BY ALL",
    "percentile_window": f"""WITH {_S}, b AS (SELECT volume, quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi, min(value) AS a, max(value) AS z FROM s GROUP BY 1)
SELECT event_id, trunc(CASE WHEN hi <= lo THEN (value - a) / (CASE WHEN z > a THEN z - a ELSE 1 END) * 255.0 ELSE (least(greatest(value, lo), hi) - lo) / (hi - lo) * 255.0 END)::INT AS byte FROM s JOIN b USING (volume)""",
    "slice_scores_minmax": f"WITH {_SCORED} SELECT volume, slice, variance, edges, score FROM f",
    "slice_topk_min_gap": f"""WITH {_SCORED},
a AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY volume ORDER BY score DESC, slice) = 1),
b AS (SELECT f.* FROM f JOIN a ON f.volume = a.volume WHERE abs(f.slice - a.slice) >= {_GAP} QUALIFY row_number() OVER (PARTITION BY f.volume ORDER BY f.score DESC, f.slice) = 1),
c AS (SELECT f.* FROM f JOIN a ON f.volume = a.volume JOIN b ON f.volume = b.volume WHERE abs(f.slice - a.slice) >= {_GAP} AND abs(f.slice - b.slice) >= {_GAP} QUALIFY row_number() OVER (PARTITION BY f.volume ORDER BY f.score DESC, f.slice) = 1)
SELECT volume, list_sort(list(slice::INT)) AS picked FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY volume""",
    "fixed_depth_indexes": "SELECT d::INT AS depth, [round_even(0.35::DOUBLE * (d - 1), 0)::INT, round_even(0.5::DOUBLE * (d - 1), 0)::INT, round_even(0.65::DOUBLE * (d - 1), 0)::INT] AS picked FROM (SELECT unnest(range(1, 200)) AS d)",
    "strided_candidates": "WITH d AS (SELECT DISTINCT o_orderpriority, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS day FROM orders), m AS (SELECT *, max(day) OVER (PARTITION BY o_orderpriority) + 1 AS depth FROM d) SELECT o_orderpriority, day FROM m WHERE day % CASE WHEN depth <= 128 THEN 1 ELSE depth // 128 END = 0",
    "series_order": """WITH l AS (SELECT l_orderkey, CASE WHEN l_orderkey % 3 <> 0 THEN l_linenumber END AS number, CASE WHEN l_suppkey % 50 <> 0 THEN l_extendedprice END AS z, l_orderkey || '/' || printf('%09d', l_partkey) || '/' || printf('%09d', l_suppkey) || '/' || l_linenumber AS path FROM lineitem),
k AS (SELECT *, CASE WHEN bool_and(number IS NOT NULL) OVER w THEN number WHEN bool_and(z IS NOT NULL) OVER w THEN z END AS k FROM l WINDOW w AS (PARTITION BY l_orderkey))
SELECT path, row_number() OVER (PARTITION BY l_orderkey ORDER BY k NULLS LAST, path) - 1 AS position FROM k""",
    "majority_shape": "WITH c AS (SELECT l_orderkey, l_returnflag || 'x' || l_linestatus AS shape, count(*) AS n, min(l_linenumber * 1000000 + l_partkey) AS p FROM lineitem GROUP BY ALL) SELECT l_orderkey, shape FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, p, shape) = 1",
    "rescale_invert": f"WITH {_S}, r AS (SELECT *, value * CASE WHEN event_id % 5 = 0 THEN 1.0 WHEN event_id % 7 <> 0 THEN 2.0 ELSE 1.0 END + CASE WHEN event_id % 3 <> 0 THEN -10.0 ELSE 0.0 END AS x FROM s) SELECT event_id, round(CASE WHEN length(volume) % 2 = 0 THEN max(x) OVER w + min(x) OVER w - x ELSE x END, 6) AS value FROM r WINDOW w AS (PARTITION BY volume)",
    "weighted_stream_scores": "WITH f AS (SELECT p_partkey, " + ", ".join(f"{v} AS {k}" for k, v in _FX.items()) + ", (p_size % 3 = 0)::INT AS vg, (p_size % 5 = 0)::INT AS nv FROM part), g AS (SELECT *, 0.6 * (1 - sm) + 0.4 * (1 - gd) AS gs, greatest(pp, bi) AS st FROM f), s AS (SELECT p_partkey, round(2.0 * gs + bd + 1.5 * nv - 1.5 * tr, 6) AS radiology, round(2.0 * sm + 1.5 * sr + 1.5 * vg - st, 6) AS macroscopic, round(2.0 * st + 1.2 * he + ss - vg, 6) AS microscopy, round(1.8 * gs + 2.0 * tr + 1.2 * bd - nv, 6) AS ultrasound FROM g) SELECT *, CASE greatest(radiology, macroscopic, microscopy, ultrasound) WHEN radiology THEN 'radiology' WHEN macroscopic THEN 'macroscopic' WHEN microscopy THEN 'microscopy' ELSE 'ultrasound' END AS stream FROM s",
    "subtype_default_lookup": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CASE WHEN s = 'ct' THEN s ELSE 'xray' END WHEN 1 THEN CASE WHEN s = 'fundus' THEN s ELSE 'gross_pathology' END WHEN 2 THEN 'histopathology' WHEN 3 THEN CASE WHEN s = 'oct' THEN s ELSE 'ultrasound' END END AS subtype FROM (SELECT *, ['ct', 'fundus', 'oct', 'nothing'][p_size % 4 + 1] AS s FROM part)",
    "hist_entropy": f"WITH {_S}, b AS (SELECT volume, least(31, floor(value / max(value) OVER (PARTITION BY volume) * 32)) AS bin, value, max(value) OVER (PARTITION BY volume) AS m FROM s), n AS (SELECT volume, bin, count(*) AS n FROM b WHERE value >= 0 AND m > 0 GROUP BY ALL), p AS (SELECT volume, n / sum(n) OVER (PARTITION BY volume) AS p FROM n) SELECT volume, round(-sum(p * log2(p)) / 5, 6) AS entropy FROM p GROUP BY volume",
    "masked_fraction": f"WITH {_S} SELECT volume, slice, round(CASE WHEN count(*) FILTER (value >= 50) > 0 THEN count(*) FILTER (value BETWEEN 60 AND 90) / count(*) FILTER (value >= 50) ELSE 0 END, 6) AS fraction FROM s GROUP BY ALL",
    "projection_policies": f"WITH {_S}, m AS (SELECT volume, event_id % 16 AS cell, round(max(value), 6) AS brightest FROM s GROUP BY ALL), n AS (SELECT volume, slice, count(*) FILTER (value > 50) AS n FROM s GROUP BY ALL), f AS (SELECT volume, slice AS fullest FROM n QUALIFY row_number() OVER (PARTITION BY volume ORDER BY n DESC, slice) = 1), d AS (SELECT volume, ((max(slice) + 1) // 2)::INT AS middle FROM s GROUP BY 1) SELECT * FROM m JOIN f USING (volume) JOIN d USING (volume)",
}
