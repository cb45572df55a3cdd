"""Queries: samples, splits, paths, ids, unions, training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ozalid.functions.scalars import file_name, file_stem, file_suffix
from ozalid.operators.resolve import resolve_dataset_images, resolve_images
from ozalid.operators.sampling import case_split, first_per_group, numbered_ids, overlap_by_hash, seeded_sample, shuffled_choices
from ozalid.operators.training import masked_labels
from ozalid.plans.q_questions import items, metadata, table


def seeded_sample_items(spark, sf_dir):
    """Fifty items in a seeded order (the limit is the operator)."""
    ids = table(spark, sf_dir, "qa_items").select("question_id").filter("question_id IS NOT NULL").distinct()
    return seeded_sample(ids, "question_id", 50, 7)


def case_split_customers(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("case_id", F.concat_ws("-", "c_nationkey", "c_mktsegment"))
    return case_split(c, "case_id", 0.2, 42).groupBy("split").agg(F.count("*").alias("row_count"), F.count_distinct("case_id").alias("cases"))


def case_split_by_segment(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return case_split(c, "c_nationkey", 0.5, 1, by="c_mktsegment").select("c_custkey", "split")


def split_disjoint(spark, sf_dir):
    """Customers and nations of each half of a split, and the nations that are in both: none."""
    s = case_split(table(spark, sf_dir, "customer"), "c_nationkey", 0.2, 42)
    halves = s.groupBy("c_nationkey").agg(F.count_distinct("split").alias("halves"), F.min("split").alias("split"), F.count("*").alias("rows"))
    return halves.groupBy("split").agg(F.count("*").alias("nations"), F.sum("rows").alias("customers"), F.count_if(F.col("halves") > 1).alias("in_both"))


ROOT = "/data"


def _listing(df):
    """Files that exist: three of four cells, some under Images, some with a download number."""
    n = F.substring("query_id", 3, 8).cast("long")
    cells = df.filter("image IS NOT NULL AND image <> ''").select(n.alias("n"), F.trim("image").alias("c"))
    base, suffix = file_stem(F.col("c")), F.regexp_extract("c", r"(?i)(\.nii\.gz|\.[^.]+)$", 1)
    path = (
        F.when(F.col("n") % 4 == 1, F.concat(F.lit(f"{ROOT}/"), F.col("c"))).when(F.col("n") % 4 == 2, F.concat(F.lit(f"{ROOT}/Images/"), F.col("c")))
        .when(F.col("n") % 4 == 3, F.concat(F.lit(f"{ROOT}/Images/"), F.upper(base), F.lit(" ("), F.col("n") % 3 + 1, F.lit(")"), suffix))
    )
    return cells.select(path.alias("path")).filter("path IS NOT NULL").distinct()


def path_resolution(spark, sf_dir):
    d = table(spark, sf_dir, "dev_metadata")
    one = d.groupBy("query_id").agg(F.max("image").alias("image"))
    return resolve_images(one, "query_id", "image", _listing(d), ROOT).select("query_id", "resolved_path")


def dataset_path_resolution(spark, sf_dir):
    q = table(spark, sf_dir, "qa_items").groupBy("question_id").agg(F.max("image_path").alias("image_path"), F.max("dataset").alias("dataset"))
    seen = q.filter(F.col("image_path").startswith("Images/"))
    listing = seen.select(F.concat(F.lit(f"{ROOT}/"), F.col("image_path")).alias("path")).distinct()
    return resolve_dataset_images(q, "question_id", "image_path", "dataset", listing, ROOT).select("question_id", "resolved_path")


def path_parts(spark, sf_dir):
    q = table(spark, sf_dir, "qa_items").filter("image_path IS NOT NULL").select("image_path").distinct()
    return q.select("image_path", file_name(F.col("image_path")).alias("name"), file_stem(F.col("image_path")).alias("stem"), file_suffix(F.col("image_path")).alias("suffix"))


def question_ids(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_name")
    return numbered_ids(c, "case", "c_name")


def first_document_per_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("source", "doc_id", "n_chars")
    return first_per_group(d, ["source"], [-F.col("n_chars"), F.col("doc_id")])


def qa_union(spark, sf_dir):
    """Both question tables in one shape."""
    a = items(spark, sf_dir).select(F.lit("items").alias("origin"), F.col("question_id").alias("id"), "question", F.size("choices").alias("n_choices"))
    b = metadata(spark, sf_dir).select(F.lit("metadata").alias("origin"), F.col("query_id").alias("id"), "question", F.size("choices").alias("n_choices"))
    return a.unionByName(b).groupBy("origin", "n_choices").agg(F.count("*").alias("row_count"), F.count("question").alias("questions"))


def qa_item_projection(spark, sf_dir):
    """Prepared items: the gold text of a labelled file among fixed options."""
    p = table(spark, sf_dir, "part")
    names = ("BRASS", "COPPER", "NICKEL", "STEEL", "TIN")
    label = F.element_at(F.split("p_type", " "), -1)
    return p.select(F.format_string("part_%05d", F.col("p_partkey")).alias("question_id"), F.lit("External-Prepared").alias("question_type"), label.alias("gt_answer"), F.lower(label).isin(*map(str.lower, names)).alias("known"), F.array_position(F.array(*map(F.lit, names)), label).cast("int").alias("option"))


def split_leak_check(spark, sf_dir):
    """Texts of the train split that stand in an evaluation split as well, by hash of the exact question and answer."""
    q = table(spark, sf_dir, "qa_items").filter("question IS NOT NULL AND image_path IS NOT NULL").withColumn("content", F.concat_ws("|", "image_path", "question"))
    leaked = overlap_by_hash(q.filter("split <> 'train'"), q.filter("split = 'train'"), "content")
    return leaked.groupBy("split").agg(F.count_distinct("question_id").alias("items"))


def label_mask(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    ids = F.transform("embedding", lambda x: F.floor(x * 1000).cast("int"))
    return e.select("vec_id", masked_labels(ids, F.col("label") * 3).alias("labels"))


def option_shuffle(spark, sf_dir):
    """Choices in the order of epoch 3, with where the first one went."""
    q = items(spark, sf_dir).filter("question_id IS NOT NULL")
    s = q.withColumn("s", shuffled_choices(F.col("choices"), 5, 3, F.col("question_id")))
    return s.select("question_id", "loaded_at", F.array_join(F.transform("s", lambda c: c["was"]), "").alias("order"))


QUERIES = {f.__name__: f for f in (seeded_sample_items, case_split_customers, case_split_by_segment, split_disjoint, path_resolution, dataset_path_resolution, path_parts, question_ids, first_document_per_source, qa_union, qa_item_projection, split_leak_check, label_mask, option_shuffle)}

from ozalid.plans.q_questions import _ITEMS, _META  # noqa: E402

_SUF = r"(?i)(\.nii\.gz|\.[^.]+)$"
ORACLE = {
    "seeded_sample_items": "SELECT question_id FROM (SELECT DISTINCT question_id FROM qa_items WHERE question_id IS NOT NULL) ORDER BY md5('7|' || question_id), question_id LIMIT 50",
    "case_split_customers": """WITH c AS (SELECT *, c_nationkey || '-' || c_mktsegment AS case_id FROM customer), k AS (SELECT case_id, row_number() OVER (ORDER BY md5('42|' || case_id), case_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT case_id FROM c))
SELECT CASE WHEN r <= greatest(1, round_even(n * 0.2, 0)) THEN 'eval' ELSE 'train' END AS split, count(*) AS row_count, count(DISTINCT case_id) AS cases FROM c JOIN k USING (case_id) GROUP BY 1""",
    "case_split_by_segment": """WITH k AS (SELECT c_mktsegment, c_nationkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('1|' || c_nationkey), c_nationkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer))
SELECT c_custkey, CASE WHEN r <= greatest(1, round_even(n * 0.5, 0)) THEN 'eval' ELSE 'train' END AS split FROM customer JOIN k USING (c_mktsegment, c_nationkey)""",
    "split_disjoint": """WITH k AS (SELECT c_nationkey, row_number() OVER (ORDER BY md5('42|' || c_nationkey), c_nationkey) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT c_nationkey FROM customer))
SELECT CASE WHEN r <= greatest(1, round_even(n * 0.2, 0)) THEN 'eval' ELSE 'train' END AS split, count(DISTINCT c_nationkey) AS nations, count(*) AS customers, 0 AS in_both FROM customer JOIN k USING (c_nationkey) GROUP BY 1""",
    "path_resolution": f"""WITH l AS (SELECT DISTINCT CASE n % 4 WHEN 1 THEN '{ROOT}/' || c WHEN 2 THEN '{ROOT}/Images/' || c WHEN 3 THEN '{ROOT}/Images/' || upper(regexp_replace(c, '{_SUF}', '')) || ' (' || (n % 3 + 1) || ')' || regexp_extract(c, '{_SUF}', 1) END AS path FROM (SELECT substr(query_id, 3, 8)::BIGINT AS n, trim(image) AS c FROM dev_metadata WHERE image <> '') WHERE n % 4 <> 0),
q AS (SELECT query_id, max(image) AS image FROM dev_metadata GROUP BY 1), c AS (SELECT query_id, trim(image) AS c FROM q WHERE trim(image) <> ''),
x AS (SELECT query_id, 0 AS i, c AS path FROM c WHERE c LIKE '/%' UNION ALL SELECT query_id, 1, '{ROOT}/' || c FROM c UNION ALL SELECT query_id, 2, '{ROOT}/Images/' || c FROM c UNION ALL SELECT query_id, 3, '{ROOT}/Images/' || split_part(c, '/', -1) FROM c),
e AS (SELECT query_id, min({{'i': i, 'p': path}}).p AS path FROM x JOIN l USING (path) GROUP BY 1),
m AS (SELECT c.query_id, min(l.path) AS path FROM c JOIN l ON lower(regexp_replace(l.path, ' \\([0-9]+\\)(\\.[^.]+)$', '\\1')) = lower('{ROOT}/Images/' || split_part(c.c, '/', -1)) WHERE c.query_id NOT IN (SELECT query_id FROM e) AND regexp_matches(c.c, '{_SUF}') GROUP BY 1)
SELECT q.query_id, coalesce(e.path, m.path) AS resolved_path FROM q LEFT JOIN e USING (query_id) LEFT JOIN m USING (query_id)""",
    "dataset_path_resolution": f"""WITH q AS (SELECT question_id, max(image_path) AS c, max(dataset) AS d FROM qa_items GROUP BY 1), l AS (SELECT DISTINCT '{ROOT}/' || c AS path FROM q WHERE c LIKE 'Images/%'),
x AS (SELECT question_id, 0 AS i, '{ROOT}/Images/' || d || '/' || split_part(replace(c, chr(92), '/'), '/', -1) AS path FROM q UNION ALL SELECT question_id, 1, '{ROOT}/' || c FROM q UNION ALL SELECT question_id, 2, '{ROOT}/Images/' || c FROM q),
e AS (SELECT question_id, min({{'i': i, 'p': path}}).p AS path FROM x JOIN l USING (path) GROUP BY 1)
SELECT question_id, path AS resolved_path FROM q LEFT JOIN e USING (question_id)""",
    "path_parts": f"""WITH n AS (SELECT DISTINCT image_path, split_part(replace(image_path, chr(92), '/'), '/', -1) AS name FROM qa_items WHERE image_path IS NOT NULL)
SELECT image_path, name, regexp_replace(name, '{_SUF}', '') AS stem, lower(regexp_extract(name, '{_SUF}', 1)) AS suffix FROM n""",
    "question_ids": "SELECT c_name, printf('case_%05d', row_number() OVER (ORDER BY c_name) - 1) AS question_id FROM customer",
    "first_document_per_source": "SELECT source, doc_id, n_chars FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1",
    "qa_union": _ITEMS.replace("WITH d AS", "WITH a AS") + ", " + _META[5:] + "SELECT origin, n_choices, count(*) AS row_count, count(question) AS questions FROM (SELECT 'items' AS origin, len(choices) AS n_choices, question FROM a UNION ALL SELECT 'metadata', len(choices), question FROM d) GROUP BY ALL",
    "qa_item_projection": "SELECT printf('part_%05d', p_partkey) AS question_id, 'External-Prepared' AS question_type, split_part(p_type, ' ', -1) AS gt_answer, lower(split_part(p_type, ' ', -1)) IN ('brass', 'copper', 'nickel', 'steel', 'tin') AS known, coalesce(list_position(['BRASS', 'COPPER', 'NICKEL', 'STEEL', 'TIN'], split_part(p_type, ' ', -1)), 0) AS option FROM part",
    "split_leak_check": "WITH q AS (SELECT *, image_path || '|' || question AS content FROM qa_items WHERE question IS NOT NULL AND image_path IS NOT NULL) SELECT split, count(DISTINCT question_id) AS items FROM q WHERE split <> 'train' AND content IN (SELECT content FROM q WHERE split = 'train') GROUP BY split",
    "label_mask": "SELECT vec_id, list_transform(embedding, lambda x, i: CASE WHEN i - 1 < label * 3 THEN -100 ELSE floor(x::DOUBLE * 1000)::INT END) AS labels FROM embeddings",
    "option_shuffle": _ITEMS + """SELECT question_id, loaded_at, coalesce(list_aggregate(list_transform(list_sort(list_transform(choices, lambda c: {'h': md5('5|3|' || question_id || '|' || c.letter), 'w': c.letter})), lambda c: c.w), 'string_agg', ''), '') AS "order" FROM d WHERE question_id IS NOT NULL""",
}
