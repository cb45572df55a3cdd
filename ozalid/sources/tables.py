"""Question tables and dataset folders in, submission and diagnostic files out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ozalid.functions.scalars import LETTERS, python_bool, seconds_text, strip
from ozalid.operators.choices import choices_of
from ozalid.operators.sampling import case_split, numbered_ids
from ozalid.sources import folders

METADATA = ("query_id", "image", "question", *[f"choice_{k}" for k in LETTERS])
ITEM = T.StructType([T.StructField(c, T.StringType()) for c in ("dataset", "question_id", "question_type", "question", "gt_answer", "image_path", *[f"option_{k}" for k in LETTERS], "modality_type")])
DIAGNOSTIC = ("query_id", "answer", "gold", "correct", "inference_time", "predicted_modality", "predicted_intent", "n_choices", "fallback_triggered", "fallback_reason", "top1_logit", "top2_logit", "logit_margin")


def read_metadata(spark: SparkSession, folder: str, name: str = "dev_metadata.csv", encoding: str = "windows-1252") -> DataFrame:
    """The competition's CSV file (windows-1252, quoted line breaks): image stripped, question as it stands, choices as
    an array. Needs spark.sql.legacy.javaCharsets=true, which build_session sets; columns are found by the header,
    unknown ones are left out and absent ones NULL."""
    path = f"{folder}/{name}"
    if not folders.exists(spark, path):
        raise FileNotFoundError(path)
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).csv(path)
    raw = raw.select(*[(F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string")).alias(c) for c in METADATA])
    cell = strip(F.col("image"))
    return raw.select("query_id", F.when(cell != "", cell).alias("image"), "question", choices_of([F.col(f"choice_{k}") for k in LETTERS]).alias("choices"))


OPEN = "QA_information/Open-access"


def list_datasets(spark: SparkSession, root: str) -> list[str]:
    """Sorted names of the datasets below root/QA_information/Open-access."""
    require_root(spark, root)
    return [f[:-5] for f in folders.names(spark, f"{root}/{OPEN}") if f.endswith(".json")]


def require_root(spark: SparkSession, root: str) -> str:
    if not folders.is_folder(spark, root):
        raise FileNotFoundError(f"{root} is not a folder")
    return root


def read_items(spark: SparkSession, paths: list[str]) -> DataFrame:
    """QA items of JSON files that hold one array, indented or not, or JSON Lines: told apart by the first character.
    Absent keys are NULL, lines that aren't JSON are rows of NULLs; dataset is the file's name where an item has none.

    A JSON array can't be split, so a file is a task; large sets belong in many files or in JSON Lines.
    """
    path = F.col("_metadata.file_path")
    set_of_parts = F.regexp_extract(path, r"/([^/]+\.json)/[^/]+$", 1)  # a dataset may be a folder of part files
    name = F.when(set_of_parts != "", F.try_url_decode(F.replace(set_of_parts, F.lit("+"), F.lit("%2B")))).otherwise(F.col("_metadata.file_name"))
    return parse_items(spark.read.text(paths, wholetext=True).select(name.alias("file"), "value"))


def parse_items(text: DataFrame) -> DataFrame:
    """The items of whole files (file, value)."""
    value = F.regexp_replace("value", r"^[\s\x{FEFF}]+", "")
    array = F.from_json(value, T.ArrayType(ITEM))
    lines = F.transform(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, ITEM))
    each = text.select("file", F.explode(F.when(value.startswith("["), array).otherwise(lines)).alias("item"))
    name = F.regexp_replace("file", r"\.json$", "")
    return each.select(F.coalesce("item.dataset", name).alias("dataset"), *[f"item.{f.name}" for f in ITEM.fields if f.name != "dataset"])


def read_datasets(spark: SparkSession, root: str, names: list[str]) -> tuple[DataFrame, list[str]]:
    """(items of the named datasets, names without a file); an error only if none has one."""
    there = set(list_datasets(spark, root))
    missing = [n for n in names if n not in there]
    found = [n for n in names if n in there]
    if not found:
        raise FileNotFoundError(f"none of {names} below {root}")
    return read_items(spark, [f"{root}/{OPEN}/{n}.json" for n in found]), missing


# -- folders that carry labels ---------------------------------------------------------------------------------------


def _names(spark: SparkSession, raw: str) -> DataFrame:
    """(path, name, parent) of all files; contents aren't read."""
    return with_names(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(raw).select("path"))


def with_names(listed: DataFrame) -> DataFrame:
    """(path, name, parent) of paths."""
    part = F.split("path", "/")
    return listed.select("path", F.element_at(part, -1).alias("name"), F.element_at(part, -2).alias("parent")).filter(~F.col("name").startswith("._"))


# Folder names and the option letter of each, options, questions and modalities of the three layouts.
CT_GRADES = {"CT-0": "A", "CT-1": "B", "CT-2": "C", "CT-3": "D", "CT-4": "D"}
CT_OPTIONS = ("No significant involvement (normal lung)", "Mild involvement (ground-glass opacity, under 25% of lung parenchyma)", "Moderate involvement (ground-glass opacity, 25-50% of lung parenchyma)", "Severe involvement (opacity and consolidation, over 50% of lung parenchyma)")
CT_QUESTION = "What is the severity of lung involvement (ground-glass opacification/consolidation) shown in this chest CT scan?"
BRAIN_OPTIONS = ("Brain", "Chest/thorax", "Abdomen", "Pelvis")
BRAIN_QUESTION = "Which anatomical region is primarily depicted in this MRI scan?"
BREAST_CLASSES = {"benign": "A", "malignant": "B", "normal": "C"}
BREAST_OPTIONS = ("Benign lesion", "Malignant lesion", "Normal tissue, no lesion")
BREAST_QUESTION = "What does this breast ultrasound image most likely show?"


def _mapped(key, table: dict[str, str]):
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def graded_scans(names: DataFrame) -> DataFrame:
    """(path, letter) of NIfTI files whose folder names a grade, in any case, with - or _; others are skipped."""
    grade = F.upper(F.replace("parent", F.lit("_"), F.lit("-")))
    scans = names.filter(F.lower("name").rlike(r"\.nii(\.gz)?$"))
    return scans.select("path", _mapped(grade, CT_GRADES).alias("letter")).filter("letter IS NOT NULL")


def brain_scans(names: DataFrame) -> DataFrame:
    """(path, letter): files of imagesTr if there are any; else one NIfTI per case folder, FLAIR first, masks never."""
    names = names.filter(F.lower("name").rlike(r"\.nii(\.gz)?$"))
    train = names.filter(F.col("parent") == "imagesTr")
    if not train.isEmpty():
        return train.select("path", F.lit("A").alias("letter"))
    usable = names.filter(~F.lower("name").contains("seg"))
    first = F.min(F.struct((~F.lower("name").contains("flair")).alias("other"), "path")).alias("x")
    return usable.groupBy(F.regexp_replace("path", "/[^/]*$", "")).agg(first).select("x.path", F.lit("A").alias("letter"))


def class_folders(names: DataFrame) -> DataFrame:
    """(path, letter) of PNG files in folders named by class, in any case; masks are left out."""
    pngs = names.filter(F.lower("name").endswith(".png") & ~F.lower("name").contains("mask"))
    return pngs.select("path", _mapped(F.lower("parent"), BREAST_CLASSES).alias("letter")).filter("letter IS NOT NULL")


#: Layouts by dataset name: (what takes the cases from the names, question, options, modality). A new one is one more entry.
ADAPTERS = {
    "MosMedData": (graded_scans, CT_QUESTION, CT_OPTIONS, "CT(Computed Tomography)"),
    "BrainMRI": (brain_scans, BRAIN_QUESTION, BRAIN_OPTIONS, "MRI(Magnetic Resonance Imaging)"),
    "BUSI": (class_folders, BREAST_QUESTION, BREAST_OPTIONS, "US(Ultrasound)"),
}


def prepare_items(spark: SparkSession, name: str, raw: str, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """QA items with split (train, eval) of a labelled folder; gold is the option's text, ids follow the sorted paths."""
    cases = ADAPTERS[name][0](_names(spark, require_root(spark, raw)))
    if cases.isEmpty():
        raise FileNotFoundError(f"no {name} case below {raw}")
    return items_of_cases(cases, name, fraction, seed)


def items_of_cases(cases: DataFrame, name: str, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """The items of (path, letter) cases of a layout of ADAPTERS."""
    _, question, options, modality = ADAPTERS[name]
    split = case_split(numbered_ids(cases, name, "path"), "path", fraction, seed)
    texts = {k: options[i] if i < len(options) else None for i, k in enumerate(LETTERS)}
    columns = [F.lit(t).cast("string").alias(f"option_{k}") for k, t in texts.items()]
    gold = _mapped(F.col("letter"), {k: t for k, t in texts.items() if t})
    return split.select(F.lit(name).alias("dataset"), "question_id", F.lit("External-Prepared").alias("question_type"), F.lit(question).alias("question"), gold.alias("gt_answer"), F.col("path").alias("image_path"), *columns, F.lit(modality).alias("modality_type"), "split")


# -- sinks -----------------------------------------------------------------------------------------------------------


def submission(df: DataFrame) -> DataFrame:
    """(query_id, answer, inference_time as text), a row per row."""
    return df.select("query_id", F.coalesce("answer", F.lit("A")).alias("answer"), seconds_text(F.col("inference_time")).alias("inference_time"))


def diagnostic(df: DataFrame) -> DataFrame:
    """The 13 columns of the side file; booleans as Python writes them."""
    return df.select(*[python_bool(F.col(c)).alias(c) if c in ("correct", "fallback_triggered") else F.col(c) for c in DIAGNOSTIC])


def _csv(writer, path: str) -> None:
    writer.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("nullValue", "").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header and CRLF; NULL is empty. single: path is one file, for results that one task can hold."""
    if not single:
        _csv(df.write, path)
        return
    spark, part = df.sparkSession, f"{path}.parts"
    _csv(df.coalesce(1).write, part)
    (name,) = [n for n in folders.names(spark, part) if n.startswith("part-")]
    folders.rename(spark, f"{part}/{name}", path)
    folders.remove(spark, part)


def write_items(items: DataFrame, path: str) -> None:
    """JSON Lines below path/split=train and path/split=eval, which read_items reads: for sets of any size."""
    items.write.mode("overwrite").partitionBy("split").json(path)


def write_datasets(items: DataFrame, root: str) -> None:
    """Items as root/QA_information/Open-access/<dataset>.json, which read_datasets reads: each a folder of JSON Lines, so
    that no dataset is a single task's. dataset isn't NULL."""
    spark, part = items.sparkSession, f"{root}/_datasets"
    items.write.mode("overwrite").partitionBy("dataset").json(part)
    for sub in folders.names(spark, part):
        if sub.startswith("dataset="):
            folders.rename(spark, f"{part}/{sub}", f"{root}/{OPEN}/{folders.unescaped(sub[8:])}.json")
    folders.remove(spark, part)


def write_split_files(items: DataFrame, folder: str, name: str) -> None:
    """folder/{name}_train.json and {name}_eval.json, a file each, of JSON Lines that read_items reads."""
    named = items.withColumn("_file", F.concat(F.lit(f"{name}_"), "split")).drop("split")
    folders.single_files(items.sparkSession, named, folder, "_file", ".json", lambda writer, path: writer.option("ignoreNullFields", False).json(path))
