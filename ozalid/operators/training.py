"""Training examples: token ids and labels in which the prompt doesn't count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IGNORED = -100


def masked_labels(ids: Column, prompt_len: Column) -> Column:
    """ids with the first prompt_len replaced by IGNORED."""
    return F.transform(ids, lambda x, i: F.when(i < prompt_len, F.lit(IGNORED)).otherwise(x))


def training_examples(df: DataFrame, encode, key: str, prompt: str, answer: str) -> DataFrame:
    """(key, input_ids, labels) of rows with a prompt and an answer.

    encode: DataFrame, text column, kept columns -> kept columns and ids. A narrow step but for what encode does; write
    the result once and read it each epoch.
    """
    usable = df.filter(F.col(prompt).isNotNull() & F.col(answer).isNotNull())
    both = usable.select(key, answer, F.col(prompt).alias("_p"))
    with_prompt = encode(both, "_p", [key, answer]).withColumnRenamed("ids", "_pi")
    with_answer = encode(with_prompt, answer, [key, "_pi"]).withColumnRenamed("ids", "_ai")
    ids = F.concat("_pi", "_ai")
    return with_answer.select(key, ids.alias("input_ids"), masked_labels(ids, F.size("_pi")).alias("labels"))


def write_examples(df: DataFrame, encode, key: str, prompt: str, answer: str, image: str, path: str) -> tuple[DataFrame, int]:
    """(the examples read back from path, number of rows skipped): built once as Parquet and read each epoch.

    Rows without a resolved image, a prompt or an answer are skipped; it is an error if none is left.
    """
    spark: SparkSession = df.sparkSession
    training_examples(df.filter(F.col(image).isNotNull()), encode, key, prompt, answer).write.mode("overwrite").parquet(path)
    built = spark.read.parquet(path)
    n = built.count()
    if n == 0:
        raise ValueError("no example could be built: every row lacks an image, a prompt or an answer")
    return built, df.count() - n
