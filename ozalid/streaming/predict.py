"""The row-wise plan over a stream of metadata files: an extension, the batch plan has no stream.

Queries are deduplicated within a watermark, so that each gives one output row, and each micro-batch is written by
foreachBatch to a folder of its own number, so that a batch that runs again replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ozalid.functions.scalars import LETTERS
from ozalid.operators.choices import choices_of
from ozalid.sources.tables import submission

SCHEMA = "query_id string, image string, question string, " + ", ".join(f"choice_{k} string" for k in LETTERS) + ", loaded_at timestamp"


def queries_stream(spark: SparkSession, folder: str, late: str = "7 days", files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of metadata as they arrive; a query_id that comes again within `late` is dropped."""
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    once = raw.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["query_id"])
    return once.withColumn("choices", choices_of([F.col(f"choice_{k}") for k in LETTERS]))


def run(stream: DataFrame, predict: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts predict on each micro-batch of stream and writes its submission rows below out/batch=<number>."""

    def write(batch: DataFrame, number: int) -> None:
        submission(predict(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latency_windows(stream: DataFrame, late: str = "1 hour", size: str = "10 minutes") -> DataFrame:
    """Rows, fallbacks and mean time of a stream of diagnostics per window and modality."""
    w = F.window("logged_at", size)
    return stream.withWatermark("logged_at", late).groupBy(w, "modality").agg(F.count("*").alias("row_count"), F.count_if(F.col("fallback_triggered")).alias("fallbacks"), F.avg("inference_time").alias("mean_time")).select("window.start", "window.end", "modality", "row_count", "fallbacks", "mean_time")
