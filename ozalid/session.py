"""Session building and the few things that depend on where the session runs."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "ozalid", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and the bench. On a cluster the submitter's session is used instead."""
    cpus = cpus or os.cpu_count() or 4
    base = {
        "spark.master": f"local[{cpus}]",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.legacy.javaCharsets": "true",  # windows-1252 in the CSV reader
    }
    spark = SparkSession.builder.appName(app).config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. A session on one machine that names none gets a
    temporary folder; on a cluster, where others couldn't read that, it is an error."""
    there = spark.sparkContext.getCheckpointDir()
    if there:
        return there
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="ozalid-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there; survives the loss of any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the workers, once per application, so that they can import it wherever the driver found it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="ozalid-package-")
    path = os.path.join(folder, "ozalid_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(home):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.join("ozalid", os.path.relpath(full, home)))
    context.addPyFile(path)  # the driver serves the file; executors fetch it
    _SHIPPED.add(context.applicationId)
