"""Listing, testing and renaming on whatever file system a path names: local, HDFS or an object store."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

from ozalid.session import checkpoint_dir


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def names(spark: SparkSession, path: str) -> list[str]:
    """Sorted names of what lies in a folder; none where there is no such folder."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if is_folder(spark, path) else []


def rename(spark: SparkSession, source: str, target: str) -> None:
    """source as target, which is replaced."""
    fs, p = _at(spark, source)
    _, t = _at(spark, target)
    fs.mkdirs(t.getParent())
    if fs.exists(t):
        fs.delete(t, True)
    if not fs.rename(p, t):
        raise OSError(f"{source} can't be renamed to {target}")


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def unescaped(value: str) -> str:
    """The value that a partition's folder stands for."""
    return unquote(value)


def scratch(spark: SparkSession) -> str:
    """A new folder's path below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def single_files(spark: SparkSession, df: DataFrame, folder: str, by: str, suffix: str, write) -> None:
    """One file <value of by><suffix> in folder for each value of df[by]; write(writer, path) starts a partitioned write.

    For formats that want one file: each is written by one task and renamed. Values are few.
    """
    part = f"{folder}/_parts-{uuid.uuid4().hex}"
    write(df.repartition(by).write.partitionBy(by), part)
    for sub in names(spark, part):
        if not sub.startswith(f"{by}="):
            continue
        value = unescaped(sub[len(by) + 1 :])
        files = [n for n in names(spark, f"{part}/{sub}") if n.startswith("part-")]
        if len(files) != 1:
            raise OSError(f"{len(files)} files for {value}")
        rename(spark, f"{part}/{sub}/{files[0]}", f"{folder}/{value}{suffix}")
    remove(spark, part)
