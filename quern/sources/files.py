"""Small files and folders through Hadoop's file systems, so that any path that Spark reads can be used."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _open(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, sorted; none where there is no folder."""
    fs, p = _open(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _open(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_json(spark: SparkSession, path: str, value: object) -> None:
    write_text(spark, path, json.dumps(value, ensure_ascii=False, sort_keys=True, default=str) + "\n")


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _open(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def moved(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder to a name that must be free; False, and the folder is gone, where it was not."""
    fs, a = _open(spark, source)
    _, b = _open(spark, target)
    if not fs.exists(b):
        fs.mkdirs(b.getParent())
        if fs.rename(a, b):
            return True
    fs.delete(a, True)
    return False
