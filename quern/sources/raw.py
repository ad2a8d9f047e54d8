"""Raw drops: CSV trees laid out as country_code=/dataset=/shop_id=, with provenance; database exports; ingests by checksum."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.relational import ContractError
from quern.sources import files

PATH = {"path_country_code": "country_code", "path_dataset": "dataset", "path_shop_id": "shop_id"}
#: The datasets of a drop.
DATASETS = ("products", "shop_info", "category_list", "product_categories", "category_platform", "shop_stats")
#: Most headers that differ in one dataset; more is a drop of something else.
MOST_HEADERS = 100
CSV = {"header": True, "recursiveFileLookup": True, "pathGlobFilter": "*.csv", "multiLine": True, "escape": '"', "enforceSchema": False}


def headers(spark: SparkSession, root: str) -> DataFrame:
    """(source_file, dataset, columns) of every CSV file below root, from its first line."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(root)
    lines = lines.select("value", F.col("_metadata.file_path").alias("source_file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    first = lines.groupBy("source_file").agg(F.min_by("value", "at").alias("line"))
    # A mark of byte order may stand before the first name.
    names = F.transform(F.split(F.regexp_replace("line", "^\\x{FEFF}", ""), ","), lambda c: F.trim(F.translate(c, '"\r', "")))
    return first.select("source_file", F.nullif(F.regexp_extract("source_file", "dataset=([^/]+)/", 1), F.lit("")).alias("dataset"), names.alias("columns"))


def read_raw(spark: SparkSession, root: str, columns: list[str]) -> DataFrame:
    """All CSV files below root as strings, with source_file, source_row and what their path says.

    Columns go by the name in each file's header, in whatever order; one that a file lacks is null there.
    Files with one header are read together. A file is read by one task, as lines may break inside quotes, so
    the number of a row is the distance to its file's first row.
    """
    found = headers(spark, root).groupBy("columns").agg(F.collect_list("source_file").alias("files")).limit(MOST_HEADERS + 1).collect()
    if len(found) > MOST_HEADERS:
        raise ContractError("HEADER_DRIFT", f"more than {MOST_HEADERS} headers")
    parts = []
    for row in found:
        schema = ", ".join(f"`{c}` string" for c in row["columns"])
        df = spark.read.options(**CSV).schema(schema).csv(list(row["files"]))
        picked = [F.col(f"`{c}`") if c in row["columns"] else F.lit(None).cast("string").alias(c) for c in columns]
        parts.append(df.select(*picked, F.col("_metadata.file_path").alias("source_file"), F.monotonically_increasing_id().alias("__at")))
    if not parts:
        return spark.createDataFrame([], ", ".join([*(f"`{c}` string" for c in columns), "source_file string", "source_row long", *(f"{n} string" for n in PATH)]))
    df = reduce(DataFrame.union, parts)
    first = df.groupBy("source_file").agg(F.min("__at").alias("__first"))
    df = df.join(first, "source_file").withColumn("source_row", F.col("__at") - F.col("__first") + 1)
    return df.select(*columns, "source_file", "source_row", *(F.nullif(F.regexp_extract("source_file", f"{part}=([^/]+)/", 1), F.lit("")).alias(n) for n, part in PATH.items()))


def unknown_datasets(spark: SparkSession, root: str, known: tuple[str, ...] = DATASETS) -> DataFrame:
    """(severity, code, dataset, source_file) of the files that belong to no known dataset; they are read by nothing."""
    found = headers(spark, root).where(~F.coalesce(F.col("dataset").isin(*known), F.lit(False)))
    return found.select(F.lit("warning").alias("severity"), F.lit("UNSUPPORTED_DATASET").alias("code"), "dataset", "source_file")


def read_export(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A database export: the one file of the folder that is table's, with a time stamp; none or several are refused."""
    found = [n for n in files.names(spark, folder) if re.fullmatch(rf"{re.escape(table)}_\d+\.csv", n)]
    if len(found) != 1:
        raise ContractError("EXPORT_FILES", f"{len(found)} files for {table}")
    return spark.read.options(header=True, multiLine=True, escape='"').csv(f"{folder}/{found[0]}")


def read_promotions(spark: SparkSession, pattern: str) -> DataFrame:
    """All files of a pattern as one table, by the names in their headers, with source_file."""
    return spark.read.options(header=True, enforceSchema=False).csv(pattern).withColumn("source_file", F.input_file_name())


def header_drift(found: list[str], declared: list[str]) -> dict[str, list[str]]:
    return {"missing": sorted(set(declared) - set(found)), "unknown": sorted(set(found) - set(declared))}


def drift(spark: SparkSession, root: str, declared: dict[str, list[str]]) -> DataFrame:
    """(dataset, column, kind) of the columns that a dataset's files lack (missing), have besides (unknown) or have in another dataset (moved)."""
    rows = [(d, c) for d, columns in declared.items() for c in columns]
    want = spark.createDataFrame(rows, "dataset string, column string")
    have = headers(spark, root).select("dataset", F.explode("columns").alias("column")).distinct()
    missing = want.join(have, ["dataset", "column"], "left_anti")
    elsewhere = have.select("column", F.lit(True).alias("moved")).distinct()
    missing = missing.join(elsewhere, "column", "left").select("dataset", "column", F.when(F.col("moved"), "moved").otherwise("missing").alias("kind"))
    unknown = have.where(F.col("dataset").isin(*declared)).join(want, ["dataset", "column"], "left_anti").select("dataset", "column", F.lit("unknown").alias("kind"))
    return missing.union(unknown)


def checksums(spark: SparkSession, root: str) -> DataFrame:
    """(name, length, sha256) of every file below root; name is the path from there."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").partition("://")[2] or root.rstrip("/")
    return found.select(F.substring_index("path", base + "/", -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def ingest(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Copy a drop as it is to a folder that must be free, with an inventory of checksums; the inventory.

    The copy becomes visible by one rename, after every file was read back and found equal.
    """
    staged = f"{target.rstrip('/')}-staging"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = (jvm.org.apache.hadoop.fs.Path(p) for p in (source, f"{staged}/files"))
    if files.exists(spark, target):
        raise ContractError("INGEST_EXISTS", target)
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)
    changed = checksums(spark, source).exceptAll(checksums(spark, f"{staged}/files"))
    if not changed.isEmpty():
        raise ContractError("INGEST_DAMAGED", source)
    checksums(spark, f"{staged}/files").coalesce(1).write.json(f"{staged}/inventory")
    if not files.moved(spark, staged, target):
        raise ContractError("INGEST_EXISTS", target)
    return spark.read.schema("name string, length long, sha256 string").json(f"{target}/inventory")


def drifted(spark: SparkSession, target: str) -> DataFrame:
    """(name, kind) of the files of an ingest that were changed, added or removed since."""
    was = spark.read.schema("name string, length long, sha256 string").json(f"{target}/inventory").select("name", F.col("sha256").alias("was"))
    both = was.join(checksums(spark, f"{target}/files").select("name", F.col("sha256").alias("now")), "name", "full")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return both.select("name", kind.alias("kind")).where("kind is not null")
