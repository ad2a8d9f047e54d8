"""Named artifacts of a dataset: a closed registry, views, sinks in CSV, Parquet and JSON lines, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.relational import ContractError
from quern.sources import files

#: The artifacts that a dataset may have.
ARTIFACTS = ("products_clean", "shop_info_clean", "category_list_clean", "product_categories_clean", "category_platform_clean", "shop_stats_clean", "product_snapshot_metrics", "product_transition_metrics", "data_quality_issues")


def collected(spark: SparkSession, folder: str) -> list[str]:
    """The artifacts that a dataset has; other files are no artifacts."""
    found = {n.split(".")[0] for n in files.names(spark, folder)}
    return [a for a in ARTIFACTS if a in found]


def read_artifact(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """An artifact as Parquet or, with its schema, as CSV; one that is not registered or was not collected is refused."""
    if name not in ARTIFACTS:
        raise ContractError("UNKNOWN_DATASET", name)
    found = files.names(spark, folder)
    if f"{name}.parquet" in found:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    if f"{name}.csv" not in found:
        raise ContractError("DATASET_NOT_AVAILABLE", name)
    reader = spark.read.options(header=True, multiLine=True, escape='"', enforceSchema=False)
    return (reader.schema(schema) if schema else reader).csv(f"{folder}/{name}.csv")


def register_views(spark: SparkSession, folder: str, schemas: dict[str, str] | None = None) -> list[str]:
    """A temporary view for each artifact that the dataset has, and only for these; their names."""
    made = collected(spark, folder)
    for name in made:
        read_artifact(spark, folder, name, (schemas or {}).get(name)).createOrReplaceTempView(name)
    return made


def write_csv(df: DataFrame, path: str) -> None:
    """df as CSV files with headers in a folder that must be free."""
    df.write.mode("error").options(header=True, escape='"', emptyValue="", timestampFormat="yyyy-MM-dd'T'HH:mm:ss").csv(path)


def write_partitioned(df: DataFrame, path: str, by: tuple[str, ...] = ("country_code", "shop_id"), kind: str = "csv") -> None:
    """df in a folder per value of the columns; each value's rows meet in few tasks, so that there are few files."""
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(8))  # a large shop's rows go to several files
    writer = df.repartition(*by, spread).write.mode("error").partitionBy(*by)
    (writer.options(header=True, escape='"').csv if kind == "csv" else writer.parquet)(path)


def read_partitioned(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(header=True, multiLine=True, escape='"').csv(path)


def write_jsonl(df: DataFrame, path: str, order: list[str]) -> None:
    """A small table as one file of JSON lines in a stated order."""
    df.orderBy(*order).coalesce(1).write.mode("error").option("ignoreNullFields", False).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines; a line that was cut off is left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def report(tables: dict[str, DataFrame], keys: dict[str, list[str]], issues: DataFrame, status: DataFrame) -> DataFrame:
    """One row of JSON: rows, missing keys and repeated keys of each table, issues by code, and the status."""
    counted = None
    for name, df in tables.items():
        missing = F.lit(False)
        for k in keys[name]:
            missing = missing | F.col(k).isNull()
        groups = df.groupBy(*keys[name]).agg(F.count(F.lit(1)).alias("n"), F.max(missing.cast("int")).alias("missing"))
        one = groups.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("missing") == 1, F.col("n"))), F.lit(0)).alias("missing_key_rows"),
            F.coalesce(F.sum(F.when((F.col("n") > 1) & (F.col("missing") == 0), F.col("n"))), F.lit(0)).alias("duplicate_key_rows"),
        ).select(F.lit(name).alias("table"), F.struct("rows", "missing_key_rows", "duplicate_key_rows").alias("counts"))
        counted = one if counted is None else counted.union(one)
    by_code = issues.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))

    def mapped(df: DataFrame, key, value, name: str) -> DataFrame:
        return df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias(name)).withColumn("one", F.lit(1))

    parts = mapped(counted, F.col("table"), F.col("counts"), "tables").join(mapped(by_code, F.concat_ws(":", "severity", "code"), F.col("n"), "issues"), "one")
    return parts.join(status.select(F.lit(1).alias("one"), "status"), "one").select(F.to_json(F.struct("tables", "issues", "status")).alias("report"))
