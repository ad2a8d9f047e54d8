"""Versions of a dataset named by their content: publish, list, switch, verify; and the gate before them."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.quality import publish_issues
from quern.operators.relational import ContractError
from quern.sources import files, raw

MANIFEST, POINTER = "_manifest.json", "_current.json"


def content_digest(df: DataFrame) -> str:
    """A digest of columns, types and rows that does not depend on the order of rows or on how they are split.

    Each row is hashed as JSON with its names and nulls; the sums of two parts of the hashes tell tables
    apart, and equal rows add up rather than cancel.
    """
    names = sorted(df.columns)
    h = F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)
    parts = df.select(*(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)").alias(f"p{at}") for at in (1, 16, 31)))
    row = parts.agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in parts.columns)).first()
    text = json.dumps([[f.name, f.dataType.simpleString()] for f in sorted(df.schema, key=lambda f: f.name)]) + "|" + "|".join(str(x or 0) for x in row)
    return df.sparkSession.range(1).select(F.sha2(F.lit(text), 256)).first()[0][:32]


def publish(df: DataFrame, root: str, name: str) -> tuple[str, bool]:
    """Write df as a version named by its content; (path, whether it is new). A version is never overwritten.

    Rows and manifest go to a folder of their own, which one rename makes the version; so of two writers of
    one content one succeeds and the other finds it there, and a job that is lost leaves nothing in sight.
    """
    spark = df.sparkSession
    digest = content_digest(df)
    path = f"{root}/{name}/version={digest}"
    if files.exists(spark, f"{path}/{MANIFEST}"):
        return path, False
    staged = f"{root}/{name}/_staging-{uuid.uuid4().hex}"
    df.write.parquet(f"{staged}/rows")
    wrote = content_digest(spark.read.schema(df.schema).parquet(f"{staged}/rows"))
    if wrote != digest:
        raise ContractError("CONTENT_CHANGED", "the rows written are not the rows digested")
    files.write_json(spark, f"{staged}/{MANIFEST}", {"name": name, "digest": digest, "columns": df.columns})
    return path, files.moved(spark, staged, path)


def versions(spark: SparkSession, root: str, name: str) -> list[str]:
    """The digests of the versions that are there."""
    found = [n.removeprefix("version=") for n in files.names(spark, f"{root}/{name}") if n.startswith("version=")]
    return [v for v in found if files.exists(spark, f"{root}/{name}/version={v}/{MANIFEST}")]


def switch(spark: SparkSession, root: str, name: str, version: str) -> None:
    """Make a version that is there, and is what its name says, the current one."""
    verify(spark, root, name, version)
    files.write_json(spark, f"{root}/{name}/{POINTER}", {"version": version})


def current(spark: SparkSession, root: str, name: str) -> str | None:
    path = f"{root}/{name}/{POINTER}"
    return json.loads(files.read_text(spark, path))["version"] if files.exists(spark, path) else None


def verify(spark: SparkSession, root: str, name: str, version: str) -> DataFrame:
    """A version's rows, if they still are what its name says."""
    if version not in versions(spark, root, name):
        raise ContractError("UNKNOWN_VERSION", version)
    df = spark.read.parquet(f"{root}/{name}/version={version}/rows")
    if content_digest(df) != version:
        raise ContractError("VERSION_CHANGED", f"{name} {version} was changed after it was published")
    return df


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The rows of the current version."""
    version = current(spark, root, name)
    if version is None:
        raise ContractError("NO_CURRENT_VERSION", name)
    return verify(spark, root, name, version)


def publish_bundle(spark: SparkSession, parts: dict[str, tuple[DataFrame, list[str]]], target: str) -> bool:
    """Small tables (with their order) as files of JSON lines in one folder, staged and renamed; whether it is new.

    A bundle that is there stays: the same content is a success, another is refused.
    """
    digests = {n: content_digest(df) for n, (df, _) in parts.items()}
    if files.exists(spark, f"{target}/{MANIFEST}"):
        if json.loads(files.read_text(spark, f"{target}/{MANIFEST}")) != digests:
            raise ContractError("IMMUTABLE_INSIGHT_COLLISION", target)
        return False
    staged = f"{target}-{uuid.uuid4().hex}"
    for name, (df, order) in parts.items():
        df.orderBy(*order).coalesce(1).write.option("ignoreNullFields", False).json(f"{staged}/{name}")
    files.write_json(spark, f"{staged}/{MANIFEST}", digests)
    return files.moved(spark, staged, target)


def gate(spark: SparkSession, folder: str, known: list[tuple[str, str]] = (), quarantine: str | None = None) -> tuple[str, list[tuple[str, str, str]]]:
    """The verdict on a drop of CSV files with a manifest.json, and its issues (code, table, detail).

    refused: the manifest is missing or not whole, or a file's checksum is not the one stated. quarantined: a
    row count is off, or a table breaks a quality rule that is not known to hold for it (known: table and
    column); the reasons are written to the quarantine folder. passed: it may become a version.
    """
    path = f"{folder}/manifest.json"
    if not files.exists(spark, path):
        return "refused", [("manifest_missing", "", path)]
    try:
        manifest = json.loads(files.read_text(spark, path))
        declared = manifest["files"]
        if not manifest.get("source") or not manifest.get("exported_at"):
            raise ValueError("source and exported_at are needed")
    except (ValueError, KeyError) as e:
        return "refused", [("manifest_invalid", "", str(e))]
    stated = spark.createDataFrame([(n, d.get("sha256")) for n, d in declared.items()], "name string, stated string")
    found = stated.join(raw.checksums(spark, folder), "name", "left")
    bad = found.where(F.col("sha256").isNull() | ~F.col("sha256").eqNullSafe(F.col("stated"))).orderBy("name").collect()
    if bad:
        return "refused", [("manifest_invalid" if r["sha256"] is None else "file_hash_mismatch", r["name"], "") for r in bad]
    issues: list[tuple[str, str, str]] = []
    for name, d in declared.items():
        table, df = name.removesuffix(".csv"), spark.read.options(header=True, multiLine=True, escape='"').csv(f"{folder}/{name}")
        if not df.columns:
            issues.append(("contract_violation", table, "the file is empty"))
            continue
        if d.get("rows") is not None and (n := df.count()) != int(d["rows"]):
            issues.append(("contract_violation", table, f"{n} rows, {d['rows']} stated"))
        issues += [(r["code"], table, r["column"] or "") for r in publish_issues(df, table).collect() if (table, r["column"]) not in set(known)]
    if issues and quarantine:
        files.write_json(spark, f"{quarantine}/QUARANTINE.json", {"source": folder, "issues": issues})
    return ("quarantined" if issues else "passed"), issues
