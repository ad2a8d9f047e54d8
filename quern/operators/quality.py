"""Quality of a raw drop: typed columns with issues, keys, orphans, duplicates, degenerate columns, a verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.numbers import to_flag, to_number
from quern.operators.relational import orphans

ISSUE = ["severity", "code", "dataset", "entity_key", "field", "raw_value"]


def issue(df: DataFrame, severity: str, code: str, dataset: str, key: Column, field: str | None = None, raw: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(dataset).alias("dataset"), key.cast("string").alias("entity_key"), F.lit(field).cast("string").alias("field"), (none if raw is None else raw).alias("raw_value"))


def typed(df: DataFrame, dataset: str, key: str, numbers: list[str] = (), flags: list[str] = (), arrays: list[str] = (), dates: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """df with <n>_num, <f>_bool, <a>_count and <d>_date columns, and an issue for each value that does not parse."""
    made = {f"{c}_num": to_number(F.col(c)) for c in numbers}
    made |= {f"{c}_bool": to_flag(F.col(c)) for c in flags}
    made |= {f"{c}_date": F.try_to_date(F.col(c), "yyyy-MM-dd") for c in dates}
    for c in arrays:
        made[f"{c}_count"] = F.json_array_length(c).cast("long")
    out = df.withColumns(made)
    kinds = [(c, f"{c}_num", "INVALID_NUMBER") for c in numbers] + [(c, f"{c}_bool", "INVALID_BOOLEAN") for c in flags] + [(c, f"{c}_count", "INVALID_JSON_ARRAY") for c in arrays] + [(c, f"{c}_date", "INVALID_DATE") for c in dates]
    checks = [F.when((F.trim(F.col(raw)) != "") & F.col(new).isNull(), F.struct(F.lit(code).alias("code"), F.lit(raw).alias("field"), F.col(raw).alias("raw_value"))) for raw, new, code in kinds]
    found = out.select(F.col(key).alias("k"), F.explode(F.array_compact(F.array(*checks))).alias("i"))
    issues = found.select(F.lit("warning").alias("severity"), "i.code", F.lit(dataset).alias("dataset"), F.col("k").cast("string").alias("entity_key"), "i.field", "i.raw_value")
    return out, issues


def without_repeats(df: DataFrame, columns: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """The first of each set of rows equal in columns, and the others."""
    numbered = df.withColumn("__n", F.row_number().over(Window.partitionBy(*columns).orderBy(order)))
    return numbered.where("__n = 1").drop("__n"), numbered.where("__n > 1").drop("__n")


def key_issues(df: DataFrame, dataset: str, keys: list[str]) -> DataFrame:
    """MISSING_KEY and DUPLICATE_KEY; the rows stay."""
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == "") for k in keys])
    key = F.concat_ws(":", *(F.col(k).cast("string") for k in keys))
    twice = df.where(~missing).groupBy(*keys).count().where("count > 1")
    return issue(df.where(missing), "error", "MISSING_KEY", dataset, key).union(issue(twice, "error", "DUPLICATE_KEY", dataset, key))


def orphan_issues(df: DataFrame, of: DataFrame, keys: list[str], code: str, dataset: str) -> DataFrame:
    lost = orphans(df.select(*keys).distinct(), of, keys)
    return issue(lost, "warning", code, dataset, F.concat_ws(":", *(F.col(k).cast("string") for k in keys)))


#: Child dataset, parent dataset, keys and code of each reference between the tables of a drop.
REFERENCES = [
    ("products", "shop_info", ["country_code", "shop_id"], "ORPHAN_PRODUCT_SHOP"),
    ("product_categories", "products", ["country_code", "shop_id", "item_id"], "ORPHAN_CATEGORY_MAPPING_PRODUCT"),
    ("product_categories", "category_list", ["country_code", "shop_id", "category_id"], "ORPHAN_CATEGORY_MAPPING_SHELF"),
    ("products", "category_platform", ["country_code", "catid_num"], "ORPHAN_PLATFORM_CATEGORY"),
]


def reference_issues(tables: dict[str, DataFrame]) -> DataFrame:
    """The issues of all declared references between the tables that are there; a null key is no reference."""
    out = None
    for child, parent, keys, code in REFERENCES:
        if child in tables and parent in tables:
            found = orphan_issues(tables[child].dropna(subset=keys), tables[parent], keys, code, child)
            out = found if out is None else out.union(found)
    return out


#: Names of the columns that hold a date, and prefixes of tables that are series over time, with their keys.
DATE_COLUMNS, SERIES, SERIES_KEYS = ("date", "snapshot_date", "observed_date"), ("products_timeseries", "shop_stats", "product_promotions"), ("product_listing_key", "item_id", "shop_id")


def publish_issues(df: DataFrame, table: str) -> DataFrame:
    """(code, column) of what no table should be published with.

    all_null_column and constant_column (of more than one row), missing_date_in_range (three dates or more, with
    a hole), grain_mismatch (a series over time in which no key has two rows).
    """
    rows = degenerate(df, df.columns)
    many = df.limit(2).count() > 1
    verdicts = {"all_null": "all_null_column"} | ({"constant": "constant_column"} if many else {})
    out = rows.where(F.col("verdict").isin(*verdicts)).select(F.when(F.col("verdict") == "all_null", "all_null_column").otherwise("constant_column").alias("code"), "column")
    date = next((c for c in DATE_COLUMNS if c in df.columns), None)
    if date:
        day = F.to_date(F.try_to_timestamp(F.col(date).cast("string")))
        span = df.select(day.alias("d")).agg(F.count_distinct("d").alias("n"), F.date_diff(F.max("d"), F.min("d")).alias("days"))
        out = out.union(span.where("n >= 3 and days + 1 > n").select(F.lit("missing_date_in_range"), F.lit(date)))
    key = next((c for c in SERIES_KEYS if c in df.columns), None)
    if key and table.startswith(SERIES):
        most = df.groupBy(key).count().agg(F.max("count").alias("n"))
        out = out.union(most.where("n <= 1").select(F.lit("grain_mismatch"), F.lit(key)))
    return out


def repeat_flags(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """df with repeated (another row is equal in columns) and repeats_earlier (such a row stands before it)."""
    equal = Window.partitionBy(*columns)
    return df.withColumns({"repeated": F.count(F.lit(1)).over(equal) > 1, "repeats_earlier": F.row_number().over(equal.orderBy(order)) > 1})


def path_mismatches(df: DataFrame, pairs: dict[str, str], dataset: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Values against those of the path (column to path column): empty ones are filled, others are issues."""
    out, issues = df, None
    for column, path in pairs.items():
        empty = F.col(column).isNull() | (F.trim(F.col(column)) == "")
        bad = issue(df.where(~empty & (F.col(column) != F.col(path))), "error", "PATH_VALUE_MISMATCH", dataset, F.col(key), column, F.col(column))
        issues = bad if issues is None else issues.union(bad)
        out = out.withColumn(column, F.when(empty, F.col(path)).otherwise(F.col(column)))
    return out, issues


def degenerate(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, observed, distinct, verdict): all_null, constant or ok, in one pass."""
    row = df.agg(*(F.struct(F.count(c).alias("observed"), F.count_distinct(c).alias("distinct_values")).alias(c) for c in columns))
    long = row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns))).alias("x"))
    verdict = F.when(F.col("x.s.observed") == 0, "all_null").when(F.col("x.s.distinct_values") == 1, "constant").otherwise("ok")
    return long.select("x.column", "x.s.observed", "x.s.distinct_values", verdict.alias("verdict"))


def capped(df: DataFrame, column: str, *group: str, least: float = 0.2) -> DataFrame:
    """Share of rows at the greatest value, and whether it is so large that the variable looks capped."""
    if group:
        at = df.join(df.groupBy(*group).agg(F.max(column).alias("top")), list(group))
    else:
        at = df.withColumn("top", F.lit(df.agg(F.max(column)).first()[0]))
    out = at.groupBy(*group).agg(F.avg((F.col(column) == F.col("top")).cast("double")).alias("share"))
    return out.select(*group, F.round("share", 6).alias("share"), (F.col("share") >= least).alias("capped"))


def verdict(issues: DataFrame) -> DataFrame:
    """failed if any issue is an error, passed_with_warnings if any is there, else passed."""
    counts = issues.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count(F.lit(1)).alias("issues"))
    return counts.withColumn("status", F.when(F.col("errors") > 0, "failed").when(F.col("issues") > 0, "passed_with_warnings").otherwise("passed"))


def rebuilt_differences(old: DataFrame, new: DataFrame, keys: list[str], numbers: list[str], others: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Rows that only one build has, or that differ: numbers beyond a relative tolerance, others at all."""
    a, b = old.select(*keys, F.struct(*numbers, *others).alias("a")), new.select(*keys, F.struct(*numbers, *others).alias("b"))
    both = a.join(b, keys, "full")

    def same(c: str) -> Column:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c in others:
            return x.eqNullSafe(y)
        return x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= tolerance * F.greatest(F.abs(x), F.abs(y)), F.lit(False))

    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~reduce(lambda p, q: p & q, [same(c) for c in numbers + others]), "changed")
    return both.select(*keys, kind.alias("kind")).where("kind is not null")


def density_gate(coverages: DataFrame, used: list[str], refuse: float = 0.5, qualify: float = 0.95) -> DataFrame:
    """The verdict on each column that a request uses: clarify, qualify or answer."""
    c = F.col("coverage")
    return coverages.where(F.col("column").isin(used)).withColumn("gate", F.when(c < refuse, "clarify").when(c < qualify, "qualify").otherwise("answer"))
