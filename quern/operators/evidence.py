"""Checks on a result and on the evidence drawn from it; each gives the rows that break a rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.relational import ContractError


def check_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The result's columns are the declared ones, in order."""
    if df.columns != names:
        raise ContractError("COLUMN_CONTRACT", f"{df.columns} are not {names}")
    return df


def check_rows(df: DataFrame, exact: int | None = None, most: int | None = None) -> DataFrame:
    """The number of rows, counted no further than the bound needs."""
    bound = exact if exact is not None else most
    n = df.limit(bound + 1).count()
    if n > bound or exact is not None and n < exact:
        raise ContractError("CARDINALITY", f"{n} rows where {bound} are declared")
    return df


def bounds(snapshot_rows: DataFrame, key: str, date: str) -> dict[str, int]:
    """The sizes that a declared cardinality may name: snapshot_rows, listings and snapshots."""
    row = snapshot_rows.agg(F.count(F.lit(1)), F.count_distinct(key), F.count_distinct(date)).first()
    return dict(zip(("snapshot_rows", "listings", "snapshots"), row, strict=True))


def check_cardinality(df: DataFrame, declared: str, named: dict[str, int]) -> DataFrame:
    """`12`, `<= 12`, `listings` or `<= listings`: the number of rows is that, or at most that."""
    text = declared.replace(" ", "")
    most, name = text.startswith("<="), text.removeprefix("<=")
    if not name.isdigit() and name not in named:
        raise ContractError("CARDINALITY", f"{name} is no size")
    size = int(name) if name.isdigit() else named[name]
    return check_rows(df, most=size) if most else check_rows(df, exact=size)


def check_fanout(df: DataFrame, inputs: list[DataFrame], times: int = 8) -> DataFrame:
    """A joined intermediate has at most `times` the rows of its largest input."""
    return check_rows(df, most=times * max(i.count() for i in inputs))


def broken(df: DataFrame, postconditions: list[str]) -> DataFrame:
    """(condition, n) of the postconditions that rows break: unique:a,b; nonnegative:a; range:a:low:high."""
    out = None
    for condition in postconditions:
        kind, _, rest = condition.partition(":")
        if kind == "unique":
            rows = not_unique(df, rest.split(","))
        elif kind == "nonnegative":
            rows = negative(df, rest.split(","))
        elif kind == "range":
            column, low, high = rest.split(":")
            rows = outside(df, column, float(low), float(high))
        else:
            raise ContractError("UNKNOWN_POSTCONDITION", condition)
        counted = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(condition).alias("condition"), "n").where("n > 0")
        out = counted if out is None else out.union(counted)
    return out


#: The range of a value by its unit.
UNIT_RANGES = {"percent": (0.0, 100.0), "ratio": (0.0, 1.0), "count": (0.0, None)}


def off_unit(df: DataFrame, value: str, unit: str) -> DataFrame:
    """Evidence whose value lies outside of what its unit allows; a count has to be whole."""
    v, found = F.col(value), F.lit(False)
    for name, (low, high) in UNIT_RANGES.items():
        bad = (v < low) | (F.lit(False) if high is None else v > high)
        found = F.when(F.col(unit) == name, bad | ((v != F.floor(v)) if name == "count" else F.lit(False))).otherwise(found)
    return df.where(F.coalesce(found, F.lit(False)))


def off_share(df: DataFrame, key: str, parents: tuple[str, str], scale: str, tolerance: float = 1e-6) -> DataFrame:
    """Shares that are not scale x numerator / denominator of the evidence that they name.

    df: key, value, the two parents' keys and scale. A share whose parent is missing is broken too; one over
    zero has to be null.
    """
    top, bottom = (df.select(F.col(key).alias(p), F.col("value").alias(f"__{k}")) for k, p in enumerate(parents))
    both = df.where(F.col(parents[0]).isNotNull()).join(top, parents[0], "left").join(bottom, parents[1], "left")
    want = F.col(scale) * F.try_divide(F.col("__0"), F.col("__1"))
    close = F.abs(F.col("value") - want) <= tolerance * F.greatest(F.lit(1.0), F.abs(want))
    fine = F.when(F.col("__0").isNull() | F.col("__1").isNull(), False).when(want.isNull(), F.col("value").isNull()).otherwise(F.coalesce(close, F.lit(False)))
    return both.where(~fine).select(key, "value", want.alias("expected"))


def off_delta(df: DataFrame, key: str, start: str, end: str, tolerance: float = 1e-6) -> DataFrame:
    """Deltas that are not end - start of the evidence that they name; a missing parent breaks them."""
    a, b = (df.select(F.col(key).alias(p), F.col("value").alias(f"__{k}")) for k, p in enumerate((start, end)))
    both = df.where(F.col(start).isNotNull()).join(a, start, "left").join(b, end, "left")
    want = F.col("__1") - F.col("__0")
    close = F.abs(F.col("value") - want) <= tolerance * F.greatest(F.lit(1.0), F.abs(want))
    return both.where(~F.coalesce(close, F.lit(False))).select(key, "value", want.alias("expected"))


def not_covered(df: DataFrame, column: str, asked: DataFrame) -> DataFrame:
    """The dates or markets that were asked for and of which there is no evidence."""
    return asked.select(column).distinct().join(df.select(column).distinct(), column, "left_anti")


def not_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def negative(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [F.col(c) < 0 for c in columns]))


def outside(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.where(~F.col(column).between(low, high))


def disordered(df: DataFrame, low: str, middle: str, high: str) -> DataFrame:
    return df.where((F.col(low) > F.col(middle)) | (F.col(middle) > F.col(high)))


def parts_off_total(parts: DataFrame, totals: DataFrame, scope: list[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    """Scopes whose parts don't sum to the stated total."""
    sums = parts.groupBy(*scope).agg(F.sum(value).alias("parts"))
    both = sums.join(totals.select(*scope, F.col(value).alias("total")), scope, "full")
    close = F.abs(F.col("parts") - F.col("total")) <= tolerance * F.greatest(F.lit(1.0), F.abs("total"))
    return both.where(~F.coalesce(close, F.lit(False)))


def evidence(df: DataFrame, keys: list[str], metrics: list[str], source: str) -> DataFrame:
    """(evidence_id, metric, value, locator) for every cell that is not null."""
    locator = F.concat_ws("|", *(F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in keys))
    cells = df.select(locator.alias("locator"), F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("c"))
    shown = cells.where(F.col("c.value").isNotNull())
    return shown.select(F.substring(F.sha2(F.concat_ws("|", F.lit(source), "locator", "c.metric"), 256), 1, 16).alias("evidence_id"), "c.metric", "c.value", "locator")
