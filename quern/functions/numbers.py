"""Numbers as Column expressions: shares, changes, percentiles, scaling, paths and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def change_percent(new: Column, old: Column) -> Column:
    return 100 * F.try_divide((new - old).cast("double"), old.cast("double"))


def to_number(c: Column) -> Column:
    return c.try_cast("double")


def to_flag(c: Column) -> Column:
    """true/false from the usual words; null for anything else."""
    low = F.lower(F.trim(c))
    return F.when(low.isin("true", "1", "yes", "t"), True).when(low.isin("false", "0", "no", "f"), False)


def quintile(p: Column) -> Column:
    """1..5 from a percentile; null for null."""
    return F.when(p.isNotNull(), F.least(F.lit(5), F.floor(p * 5) + 1)).cast("int")


def bucket(value: Column, edges: list[float]) -> Column:
    """The label of the interval (low, high] that holds value; 0 has one of its own."""
    out = F.when(value == 0, "0")
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        out = out.when((value > low) & (value <= high), f"({low:g},{high:g}]")
    return out


def shared_depth(a: Column, b: Column) -> Column:
    """How many levels two paths share from the top."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    state = F.aggregate(same, F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, x: F.struct((s["on"] & x).alias("on"), (s["n"] + (s["on"] & x).cast("int")).alias("n")))
    return state["n"]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))
