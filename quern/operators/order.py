"""Order statistics that hold no large group whole: counts per value, running counts over ranges of values, and what follows.

Quantiles and medians of groups of at most `GATHER` values are read from the sorted values of each. For all else rows are counted per group and value first. The values of a group are then cut into at most `RANGES` ranges,
whose sums give each range its offset, and running counts are windows over one range only. So a group that
holds most of all rows is neither sorted nor kept in one task, however many different values it has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64
#: Values of a group that are sorted in one place.
GATHER = 50_000
#: Stands for the group of all rows.
ALL = "__all"


def join_equal(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of both, a null being equal to a null; the columns are kept once."""
    names = {c: f"__right_{k}" for k, c in enumerate(on)}
    other = right.withColumnsRenamed(names)
    condition = reduce(lambda a, b: a & b, [left[c].eqNullSafe(other[n]) for c, n in names.items()])
    return left.join(other, condition, how).drop(*names.values())


def running_counts(df: DataFrame, group: list[str], value: str, ranges: int = RANGES) -> DataFrame:
    """(group, value, n, before, total): rows with the value, with a smaller one, and in the group; nulls are left out."""
    if not group:
        return running_counts(df.withColumn(ALL, F.lit(0)), [ALL], value, ranges).drop(ALL)
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    cuts = counts.groupBy(*group).agg(F.percentile_approx(value, [k / ranges for k in range(1, ranges)], 10 * ranges).alias("__cuts"))
    ranged = join_equal(counts, cuts, group).withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")
    sums = ranged.groupBy(*group, "__range").agg(F.sum("n").alias("__n"))
    whole = Window.partitionBy(*group)  # of at most RANGES rows a group
    offsets = sums.select(*group, "__range", F.coalesce(F.sum("__n").over(whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(whole).alias("total"))
    inside = Window.partitionBy(*group, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = join_equal(ranged.withColumn("__at", F.coalesce(F.sum("n").over(inside), F.lit(0))), offsets, [*group, "__range"])
    return placed.select(*group, value, "n", (F.col("__before") + F.col("__at")).alias("before"), "total")


def quantiles(df: DataFrame, group: list[str], value: str, wanted: dict[str, float], nearest: bool = False) -> DataFrame:
    """Exact quantiles of each group by name, interpolated, or (nearest) the value at the nearest rank; nulls are left out."""

    def rank(name: str, total: Column) -> Column:
        return F.greatest(F.ceil(wanted[name] * total) - 1, F.lit(0)).cast("double") if nearest else (total - 1) * F.lit(float(wanted[name]))

    def gathered(rows: DataFrame) -> DataFrame:
        lists = rows.groupBy(*group).agg(F.sort_array(F.collect_list(value)).alias("__sorted"))
        made = {}
        for name in wanted:
            at = rank(name, F.size("__sorted").cast("long"))
            made |= {f"__{end}_{name}": F.get("__sorted", f(at).cast("int")) for end, f in (("lo", F.floor), ("hi", F.ceil))} | {f"__part_{name}": at - F.floor(at)}
        return lists.select(*group, *(c.alias(n) for n, c in made.items()))

    def counted(rows: DataFrame) -> DataFrame:
        made = {}
        for name in wanted:
            at = rank(name, F.col("total"))
            for end, f in (("lo", F.floor), ("hi", F.ceil)):
                made[f"__{end}_{name}"] = F.max(F.when((F.col("before") <= f(at)) & (f(at) < F.col("before") + F.col("n")), F.col(value)))
            made[f"__part_{name}"] = F.max(at - F.floor(at))
        return running_counts(rows, group, value).groupBy(*group).agg(*(c.alias(n) for n, c in made.items()))

    if not group:
        ends = counted(df)
    else:
        rows = df.where(F.col(value).isNotNull()).select(*group, value)
        large = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__size")).where(F.col("__size") > GATHER).drop("__size")
        if large.isEmpty():
            ends = gathered(rows)
        else:  # of all rows at most one in GATHER is a large group
            rest, most = (join_equal(rows, F.broadcast(large), group, how) for how in ("left_anti", "left_semi"))
            ends = gathered(rest).unionByName(counted(most))

    def between(name: str) -> Column:
        low, high, part = (F.col(f"__{end}_{name}") for end in ("lo", "hi", "part"))
        return low if nearest else low.cast("double") + (high - low).cast("double") * part

    return ends.select(*group, *(between(name).alias(name) for name in wanted))


def medians_of_groups(df: DataFrame, group: list[str], values: list[str], distinct: dict[str, str], aggregates: dict[str, Column]) -> DataFrame:
    """Per group: the exact median of each of the values, under its name, the distinct counts (name to column) and other aggregates; nulls are left out.

    Groups of at most `GATHER` rows are read once and leave their tasks as the lists of their values, with all
    else that is asked of them. Medians of larger ones go by ranges (`quantiles`), so that none meets whole.
    """

    def listed(rows: DataFrame) -> DataFrame:
        lists = rows.groupBy(*group).agg(
            *(F.size(F.array_distinct(F.collect_list(c))).cast("long").alias(n) for n, c in distinct.items()),
            *(c.alias(n) for n, c in aggregates.items()),
            *(F.sort_array(F.collect_list(F.col(c).cast("double"))).alias(c) for c in values),
        )
        low, high = ({c: F.get(c, f((F.size(c) - 1) * F.lit(0.5)).cast("int")) for c in values} for f in (F.floor, F.ceil))
        return lists.select(*group, *distinct, *aggregates, *((low[c] + (high[c] - low[c]) * F.lit(0.5)).alias(c) for c in values))

    def ranged(rows: DataFrame) -> DataFrame:
        counted = rows.groupBy(*group).agg(*(F.count_distinct(c).alias(n) for n, c in distinct.items()), *(c.alias(n) for n, c in aggregates.items()))
        cells = F.explode(F.array(*(F.struct(F.lit(c).alias("__of"), F.col(c).cast("double").alias("__v")) for c in values))).alias("__cell")
        medians = quantiles(rows.select(*group, cells).select(*group, "__cell.*"), [*group, "__of"], "__v", {"__median": 0.5})
        wide = medians.groupBy(*group).agg(*(F.max(F.when(F.col("__of") == c, F.col("__median"))).alias(c) for c in values))
        return join_equal(counted, wide, group, "left")

    large = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__size")).where(F.col("__size") > GATHER).drop("__size")
    if large.isEmpty():
        return listed(df)
    rest, most = (join_equal(df, F.broadcast(large), group, how) for how in ("left_anti", "left_semi"))
    return listed(rest).unionByName(ranged(most))


def rank_percentiles(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """df with the average-rank percentile of value in its group: (rank - 1) / (n - 1); a lone value 0.5, null for null."""
    counted = running_counts(df, group, value)
    p = F.when(F.col("total") == 1, 0.5).otherwise((F.col("before") + (F.col("n") - 1) / 2) / (F.col("total") - 1))
    return join_equal(df, counted.select(*group, value, p.alias(name)), [*group, value], "left")


def scaled(df: DataFrame, group: list[str], values: dict[str, str]) -> DataFrame:
    """df with each value (name to column) scaled to 0..1 between the ends of its group; 1 where all are equal."""
    if not group:
        return scaled(df.withColumn(ALL, F.lit(0)), [ALL], values).drop(ALL)
    ends = df.groupBy(*group).agg(*(f(c).alias(f"__{f.__name__}_{n}") for n, c in values.items() for f in (F.min, F.max)))
    both = join_equal(df, ends, group, "left")
    low, high = {n: F.col(f"__min_{n}") for n in values}, {n: F.col(f"__max_{n}") for n in values}
    made = {n: F.when(F.col(c).isNull(), None).when(high[n] == low[n], 1.0).otherwise(F.try_divide((F.col(c) - low[n]).cast("double"), (high[n] - low[n]).cast("double"))) for n, c in values.items()}
    return both.withColumns(made).drop(*(f"__{f}_{n}" for n in values for f in ("min", "max")))
