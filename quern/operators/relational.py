"""Joins, deduplication, aggregates, ranking and set operations that a governed plan is made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: The most rows and the last offset that a ranking may ask for.
MOST_ROWS, MOST_OFFSET = 10_000, 98


class ContractError(ValueError):
    """A request that would give a wrong or arbitrary answer; code says which rule it breaks."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def assert_unique(df: DataFrame, keys: list[str]) -> None:
    """Refuse a right side that would multiply rows; checked before the join, not after."""
    if not repeated_keys(df, keys).isEmpty():
        raise ContractError("JOIN_FANOUT", f"{keys} are not unique")


def one_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """df as it is, but a key that repeats is an error when the rows are read: no join can then multiply rows unseen."""
    others = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(F.first(F.struct(*others)).alias("__row"), F.count(F.lit(1)).alias("__n"))
    safe = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit(f"JOIN_FANOUT: {keys} are not unique: "), F.to_json(F.struct(*keys))))).otherwise(F.col("__row"))
    return grouped.select(*keys, safe.alias("__row")).select(*keys, *(F.col(f"__row.{c}").alias(c) for c in others))


def relation_join(left: DataFrame, right: DataFrame, keys: dict[str, str], columns: dict[str, str], date: tuple[str, str] | None = None, small: bool = False, many: bool = False) -> DataFrame:
    """Left join on a declared relation: left's columns and the named ones of right (name to new name).

    date: (left's, right's) date columns; a row without a match on its own date gets nulls, never
    another day's values. small: right is of a bounded size and is broadcast. A right side with repeated
    keys is an error, unless the relation is declared to be `many`; what is then joined has to be
    deduplicated before it is aggregated. A null key matches nothing.
    """
    on = keys | ({date[0]: date[1]} if date else {})
    names = [f"__key_{k}" for k in range(len(on))]
    picked = right.select(*(F.col(r).alias(n) for r, n in zip(on.values(), names, strict=True)), *(F.col(c).alias(n) for c, n in columns.items()))
    if not many and columns:
        picked = one_per_key(picked.dropna(subset=names), names)
    kept = left.drop(*columns.values())
    condition = reduce(lambda a, b: a & b, [kept[le] == picked[n] for le, n in zip(on, names, strict=True)])
    return kept.join(F.broadcast(picked) if small else picked, condition, "left").drop(*names)


def members(df: DataFrame, of: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(of.select(*keys), keys, "left_semi")


def orphans(df: DataFrame, of: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(of.select(*keys), keys, "left_anti")


def latest(df: DataFrame, keys: list[str], by: str, ties: list[str]) -> DataFrame:
    """The row of the greatest `by` of each key; ties go to the smallest of the tie columns."""
    w = Window.partitionBy(*keys).orderBy(F.col(by).desc_nulls_last(), *(F.col(t).asc_nulls_last() for t in ties))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def last_known(df: DataFrame, keys: list[str], by: str, columns: list[str]) -> DataFrame:
    """For each key the last value of each column that is not null; a column may come from an older row."""
    return df.groupBy(*keys).agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(by))).alias(c) for c in columns))


def declared_share(df: DataFrame, group: list[str], flag: Column, key: str, scale: float = 1.0) -> DataFrame:
    """numerator, denominator (distinct keys) and rate of each group; the rate of nothing is null."""
    counted = df.groupBy(*group).agg(F.count_distinct(F.when(flag, F.col(key))).alias("numerator"), F.count_distinct(key).alias("denominator"))
    return counted.withColumn("rate", F.round(scale * F.try_divide(F.col("numerator").cast("double"), F.col("denominator")), 6))


def compare_dates(df: DataFrame, keys: list[str], value: str, date: str, start, end) -> DataFrame:
    """value at two dates and their difference; null where a date was not observed."""
    at = {name: F.max(F.when(F.col(date) == F.lit(d), F.col(value))).alias(name) for name, d in (("value_start", start), ("value_end", end))}
    out = df.where(F.col(date).isin(start, end)).groupBy(*keys).agg(*at.values())
    return out.withColumn("difference", F.col("value_end") - F.col("value_start"))


def ranked(df: DataFrame, by: str, limit: int, ties: list[str], offset: int = 0, descending: bool = True) -> DataFrame:
    """Rows offset+1 .. offset+limit by `by` (nulls last), with position and whether the cuts split equal values.

    A position beyond the end gives no rows. The rows up to the cut, a bounded number, meet in one task.
    """
    if not 1 <= limit <= MOST_ROWS or not 0 <= offset <= MOST_OFFSET:
        raise ContractError("RANK_LIMIT", f"{limit} rows from {offset}")
    order = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    top = df.orderBy(order, *ties).limit(offset + limit + 1)
    w = Window.orderBy(order, *ties)
    numbered = top.withColumn("position", F.row_number().over(w)).withColumns({"__next": F.lead(by).over(w), "__before": F.lag(by).over(w)})
    shown = numbered.where((F.col("position") > offset) & (F.col("position") <= offset + limit))
    lower = (F.col("position") == offset + limit) & (F.col(by) == F.col("__next"))
    upper = (F.col("position") == offset + 1) & (F.col(by) == F.col("__before"))
    return shown.withColumn("tie_at_cut", F.coalesce(lower, F.lit(False)) | F.coalesce(upper, F.lit(False))).drop("__next", "__before")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("position") <= k)


def best_of(df: DataFrame, group: list[str], key: str, order: list[Column], k: int, parts: int = 64) -> DataFrame:
    """top_per_group in two steps: parts of a group, by a hash of key, keep their own best first, so that a group never meets whole."""
    dealt = df.withColumn("__part", F.pmod(F.xxhash64(key), F.lit(parts)))
    return top_per_group(top_per_group(dealt, [*group, "__part"], order, k).drop("position", "__part"), group, order, k)


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def best_row(df: DataFrame, group: list[str], by: str, ties: list[str], smallest: bool = False) -> DataFrame:
    """The whole row with the greatest (or smallest) `by` of each group."""
    order = F.col(by).asc_nulls_last() if smallest else F.col(by).desc_nulls_last()
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(order, *ties))).where("__n = 1").drop("__n")


def union_scope(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL of two to four results of one shape."""
    if not 2 <= len(frames) <= 4:
        raise ContractError("UNION_ARITY", f"{len(frames)} parts")
    shape = [(f.name, f.dataType) for f in frames[0].schema]
    for other in frames[1:]:
        if [(f.name, f.dataType) for f in other.schema] != shape:
            raise ContractError("UNION_SHAPE", "the parts differ in columns or types")
    return reduce(DataFrame.unionByName, frames)


def filter_then_measure(producer: DataFrame, consumer: DataFrame, key: str) -> DataFrame:
    """The consumer's rows whose key the producer found; nulls match nothing."""
    return members(consumer, producer.where(F.col(key).isNotNull()).select(key).distinct(), [key])


def join_results(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join of two finished results on what they share; other names must not meet."""
    clash = set(left.columns) & set(right.columns) - set(on)
    if clash:
        raise ContractError("NAME_COLLISION", ", ".join(sorted(clash)))
    return left.join(right, on, how)


def side_by_side(parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Results as sections under their names: never one frame, and nothing is computed across them."""
    if not 2 <= len(parts) <= 4:
        raise ContractError("SECTION_ARITY", f"{len(parts)} parts")
    return dict(parts)


def canonical(df: DataFrame) -> DataFrame:
    """Rows of no order of their own sorted by all columns, nulls last."""
    return df.orderBy(*(F.col(c).asc_nulls_last() for c in df.columns))


def head(df: DataFrame, shown: int = 10) -> tuple[DataFrame, bool]:
    """The first rows, and whether there are more."""
    return df.limit(shown), df.limit(shown + 1).count() > shown


def tie_policy(ranked_rows: DataFrame, limit: int) -> DataFrame:
    """A ranking of one row whose cut splits equal values is refused; of a longer one the tie stays recorded."""
    if limit == 1 and not ranked_rows.where("tie_at_cut").isEmpty():
        raise ContractError("TIE_AT_TOP", "several rows share the first place")
    return ranked_rows


def steps_of(steps: DataFrame) -> None:
    """Refuse to draw one conclusion from steps (step, value, unit) if one was not answered."""
    if not steps.where(F.col("value").isNull()).isEmpty():
        raise ContractError("STEP_UNANSWERED", "a step has no answer")


def best_step(steps: DataFrame, smallest: bool = False) -> DataFrame:
    """The step of the greatest (or smallest) value; ties go to the first by name."""
    steps_of(steps)
    order = F.col("value").asc() if smallest else F.col("value").desc()
    return steps.orderBy(order, "step").limit(1)


def compare_steps(steps: DataFrame) -> DataFrame:
    """Two answered steps of one unit as one row: high_step, high, low_step, low, difference, relation (higher or equal)."""
    steps_of(steps)
    if steps.count() != 2 or steps.select("unit").distinct().count() != 1:
        raise ContractError("NOT_COMPARABLE", "two steps of one unit are needed")
    row = F.struct("value", F.col("step"))
    ends = steps.agg(F.max(row).alias("a"), F.min(row).alias("b"))
    out = ends.select(F.col("a.step").alias("high_step"), F.col("a.value").alias("high"), F.col("b.step").alias("low_step"), F.col("b.value").alias("low"))
    return out.withColumn("difference", F.col("high") - F.col("low")).withColumn("relation", F.when(F.col("high") == F.col("low"), "equal").otherwise("higher"))


def list_steps(steps: DataFrame) -> DataFrame:
    """Each step with its value, or the rule by which it has none."""
    return steps.select("step", "value", "unit", F.when(F.col("value").isNull(), F.coalesce("rule", F.lit("unanswered"))).alias("rule")).orderBy("step")


def combine_sum(parts: DataFrame, value: str, date: str) -> DataFrame:
    """The sum of step results, refused over several dates, as that would count a thing twice."""
    if parts.select(date).distinct().limit(2).count() > 1:
        raise ContractError("SUM_OVER_DATES", "the steps span several dates")
    return parts.agg(F.sum(value).alias("total"))


def large_groups(df: DataFrame, group: list[str], key: str, least: int) -> DataFrame:
    """The groups with at least `least` distinct keys."""
    return df.groupBy(*group).agg(F.count_distinct(key).alias("n")).where(F.col("n") >= least)


def coverage(df: DataFrame, columns: list[str], *group: str) -> DataFrame:
    """(column, observed, rows, coverage) of each column, overall or by group, in one pass."""
    counted = df.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), *(F.count(c).alias(f"__{c}") for c in columns))
    long = counted.select(*group, "rows", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"__{c}").alias("observed")) for c in columns))).alias("s"))
    return long.select(*group, "s.column", "s.observed", "rows", F.round(F.try_divide(F.col("s.observed").cast("double"), F.col("rows")), 6).alias("coverage"))


def fold_levels(df: DataFrame, dimensions: list[str], measures: dict[str, Column], cube: bool = False) -> DataFrame:
    """Totals at every level (rollup) or combination (cube) of the dimensions, with the level's number."""
    grouped = df.cube(*dimensions) if cube else df.rollup(*dimensions)
    return grouped.agg(*(c.alias(n) for n, c in measures.items()), F.grouping_id().cast("long").alias("level"))
