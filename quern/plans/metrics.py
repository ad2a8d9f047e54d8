"""The registry of derived metrics: what each is made of, at which grain, and how, as expressions over cleaned columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.numbers import bucket
from quern.operators.panel import passed_through, usable
from quern.operators.relational import ContractError

#: The edges of the discount buckets.
DISCOUNT_EDGES = [0, 10, 20, 40, 100]


@dataclass(frozen=True)
class Metric:
    """grain: transition, snapshot, group or pair. of: columns or other metrics that it is made of. make: None where the data holds it already."""

    grain: str
    unit: str
    of: tuple[str, ...]
    make: Callable[[], Column] | None = None
    caveat: str | None = None


def count_where(condition: Column, key: str = "product_listing_key") -> Column:
    return F.count_distinct(F.when(condition, F.col(key)))


def gap(value: str, flag: str = "has_structured_voucher") -> Column:
    return F.median(F.when(F.col(flag), F.col(value))) - F.median(F.when(~F.col(flag), F.col(value)))


PROXY = "a display of the platform over an unconfirmed window, not verified orders"
METRICS = {
    "monthly_sold_delta": Metric("transition", "units_recent_window", ("monthly_sold_value_num",), caveat=PROXY),
    "history_sold_delta_raw": Metric("transition", "units_cumulative", ("history_sold_value_num",), caveat=PROXY),
    "history_sold_decrease_flag": Metric("transition", "bool", ("history_sold_delta_raw",)),
    "history_sold_delta_clean": Metric("transition", "units_cumulative", ("history_sold_delta_raw", "history_sold_decrease_flag"), lambda: F.col("snapshot_sales_delta_clean"), PROXY),
    "price_change": Metric("transition", "local_currency", ("price_num",)),
    "price_change_pct": Metric("transition", "percent", ("price_change",), lambda: F.col("price_change_percent")),
    "discount_point_change": Metric("transition", "percent_point", ("discount_percent_analysis",)),
    "voucher_state_transition": Metric("transition", "state", ("has_structured_voucher",)),
    "rating_change": Metric("transition", "rating_point", ("rating_num",)),
    "rating_count_delta": Metric("transition", "ratings", ("rating_count_num",), lambda: F.col("new_rating_count")),
    "liked_delta": Metric("transition", "likes", ("liked_count_num",), lambda: F.col("like_delta")),
    "estimated_recent_revenue": Metric("snapshot", "local_currency", ("price_num", "monthly_sold_value_num"), lambda: usable("price_num") * F.col("monthly_sold_value_num"), PROXY),
    "has_structured_voucher": Metric("snapshot", "bool", ("voucher_discount_num",), lambda: F.coalesce("voucher_discount_num", F.lit(0)) > 0),
    "has_voucher_label": Metric("snapshot", "bool", ("vouchers_count_num",), lambda: F.col("vouchers_count_num") > 0),
    "has_promo": Metric("snapshot", "bool", ("has_displayed_discount",), lambda: F.col("has_displayed_discount")),
    "discount_bucket": Metric("snapshot", "bucket", ("discount_percent_num",), lambda: bucket(F.col("discount_percent_num"), DISCOUNT_EDGES)),
    "discounted_listing_count": Metric("group", "listings", ("has_promo",), lambda: count_where(F.col("has_promo"))),
    "discounted_listing_rate": Metric("group", "percent", ("discounted_listing_count", "product_count"), lambda: 100 * F.try_divide(count_where(F.col("has_promo")).cast("double"), F.count_distinct("product_listing_key"))),
    "median_monthly_sold": Metric("group", "units_recent_window", ("monthly_sold_value_num",), lambda: F.median("monthly_sold_value_num"), PROXY),
    "median_estimated_recent_revenue": Metric("group", "local_currency", ("estimated_recent_revenue",), lambda: F.median("estimated_recent_revenue"), PROXY),
    "product_count": Metric("group", "listings", ("product_listing_key",), lambda: F.count_distinct("product_listing_key")),
    "shop_count": Metric("group", "shops", ("shop_id",), lambda: F.count_distinct("shop_id")),
    "observed_day_count": Metric("group", "days", ("date",), lambda: F.count_distinct("date")),
    "brand_count": Metric("group", "brands", ("brand",), lambda: F.count_distinct("brand")),
    "category_count": Metric("group", "categories", ("catid_num",), lambda: F.count_distinct("catid_num")),
    "descriptive_gap_vs_baseline": Metric("group", "same_as_source", ("estimated_recent_revenue", "has_structured_voucher"), lambda: gap("estimated_recent_revenue")),
    "voucher_rate": Metric("group", "share_0_1", ("has_structured_voucher",), lambda: F.avg(F.col("has_structured_voucher").cast("double"))),
    "median_discount_ratio": Metric("group", "ratio_0_1", ("voucher_discount_num", "price_num"), lambda: F.median(F.when(F.col("has_structured_voucher") & (usable("price_num") > 0), F.col("voucher_discount_num") / F.col("price_num")))),
    "descriptive_gap_median_sold": Metric("group", "units_recent_window", ("monthly_sold_value_num", "has_structured_voucher"), lambda: gap("monthly_sold_value_num"), "descriptive only: the groups were not dealt at random"),
    "voucher_profile_score": Metric("group", "score_0_1", ("voucher_rate", "median_discount_ratio", "descriptive_gap_median_sold")),
    **{n: Metric("pair", "score_0_1", of) for n, of in (("text_sim", ("product_name",)), ("category_overlap_depth", ("global_catids",)), ("brand_match", ("brand",)), ("price_distance", ("price_num",)), ("same_shelf_bonus", ("shop_id", "category_id_num")))},
    "similarity_score": Metric("pair", "score_0_1", ("text_sim", "category_overlap_depth", "brand_match", "price_distance", "same_shelf_bonus"), caveat="alike by parts; not the same product"),
}


def derived(df: DataFrame, names: list[str]) -> DataFrame:
    """df with metrics of a row: those with an expression are made, the others have to be there already."""
    for name in names:
        metric = METRICS.get(name)
        if metric is None or metric.grain not in ("transition", "snapshot"):
            raise ContractError("NOT_A_ROW_METRIC", name)
        if metric.make is None:
            passed_through(df, [], [name])
        else:
            df = df.withColumn(name, metric.make())
    return df


def grouped(df: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Metrics of groups, in one aggregation."""
    for name in names:
        if name not in METRICS or METRICS[name].grain != "group" or METRICS[name].make is None:
            raise ContractError("NOT_A_GROUP_METRIC", name)
    return df.groupBy(*by).agg(*(METRICS[n].make().alias(n) for n in names))


def ancestors(name: str) -> list[str]:
    """The metrics that a metric is made of, directly or not."""
    found, todo = [], [name]
    while todo:
        for part in METRICS[todo.pop()].of:
            if part in METRICS and part not in found and part != name:
                found.append(part)
                todo.append(part)
    return sorted(found)


def descendants(name: str) -> list[str]:
    """The metrics that change if this one does."""
    return sorted(m for m in METRICS if name in ancestors(m))


def caveats_of(name: str) -> list[str]:
    """A metric's caveats and those of what it is made of."""
    return [f"{m}: {METRICS[m].caveat}" for m in (name, *ancestors(name)) if METRICS[m].caveat]
