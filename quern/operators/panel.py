"""A panel of listings by snapshot date: derived columns, transitions, gaps, balance, legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.numbers import change_percent
from quern.operators.relational import ContractError

#: A price that stands for "no price".
SENTINEL = 999_999_999


def usable(price: str) -> Column:
    """A price, or null where it stands for "no price"."""
    return F.when(F.col(price) != SENTINEL, F.col(price))


#: The columns of a snapshot row and of a transition row, in order.
SNAPSHOT = [
    "product_listing_key", "product_snapshot_key", "country_code", "shop_id", "item_id", "date", "product_name", "snapshot_gap_flag", "price_sentinel_flag", "price_num", "price_original_num",
    "monthly_sold_value_num", "history_sold_value_num", "rating_num", "rating_count_num", "liked_count_num", "estimated_recent_revenue", "discount_amount", "discount_percent_analysis",
    "pre_final_reduction_proxy", "has_displayed_discount", "has_structured_voucher", "promotion_id_clean", "voucher_discount_num", "is_sold_out_bool", "source_file", "source_row",
]
TRANSITION = [
    "product_listing_key", "country_code", "shop_id", "item_id", "previous_date", "date", "days_since_previous", "transition_metric_eligible", "price_change", "price_change_percent",
    "discount_point_change", "monthly_sold_delta", "history_sold_delta_raw", "history_sold_decrease_flag", "snapshot_sales_delta_clean", "rating_change", "new_rating_count", "like_delta",
    "previous_has_structured_voucher", "has_structured_voucher", "stock_status", "source_file", "source_row",
]


def snapshot_metrics(df: DataFrame) -> DataFrame:
    """The derived columns of a snapshot; a price that stands for none is kept in the row and used in no measure.

    Takes price_num, price_original_num, price_before_promo_num, discount_percent_num, monthly_sold_value_num,
    voucher_discount_num and promotion_id_num. A missing discount is 0 only where the price is the original
    one; has_displayed_discount keeps its nulls, and no voucher value is no voucher.
    """
    price, original = usable("price_num"), usable("price_original_num")
    discount = F.coalesce("discount_percent_num", F.when(price == original, F.lit(0.0)))
    return df.withColumns({
        "price_sentinel_flag": F.coalesce(F.col("price_num") == SENTINEL, F.lit(False)),
        "estimated_recent_revenue": price * F.col("monthly_sold_value_num"),
        "discount_amount": original - price,
        "discount_percent_analysis": discount,
        "pre_final_reduction_proxy": 100 * F.try_divide(original - F.col("price_before_promo_num"), original),
        "has_displayed_discount": discount > 0,
        "has_structured_voucher": F.coalesce("voucher_discount_num", F.lit(0)) > 0,
        "promotion_id_clean": F.nullif("promotion_id_num", F.lit(0)),
    })


def snapshot_issues(df: DataFrame, key: str) -> DataFrame:
    """(key, code) of prices that stand for none, and of missing discounts where the price is not the original one."""
    price, original = usable("price_num"), usable("price_original_num")
    codes = [F.when(F.col("price_num") == SENTINEL, "PRICE_SENTINEL"), F.when(F.col("discount_percent_num").isNull() & (price != original), "MISSING_DISCOUNT_INCONSISTENT_PRICE")]
    return df.select(key, F.explode(F.array_compact(F.array(*codes))).alias("code"))


def transition_metrics(df: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """Each snapshot against the one before of its listing: changes count only from one day to the next.

    Takes the columns that snapshot_metrics gives, besides history_sold_value_num, rating_num,
    rating_count_num, liked_count_num and is_sold_out_bool. A total that falls is flagged and gives no
    clean delta; a price that stands for none gives no change; an unknown stock counts as in stock.
    """
    w = Window.partitionBy(*keys).orderBy(date)
    names = ["price_num", "discount_percent_analysis", "monthly_sold_value_num", "history_sold_value_num", "rating_num", "rating_count_num", "liked_count_num", "is_sold_out_bool", "has_structured_voucher"]
    both = df.withColumns({f"previous_{c}": F.lag(c).over(w) for c in (date, *names)})
    both = both.where(F.col(f"previous_{date}").isNotNull()).withColumn("days_since_previous", F.date_diff(date, f"previous_{date}"))
    both = both.withColumn("transition_metric_eligible", F.col("days_since_previous") == 1)
    eligible = F.col("transition_metric_eligible")

    def moved(c: str) -> Column:
        return F.when(eligible, F.col(c) - F.col(f"previous_{c}"))

    price, before = usable("price_num"), usable("previous_price_num")
    fell = moved("history_sold_value_num") < 0
    was, now = F.coalesce("previous_is_sold_out_bool", F.lit(False)), F.coalesce("is_sold_out_bool", F.lit(False))
    # The states of stock.
    stock = F.when(~eligible, "not_comparable_snapshot_gap").when(~was & now, "newly_sold_out").when(was & ~now, "restocked").when(was & now, "still_sold_out").otherwise("available")
    return both.withColumns({
        "price_change": F.when(eligible, price - before),
        "price_change_percent": F.when(eligible, change_percent(price, before)),
        "discount_point_change": moved("discount_percent_analysis"),
        "monthly_sold_delta": moved("monthly_sold_value_num"),
        "history_sold_delta_raw": moved("history_sold_value_num"),
        "history_sold_decrease_flag": F.coalesce(fell, F.lit(False)),
        "snapshot_sales_delta_clean": F.when(~F.coalesce(fell, F.lit(False)), moved("history_sold_value_num")),
        "rating_change": moved("rating_num"),
        "new_rating_count": moved("rating_count_num"),
        "like_delta": moved("liked_count_num"),
        "voucher_state_transition": F.when(eligible, F.concat_ws("->", F.col("previous_has_structured_voucher").cast("string"), F.col("has_structured_voucher").cast("string"))),
        "stock_status": stock,
    }).drop(*(f"previous_{c}" for c in names if c != "has_structured_voucher"))


def with_gap_flag(df: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """df with snapshot_gap_flag: the listing was seen before, but not on the day before."""
    before = F.lag(date).over(Window.partitionBy(*keys).orderBy(date))
    return df.withColumn("snapshot_gap_flag", F.coalesce(F.date_diff(F.col(date), before) > 1, F.lit(False)))


def passed_through(df: DataFrame, keys: list[str], deltas: list[str]) -> DataFrame:
    """Differences that the data holds already, as they are; names that it does not hold are refused."""
    missing = sorted(set(deltas) - set(df.columns))
    if missing:
        raise ContractError("NOT_MATERIALISED", ", ".join(missing))
    return df.select(*keys, *deltas)


def gaps(df: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """(keys, date, kind) of every day of the whole panel that a listing lacks: internal or edge."""
    first, last = (F.lit(x).cast("date") for x in df.agg(F.min(date), F.max(date)).first())
    seen = df.groupBy(*keys).agg(F.min(date).alias("low"), F.max(date).alias("high"), F.collect_set(date).alias("days"))
    missing = seen.select(*keys, "low", "high", F.explode(F.array_except(F.sequence(first, last), "days")).alias(date))
    return missing.select(*keys, date, F.when(F.col(date).between(F.col("low"), F.col("high")), "internal").otherwise("edge").alias("kind"))


def balanced(df: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """The rows of the listings that were seen on every date."""
    dates = df.agg(F.count_distinct(date).alias("n_dates"))
    every = df.groupBy(*keys).agg(F.count_distinct(date).alias("n")).join(F.broadcast(dates), F.col("n") == F.col("n_dates"), "left_semi")
    return df.join(every.select(*keys), keys, "left_semi")


def balance(df: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """One row: listings, dates, cells = listings x dates, rows seen and cells missing."""
    out = df.agg(F.count_distinct(*keys).alias("listings"), F.count_distinct(date).alias("dates"), F.count_distinct(*keys, date).alias("observed"))
    return out.withColumn("cells", F.col("listings") * F.col("dates")).withColumn("missing", F.col("cells") - F.col("observed"))


def window_delta(legs: DataFrame, keys: list[str], start, end) -> DataFrame:
    """The sum of eligible legs (previous_date, date, delta) that cover start..end without a hole.

    Listings whose legs don't join up give no row, and a listing with no observed delta gives null, not 0.
    """
    inside = legs.where((F.col("previous_date") >= F.lit(start)) & (F.col("date") <= F.lit(end)) & F.col("eligible"))
    w = Window.partitionBy(*keys).orderBy("date")
    joined = inside.withColumn("joins", F.coalesce(F.lead("previous_date").over(w) == F.col("date"), F.lit(True)))
    out = joined.groupBy(*keys).agg(F.min("previous_date").alias("first"), F.max("date").alias("last"), F.bool_and("joins").alias("whole"), F.sum("delta").alias("delta"), F.count("delta").alias("observed"))
    return out.where(F.col("whole") & (F.col("first") == F.lit(start)) & (F.col("last") == F.lit(end))).drop("whole", "first", "last")


def price_panel(df: DataFrame, keys: list[str], event, reach: int = 2, date: str = "date") -> DataFrame:
    """Balanced listings with the lowest price of each day, its phase around an event day, and the share of all listings that they are."""
    every = df.agg(F.count_distinct(*keys)).first()[0]
    kept = balanced(df, keys, date)
    low = kept.groupBy(*keys, date).agg(F.min("price").alias("price"))
    off = F.date_diff(F.col(date), F.lit(event).cast("date"))
    selected = kept.agg(F.count_distinct(*keys)).first()[0]
    phase = F.when(off < -reach, "before").when(off > reach, "after").otherwise("during")
    return low.withColumns({"phase": phase, "selection_share": F.lit(round(selected / every, 6) if every else None).cast("double")})
