"""Queries over a marketplace made of the driver's tables: listings are users of `events` by day, shops are suppliers.

Each has the SQL that states the same; the tables of both are built apart, in DataFrames and in SQL.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import evidence, mart, panel, quality, tools
from quern.operators import relational as r
from quern.plans import dates, metrics, templates
from quern.plans.market import SHOP_STATISTICS, market_pack
from quern.plans.model import Request, absent_literals, answer, boundary_report, completed, excluded_rows, extreme_row
from quern.queries import SEGMENT_SQL, money, moves, query, scored_listings, table
from quern.sources import adapter

SENTINEL = panel.SENTINEL
MARKET_SQL = """WITH daily AS (SELECT user_id, CAST(ts AS DATE) AS date, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS amount, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks,
count(*) FILTER (event_type = 'purchase') AS buys, count(*) FILTER (event_type = 'error') AS errors, max(event_id) % 1000 AS total FROM events GROUP BY user_id, CAST(ts AS DATE)),
products AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'vn' ELSE 'id' END AS country_code, user_id % 10 AS shop_id, user_id AS item_id, date, CASE WHEN user_id % 2 = 0 THEN 'vn' ELSE 'id' END || ':' || user_id % 10 || ':' || user_id AS product_listing_key,
'Item ' || user_id AS product_name, CASE WHEN user_id % 6 < 5 THEN 'Brand ' || user_id % 6 END AS brand, user_id % 7 AS catid_num, CASE WHEN user_id % 13 = 12 THEN 999999999.0 ELSE amount END AS price_num,
CASE WHEN user_id % 3 = 0 THEN amount ELSE amount * 2 END AS price_original_num, amount AS price_before_promo_num, CASE WHEN user_id % 3 = 1 THEN 50.0 END AS discount_percent_num, views AS monthly_sold_value_num,
total AS history_sold_value_num, CAST(1 + (user_id + clicks) % 5 AS DOUBLE) AS rating_num, clicks + views AS rating_count_num, clicks AS liked_count_num, buys AS vouchers_count_num, CASE WHEN buys > 0 THEN CAST(buys AS DOUBLE) END AS voucher_discount_num,
errors % 3 AS promotion_id_num, errors > 0 AS is_sold_out_bool, user_id % 4 = 0 AS shopee_verified FROM daily),
shop_info AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'vn' ELSE 'id' END AS country_code, s_suppkey AS shop_id, s_name AS shop_name, s_suppkey % 3 = 0 AS is_official_shop, s_suppkey % 5 = 1 AS vacation, CAST(s_suppkey % 5 AS DOUBLE) AS rating_star, s_acctbal AS follower_count FROM supplier),
category_platform AS (SELECT c.country_code, n_nationkey AS category_id_num, n_name AS display_category_name, n_regionkey % 2 = 0 AS has_children FROM nation, (VALUES ('vn'), ('id')) c(country_code)),
shelves AS (SELECT country_code, shop_id, item_id, date, 'Shelf ' || k AS shelf_name, k * 10 AS shelf_total FROM (SELECT *, unnest([item_id % 3, 3 + item_id % 2]) AS k FROM products)),
usable AS (SELECT *, CASE WHEN price_num <> 999999999 THEN price_num END AS p, CASE WHEN price_original_num <> 999999999 THEN price_original_num END AS o FROM products),
snapshots AS (SELECT *, price_num = 999999999 AS price_sentinel_flag, p * monthly_sold_value_num AS estimated_recent_revenue, o - p AS discount_amount, coalesce(discount_percent_num, CASE WHEN p = o THEN 0.0 END) AS discount_percent_analysis,
100 * (o - price_before_promo_num) / nullif(o, 0) AS pre_final_reduction_proxy, coalesce(discount_percent_num, CASE WHEN p = o THEN 0.0 END) > 0 AS has_displayed_discount, coalesce(voucher_discount_num, 0) > 0 AS has_structured_voucher, nullif(promotion_id_num, 0) AS promotion_id_clean FROM usable),
last_day AS (SELECT max(date) AS d FROM products)
"""


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, item = F.col("event_type"), F.col("item_id")
    daily = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("item_id"), F.to_date("ts").alias("date")).agg(
        F.sum(money("value")).cast("double").alias("amount"), *(F.count_if(kind == k).alias(n) for k, n in (("view", "views"), ("click", "clicks"), ("purchase", "buys"), ("error", "errors"))), (F.max("event_id") % 1000).alias("total"),
    )
    country, shop, errors = F.when(item % 2 == 0, "vn").otherwise("id"), item % 10, F.col("errors")
    return daily.select(
        country.alias("country_code"), shop.alias("shop_id"), "item_id", "date", text.key_of(country, shop, item).alias("product_listing_key"), F.concat(F.lit("Item "), item).alias("product_name"),
        F.when(item % 6 < 5, F.concat(F.lit("Brand "), item % 6)).alias("brand"), (item % 7).alias("catid_num"), F.when(item % 13 == 12, float(SENTINEL)).otherwise(F.col("amount")).alias("price_num"),
        F.when(item % 3 == 0, F.col("amount")).otherwise(F.col("amount") * 2).alias("price_original_num"), F.col("amount").alias("price_before_promo_num"), F.when(item % 3 == 1, 50.0).alias("discount_percent_num"),
        F.col("views").alias("monthly_sold_value_num"), F.col("total").alias("history_sold_value_num"), (1 + (item + F.col("clicks")) % 5).cast("double").alias("rating_num"), (F.col("clicks") + F.col("views")).alias("rating_count_num"),
        F.col("clicks").alias("liked_count_num"), F.col("buys").alias("vouchers_count_num"), F.when(F.col("buys") > 0, F.col("buys").cast("double")).alias("voucher_discount_num"), (errors % 3).alias("promotion_id_num"),
        (errors > 0).alias("is_sold_out_bool"), (item % 4 == 0).alias("shopee_verified"),
    )


def shop_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    other = {c: F.lit(None).cast("double").alias(c) for c in ("item_count", "response_rate", "response_time", "cancellation_rate", "rating_good", "rating_normal", "rating_bad")}
    return table(spark, sf_dir, "supplier").select(
        F.when(key % 2 == 0, "vn").otherwise("id").alias("country_code"), key.alias("shop_id"), F.col("s_name").alias("shop_name"), (key % 3 == 0).alias("is_official_shop"), (key % 5 == 1).alias("vacation"),
        (key % 5).cast("double").alias("rating_star"), F.col("s_acctbal").alias("follower_count"), *other.values(),
    )


def category_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.explode(F.array(F.lit("vn"), F.lit("id"))).alias("country_code")
    return table(spark, sf_dir, "nation").select(both, F.col("n_nationkey").alias("category_id_num"), F.col("n_name").alias("display_category_name"), (F.col("n_regionkey") % 2 == 0).alias("has_children"))


def product_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.col("item_id")
    k = F.explode(F.array(item % 3, 3 + item % 2)).alias("k")
    rows = products(spark, sf_dir).select("country_code", "shop_id", "item_id", "date", k)
    return rows.select("*", F.concat(F.lit("Shelf "), "k").alias("display_name"), (F.col("k") * 10).alias("total"), (F.col("k") == 0).alias("is_parent_category"), (F.col("k") != 0).alias("is_sub_category"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.snapshot_metrics(products(spark, sf_dir))


def shop_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily statistics of a shop: followers are likes, items its listings; the others are empty."""
    rows = products(spark, sf_dir).groupBy("country_code", "shop_id", "date").agg(F.sum("liked_count_num").alias("followers"), F.count(F.lit(1)).alias("items"), F.max("rating_num").alias("rating"))
    return rows.withColumns({c: F.lit(None).cast("double") for c in SHOP_STATISTICS if c not in rows.columns})


MARKET = market_pack({"products": products, "shop_info": shop_info, "category_platform": category_platform, "product_categories": product_categories, "snapshot_metrics": snapshots, "shop_stats": shop_stats})


def asked(spark: SparkSession, sf_dir: str, request: Request) -> DataFrame:
    return answer(MARKET, completed(MARKET, request), spark=spark, sf_dir=sf_dir)


def rounded(df: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# --- requests over the pack ------------------------------------------------------------------------


@query(MARKET_SQL + "SELECT country_code AS country, CAST(median(monthly_sold_value_num) AS DOUBLE) AS value FROM products, last_day WHERE date = d GROUP BY 1")
def request_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No aggregation and no date are named: the median at the latest snapshot."""
    return asked(spark, sf_dir, Request("monthly_sold", by=("country",)))


@query(MARKET_SQL + "SELECT country_code AS country, round(avg(CAST(has_displayed_discount AS DOUBLE)), 6) AS value, count(DISTINCT product_listing_key) AS count_product_listing FROM snapshots, last_day WHERE date = d GROUP BY 1")
def request_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(asked(spark, sf_dir, Request("displayed_discount", "share", by=("country",), also=(("product_listing", "count"),))), "value", places=6)


@query(MARKET_SQL + "SELECT p.shop_id AS shop, shop_name AS shop_label, count(DISTINCT product_listing_key) AS value, max(p.price_num) FILTER (price_num < 999999999) AS max_price FROM products p LEFT JOIN shop_info s ON p.country_code = s.country_code AND p.shop_id = s.shop_id, last_day WHERE date = d AND p.country_code = 'vn' GROUP BY 1, 2")
def request_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir, Request("product_listing", "count", by=("shop",), where=(("country", "eq", "vn"),), also=(("price", "max"),)))


@query(MARKET_SQL + "SELECT shelf_name AS shop_category_name, round(median(CASE WHEN price_num < 999999999 THEN price_num END), 4) AS value FROM products p JOIN shelves s USING (country_code, shop_id, item_id, date), last_day WHERE date = d AND country_code = 'id' GROUP BY 1")
def request_shelves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation to shelves multiplies rows: a listing counts once on each of its shelves."""
    return rounded(asked(spark, sf_dir, Request("price", "median", by=("shop_category_name",), where=(("country", "eq", "id"),))), "value")


@query(MARKET_SQL + "SELECT country_code AS country, CAST(sum(liked_count_num) AS BIGINT) AS value FROM products p, last_day WHERE date = d AND EXISTS (SELECT 1 FROM shelves s WHERE s.item_id = p.item_id AND s.date = p.date AND s.shelf_name IN ('Shelf 0', 'Shelf 3')) GROUP BY 1")
def request_dedupe_before_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the filter is on shelves: a listing on both of them is summed once."""
    return asked(spark, sf_dir, Request("liked_count", "sum", by=("country",), where=(("shop_category_name", "in", ["Shelf 0", "Shelf 3"]),), snapshot="latest"))


@query(MARKET_SQL + "SELECT display_category_name AS platform_category_name, CAST(median(rating_num) AS DOUBLE) AS value FROM products LEFT JOIN category_platform c ON c.country_code = products.country_code AND catid_num = category_id_num, last_day WHERE date = d AND NOT coalesce(has_children, true) GROUP BY 1")
def request_platform_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir, Request("rating", by=("platform_category_name",), where=(("platform_category_has_children", "eq", False),)))


@query(MARKET_SQL + ", s AS (SELECT country_code, shop_id, date, sum(liked_count_num) AS followers FROM products GROUP BY ALL) SELECT p.country_code AS country, CAST(max(followers) AS BIGINT) AS value FROM products p JOIN s USING (country_code, shop_id, date), last_day WHERE date = d GROUP BY 1")
def request_shop_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir, Request("shop_daily_followers", "max", by=("country",)))


@query(MARKET_SQL + "SELECT p.country_code AS country, count(DISTINCT product_listing_key) AS value FROM snapshots p LEFT JOIN shop_info s ON p.country_code = s.country_code AND p.shop_id = s.shop_id, last_day WHERE date = d AND is_official_shop AND vouchers_count_num <= 0 AND NOT has_structured_voucher AND NOT vacation GROUP BY 1")
def request_qualifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    having = (("shop_official", True), ("has_voucher_label", False), ("has_structured_voucher", False), ("shop_vacation", False))
    return asked(spark, sf_dir, Request("product_listing", by=("country",), having=having))


@query(MARKET_SQL + "SELECT brand, CAST(median(monthly_sold_value_num) AS DOUBLE) AS value FROM products, last_day WHERE date = d AND country_code = 'vn' AND price_num >= 100 AND rating_num < 5 GROUP BY 1")
def request_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    above = (("price", "gte", 100, "local_currency"), ("rating", "lt", 5, "rating_point"))
    return asked(spark, sf_dir, Request("monthly_sold", by=("brand",), where=(("country", "eq", "vn"),), above=above))


@query(MARKET_SQL + "SELECT country_code AS country, count(DISTINCT product_listing_key) AS value FROM products WHERE date BETWEEN DATE '2024-01-01' AND DATE '2024-01-07' GROUP BY 1")
def request_named_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct listings over the first week, and not the sum of its days."""
    calendar = [x["date"] for x in products(spark, sf_dir).select("date").distinct().collect()]
    return asked(spark, sf_dir, Request("product_listing", by=("country",), dates=dates.asked(["first_week"], calendar)))


@query(MARKET_SQL + "SELECT shop_id AS shop, shop_name AS shop_label, value, CAST(i AS INT) AS position, coalesce(value = nx AND i = 5, false) AS tie_at_cut FROM (SELECT *, row_number() OVER w AS i, lead(value) OVER w AS nx FROM (SELECT p.shop_id, shop_name, count(DISTINCT product_listing_key) AS value FROM products p LEFT JOIN shop_info s ON p.country_code = s.country_code AND p.shop_id = s.shop_id, last_day WHERE date = d GROUP BY 1, 2) WINDOW w AS (ORDER BY value DESC, shop_id)) WHERE i <= 5")
def request_rank_plural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.tie_policy(asked(spark, sf_dir, Request("product_listing", by=("shop",), rank="some")), 5)


@query(MARKET_SQL + "SELECT country_code, shop_id, item_id, date, brand, price_num AS value FROM products, last_day WHERE date = d AND country_code = 'vn' AND price_num < 999999999 ORDER BY price_num DESC, item_id LIMIT 1")
def request_extreme_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extreme_row(MARKET, completed(MARKET, Request("price", "max", by=("brand",), where=(("country", "eq", "vn"),))), spark=spark, sf_dir=sf_dir)


@query(MARKET_SQL + "SELECT 'price-sentinel' AS decision, count(*) FILTER (price_num = 999999999) AS n FROM products")
def request_excluded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates_of = [x["date"] for x in products(spark, sf_dir).select("date").distinct().collect()]
    return excluded_rows(MARKET, Request("price", "median", by=("country",), dates=tuple(dates_of)), spark=spark, sf_dir=sf_dir)


@query(MARKET_SQL + "SELECT product_listing_key, date, price_num, 'price-nines' AS decision FROM products WHERE price_num = 999999999")
def request_boundary_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = products(spark, sf_dir).select("product_listing_key", "date", "price_num")
    return boundary_report(MARKET, Request("price", "max"), rows)


@query("SELECT * FROM (VALUES ('brand', 'Brand 99'), ('shop_name', 'No shop')) t(dimension, value)")
def request_absent_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = (("country", "eq", "vn"), ("brand", "in", ["Brand 1", "Brand 99"]), ("shop_name", "eq", "No shop"))
    return absent_literals(MARKET, Request("product_listing", "count", where=where), spark=spark, sf_dir=sf_dir)


@query(MARKET_SQL + """, v AS (SELECT * FROM snapshots WHERE country_code = 'vn'), l AS (SELECT v.* FROM v, last_day WHERE date = d)
SELECT 'listing_count' AS template, CAST(count(DISTINCT product_listing_key) AS DOUBLE) AS value, NULL AS label FROM l UNION ALL SELECT 'highest_price', max(p), NULL FROM l UNION ALL SELECT 'highest_sold', max(monthly_sold_value_num), NULL FROM l
UNION ALL SELECT * FROM (SELECT 'top_shop', count(DISTINCT product_listing_key), CAST(shop_id AS VARCHAR) FROM l GROUP BY shop_id ORDER BY 2 DESC, shop_id LIMIT 1)
UNION ALL SELECT 'median_price_by_date', round(median(p), 4), CAST(date AS VARCHAR) FROM v GROUP BY date
UNION ALL SELECT * FROM (SELECT 'highest_revenue_day', round(median(estimated_recent_revenue), 4), CAST(date AS VARCHAR) FROM v GROUP BY date ORDER BY median(estimated_recent_revenue) DESC, date LIMIT 1)""")
def request_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in ("listing_count", "highest_price", "highest_sold", "top_shop", "median_price_by_date", "highest_revenue_day"):
        request = getattr(templates, name)("vn")
        label = F.col(request.by[0]).cast("string") if request.by else F.lit(None).cast("string")
        rows = asked(spark, sf_dir, request).select(F.lit(name).alias("template"), F.round(F.col("value").cast("double"), 4).alias("value"), label.alias("label"))
        out = rows if out is None else out.union(rows)
    return out


# --- derived columns -------------------------------------------------------------------------------


@query(MARKET_SQL + """SELECT product_listing_key, product_listing_key || ':' || date AS product_snapshot_key, country_code, shop_id, item_id, date, product_name, coalesce(date - lag(date) OVER (PARTITION BY item_id ORDER BY date) > 1, false) AS snapshot_gap_flag, price_sentinel_flag, price_num, price_original_num, monthly_sold_value_num, history_sold_value_num,
rating_num, rating_count_num, liked_count_num, round(estimated_recent_revenue, 4) AS estimated_recent_revenue, round(discount_amount, 4) AS discount_amount, discount_percent_analysis, round(pre_final_reduction_proxy, 4) AS pre_final_reduction_proxy, has_displayed_discount, has_structured_voucher, promotion_id_clean, voucher_discount_num, is_sold_out_bool, 'events' AS source_file, item_id + 1 AS source_row FROM snapshots""")
def snapshot_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel.with_gap_flag(snapshots(spark, sf_dir), ["item_id"]).withColumns({"product_snapshot_key": text.key_of("product_listing_key", F.col("date").cast("string")), "source_file": F.lit("events"), "source_row": F.col("item_id") + 1})
    return rounded(rows.select(*panel.SNAPSHOT), "estimated_recent_revenue", "discount_amount", "pre_final_reduction_proxy")


MARKET_MOVES_SQL = MARKET_SQL + """, lagged AS (SELECT *, lag(date) OVER w AS previous_date, lag(p) OVER w AS pp, lag(discount_percent_analysis) OVER w AS pd, lag(monthly_sold_value_num) OVER w AS pm, lag(history_sold_value_num) OVER w AS ph, lag(rating_num) OVER w AS pr, lag(rating_count_num) OVER w AS pc, lag(liked_count_num) OVER w AS pl, lag(is_sold_out_bool) OVER w AS ps, lag(has_structured_voucher) OVER w AS pv
FROM snapshots WINDOW w AS (PARTITION BY item_id ORDER BY date)),
moved AS (SELECT product_listing_key, country_code, shop_id, item_id, previous_date, date, CAST(date - previous_date AS INT) AS days_since_previous, date - previous_date = 1 AS transition_metric_eligible, CASE WHEN date - previous_date = 1 THEN round(p - pp, 4) END AS price_change, CASE WHEN date - previous_date = 1 THEN round(100 * (p - pp) / nullif(pp, 0), 4) END AS price_change_percent,
CASE WHEN date - previous_date = 1 THEN discount_percent_analysis - pd END AS discount_point_change, CASE WHEN date - previous_date = 1 THEN monthly_sold_value_num - pm END AS monthly_sold_delta, CASE WHEN date - previous_date = 1 THEN history_sold_value_num - ph END AS history_sold_delta_raw, coalesce(date - previous_date = 1 AND history_sold_value_num < ph, false) AS history_sold_decrease_flag,
CASE WHEN date - previous_date = 1 AND history_sold_value_num >= ph THEN history_sold_value_num - ph END AS snapshot_sales_delta_clean, CASE WHEN date - previous_date = 1 THEN rating_num - pr END AS rating_change, CASE WHEN date - previous_date = 1 THEN rating_count_num - pc END AS new_rating_count, CASE WHEN date - previous_date = 1 THEN liked_count_num - pl END AS like_delta, pv AS previous_has_structured_voucher, has_structured_voucher,
CASE WHEN date - previous_date <> 1 THEN 'not_comparable_snapshot_gap' WHEN NOT ps AND is_sold_out_bool THEN 'newly_sold_out' WHEN ps AND NOT is_sold_out_bool THEN 'restocked' WHEN ps THEN 'still_sold_out' ELSE 'available' END AS stock_status, 'events' AS source_file, item_id + 1 AS source_row FROM lagged WHERE previous_date IS NOT NULL)
"""


def market_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snapshots(spark, sf_dir).withColumns({"source_file": F.lit("events"), "source_row": F.col("item_id") + 1})
    return rounded(panel.transition_metrics(rows, ["country_code", "shop_id", "item_id"]), "price_change", "price_change_percent")


@query(MARKET_MOVES_SQL + "SELECT * FROM moved")
def transition_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market_moves(spark, sf_dir).select(*panel.TRANSITION)


@query(MARKET_MOVES_SQL + "SELECT product_listing_key, date, monthly_sold_delta, snapshot_sales_delta_clean FROM moved WHERE transition_metric_eligible AND country_code = 'vn'")
def materialised_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comparison whose deltas the data already holds is passed through."""
    rows = market_moves(spark, sf_dir).where("transition_metric_eligible and country_code = 'vn'")
    return panel.passed_through(rows, ["product_listing_key", "date"], ["monthly_sold_delta", "snapshot_sales_delta_clean"])


@query(MARKET_MOVES_SQL + "SELECT product_listing_key, max(date) FILTER (snapshot_sales_delta_clean > 0) AS last_sale_date FROM moved GROUP BY 1")
def last_sale_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart.last_sale_day(market_moves(spark, sf_dir), "product_listing_key", "snapshot_sales_delta_clean", "date")


@query(MARKET_SQL + "SELECT code, count(*) AS n FROM (SELECT 'PRICE_SENTINEL' AS code FROM products WHERE price_num = 999999999 UNION ALL SELECT 'MISSING_DISCOUNT_INCONSISTENT_PRICE' FROM usable WHERE discount_percent_num IS NULL AND p <> o) GROUP BY 1")
def snapshot_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.value_counts(panel.snapshot_issues(products(spark, sf_dir), "product_listing_key"), "code")


@query(MARKET_SQL + "SELECT country_code, shop_id, item_id, date FROM products WHERE date <= DATE '2024-01-10'")
def as_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.as_of(products(spark, sf_dir), "date", datetime.date(2024, 1, 10)).select("country_code", "shop_id", "item_id", "date")


GROUP_METRICS = ["discounted_listing_count", "discounted_listing_rate", "median_monthly_sold", "median_estimated_recent_revenue", "product_count", "shop_count", "observed_day_count", "brand_count", "category_count", "descriptive_gap_vs_baseline", "voucher_rate", "median_discount_ratio", "descriptive_gap_median_sold"]


@query(MARKET_SQL + """SELECT country_code, count(DISTINCT CASE WHEN has_displayed_discount THEN product_listing_key END) AS discounted_listing_count, round(100.0 * count(DISTINCT CASE WHEN has_displayed_discount THEN product_listing_key END) / count(DISTINCT product_listing_key), 4) AS discounted_listing_rate, CAST(median(monthly_sold_value_num) AS DOUBLE) AS median_monthly_sold, round(median(estimated_recent_revenue), 4) AS median_estimated_recent_revenue,
count(DISTINCT product_listing_key) AS product_count, count(DISTINCT shop_id) AS shop_count, count(DISTINCT date) AS observed_day_count, count(DISTINCT brand) AS brand_count, count(DISTINCT catid_num) AS category_count, round(median(estimated_recent_revenue) FILTER (has_structured_voucher) - median(estimated_recent_revenue) FILTER (NOT has_structured_voucher), 4) AS descriptive_gap_vs_baseline,
round(avg(CAST(has_structured_voucher AS INT)), 4) AS voucher_rate, round(median(voucher_discount_num / price_num) FILTER (has_structured_voucher AND p > 0), 6) AS median_discount_ratio, CAST(median(monthly_sold_value_num) FILTER (has_structured_voucher) - median(monthly_sold_value_num) FILTER (NOT has_structured_voucher) AS DOUBLE) AS descriptive_gap_median_sold FROM snapshots GROUP BY 1""")
def metrics_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.derived(snapshots(spark, sf_dir), ["has_promo"])
    out = metrics.grouped(rows, ["country_code"], GROUP_METRICS)
    return rounded(rounded(out, "discounted_listing_rate", "median_estimated_recent_revenue", "descriptive_gap_vs_baseline", "voucher_rate"), "median_discount_ratio", places=6).withColumns({c: F.col(c).cast("double") for c in ("median_monthly_sold", "descriptive_gap_median_sold")})


@query(MARKET_SQL + "SELECT product_listing_key, date, round(p * monthly_sold_value_num, 4) AS estimated_recent_revenue, voucher_discount_num IS NOT NULL AND voucher_discount_num > 0 AS has_structured_voucher, vouchers_count_num > 0 AS has_voucher_label, CASE WHEN discount_percent_num = 50 THEN '(40,100]' END AS discount_bucket FROM snapshots")
def metrics_of_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["estimated_recent_revenue", "has_structured_voucher", "has_voucher_label", "discount_bucket"]
    return rounded(metrics.derived(products(spark, sf_dir), names).select("product_listing_key", "date", *names), "estimated_recent_revenue")


@query(MARKET_MOVES_SQL + "SELECT product_listing_key, date, snapshot_sales_delta_clean AS history_sold_delta_clean, price_change_percent AS price_change_pct, new_rating_count AS rating_count_delta, like_delta AS liked_delta, CASE WHEN transition_metric_eligible THEN previous_has_structured_voucher || '->' || has_structured_voucher END AS voucher_state_transition FROM moved")
def metrics_of_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["history_sold_delta_clean", "price_change_pct", "rating_count_delta", "liked_delta", "voucher_state_transition"]
    return metrics.derived(market_moves(spark, sf_dir), names).select("product_listing_key", "date", *names)


# --- steps, evidence and cards ---------------------------------------------------------------------


def steps(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Listings of a market as the step that asked for them."""
    counts = products(spark, sf_dir).groupBy(F.col("country_code").alias("step")).agg(F.count_distinct("item_id").cast("double").alias("value"))
    return counts.where(F.col("step").isin(*names)).select("step", "value", F.lit("listings").alias("unit"), F.lit(None).cast("string").alias("rule"))


STEPS_SQL = MARKET_SQL + ", c AS (SELECT country_code AS step, CAST(count(DISTINCT item_id) AS DOUBLE) AS value FROM products GROUP BY 1)"


@query(STEPS_SQL + " SELECT step, value, 'listings' AS unit, NULL AS rule FROM c ORDER BY value DESC, step LIMIT 1")
def best_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.best_step(steps(spark, sf_dir, "vn", "id"))


@query(STEPS_SQL + " SELECT arg_max(step, (value, step)) AS high_step, max(value) AS high, arg_min(step, (value, step)) AS low_step, min(value) AS low, max(value) - min(value) AS difference, CASE WHEN max(value) = min(value) THEN 'equal' ELSE 'higher' END AS relation FROM c")
def compare_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.compare_steps(steps(spark, sf_dir, "vn", "id"))


@query(STEPS_SQL + " SELECT step, value, 'listings' AS unit, NULL AS rule FROM c UNION ALL SELECT 'xx', NULL, 'listings', 'A-SNAPSHOT-SCOPE'")
def list_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = spark.createDataFrame([("xx", None, "listings", "A-SNAPSHOT-SCOPE")], "step string, value double, unit string, rule string")
    return r.list_steps(steps(spark, sf_dir, "vn", "id").union(lost))


@query("SELECT 'unique:o_custkey' AS condition, count(*) AS n FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'range:o_totalprice:0:100000', count(*) FROM orders WHERE NOT o_totalprice BETWEEN 0 AND 100000")
def evidence_postconditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.broken(table(spark, sf_dir, "orders"), ["unique:o_orderkey", "unique:o_custkey", "nonnegative:o_totalprice", "range:o_totalprice:0:100000"])


@query("SELECT l_orderkey, l_linenumber, v, unit FROM (SELECT l_orderkey, l_linenumber, l_quantity * 2.5 AS v, CASE l_linenumber % 3 WHEN 0 THEN 'percent' WHEN 1 THEN 'count' ELSE 'other' END AS unit FROM lineitem) WHERE (unit = 'percent' AND (v < 0 OR v > 100)) OR (unit = 'count' AND (v < 0 OR v <> floor(v)))")
def evidence_off_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_linenumber") % 3 == 0, "percent").when(F.col("l_linenumber") % 3 == 1, "count").otherwise("other")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2.5).alias("v"), kind.alias("unit"))
    return evidence.off_unit(rows, "v", "unit")


@query("SELECT 's' || p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN 0.0 ELSE 100.0 * p_size / p_retailprice END AS value, 100.0 * p_size / p_retailprice AS expected FROM part WHERE p_partkey % 10 = 0 AND p_size > 0")
def evidence_off_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    none = F.lit(None).cast("string")
    numbers = [part.select(F.concat(F.lit(p), key).alias("id"), F.col(c).cast("double").alias("value"), none.alias("top"), none.alias("bottom"), F.lit(None).cast("double").alias("scale")) for p, c in (("t", "p_size"), ("b", "p_retailprice"))]
    wrong = F.when(key % 10 == 0, 0.0).otherwise(100.0 * F.col("p_size") / F.col("p_retailprice"))
    shares = part.select(F.concat(F.lit("s"), key).alias("id"), wrong.alias("value"), F.concat(F.lit("t"), key).alias("top"), F.concat(F.lit("b"), key).alias("bottom"), F.lit(100.0).alias("scale"))
    return evidence.off_share(numbers[0].union(numbers[1]).union(shares), "id", ("top", "bottom"), "scale")


@query("SELECT 'd' || s_suppkey AS id, s_acctbal AS value, round(s_acctbal - s_nationkey, 2) AS expected FROM supplier WHERE s_nationkey > 0")
def evidence_off_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    none = F.lit(None).cast("string")
    ends = [rows.select(F.concat(F.lit(p), key).alias("id"), F.col(c).cast("double").alias("value"), none.alias("start"), none.alias("end")) for p, c in (("a", "s_nationkey"), ("b", "s_acctbal"))]
    deltas = rows.select(F.concat(F.lit("d"), key).alias("id"), F.col("s_acctbal").alias("value"), F.concat(F.lit("a"), key).alias("start"), F.concat(F.lit("b"), key).alias("end"))
    return rounded(evidence.off_delta(ends[0].union(ends[1]).union(deltas), "id", "start", "end"), "expected", places=2)


@query(MARKET_SQL + "SELECT CAST(x AS DATE) AS date FROM generate_series(DATE '2024-01-01', DATE '2024-02-02', INTERVAL 1 DAY) t(x) WHERE CAST(x AS DATE) NOT IN (SELECT date FROM products)")
def evidence_dates_not_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.sql("select explode(sequence(date'2024-01-01', date'2024-02-02')) as date")
    return evidence.not_covered(products(spark, sf_dir), "date", wanted)


def full_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_listings(spark, sf_dir).withColumn("segment", mart.segment())
    return rows.withColumns({"shop_id": F.col("listing") % 10, "price_sentinel_excluded": F.col("listing") % 13 == 12, "transition_missing": F.col("sold_delta").isNull(), "formula_version": F.lit(mart.FORMULA)})


@query(SEGMENT_SQL + """, w AS (SELECT g.market, g.listing, segment, CAST(g.listing % 13 = 12 AS INT) + CAST(q.sold_delta IS NULL AS INT) AS bad FROM g JOIN q ON g.listing = q.listing), cs AS (SELECT market, segment, count(*) AS n FROM w GROUP BY 1, 2)
SELECT t.market, listings, shops, warnings, segments FROM (SELECT market, count(*) AS listings, count(DISTINCT listing % 10) AS shops, CAST(sum(bad) AS BIGINT) AS warnings FROM w GROUP BY 1) t JOIN (SELECT market, '{' || string_agg('"' || segment || '":' || n, ',' ORDER BY segment) || '}' AS segments FROM cs GROUP BY 1) s ON t.market = s.market""")
def mart_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart.overview(full_scorecard(spark, sf_dir), "market")


@query("SELECT 'v1' AS dataset_version, 'pam-1' AS formula_version, '2024-01-31' AS as_of_date, count(DISTINCT user_id) AS rows, 'ok' AS status FROM events")
def mart_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart.health(full_scorecard(spark, sf_dir), "v1", "2024-01-31")


@query("SELECT 'UNIQUE_KEY_VIOLATION' AS code, 'market' AS detail, count(*) AS n FROM (SELECT user_id % 2 FROM events GROUP BY 1 HAVING count(DISTINCT user_id) > 1)")
def mart_scorecard_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart.invalid_scorecard(full_scorecard(spark, sf_dir), ["market"])


@query(MARKET_MOVES_SQL + """, a AS (SELECT *, DATE '2024-01-25' AS d FROM snapshots WHERE date <= DATE '2024-01-25'), s AS (SELECT product_listing_key, any_value(country_code) AS country_code, any_value(catid_num) AS catid_num, arg_max(monthly_sold_value_num, date) AS monthly_sold, arg_max(estimated_recent_revenue, date) FILTER (estimated_recent_revenue IS NOT NULL) AS rev, arg_max(price_sentinel_flag, date) AS bad FROM a GROUP BY 1),
t AS (SELECT product_listing_key, arg_max(snapshot_sales_delta_clean, date) FILTER (snapshot_sales_delta_clean IS NOT NULL) AS sold_delta, max(date) FILTER (snapshot_sales_delta_clean > 0) AS last_sale_date, max(date) AS date_transition FROM moved WHERE transition_metric_eligible AND date <= DATE '2024-01-25' GROUP BY 1)
SELECT s.product_listing_key, country_code, catid_num, monthly_sold, sold_delta, sold_delta IS NULL AS transition_missing, bad AS price_sentinel_excluded, round(CASE WHEN NOT bad THEN rev END, 4) AS revenue, CAST(coalesce(DATE '2024-01-25' - last_sale_date, 31) AS INT) AS days_since_activity, date_transition FROM s LEFT JOIN t ON s.product_listing_key = t.product_listing_key""")
def mart_latest_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = datetime.date(2024, 1, 25)
    rows = mart.latest_listings(snapshots(spark, sf_dir), market_moves(spark, sf_dir), "product_listing_key", day)
    names = ["product_listing_key", "country_code", "catid_num", "monthly_sold", "sold_delta", "transition_missing", "price_sentinel_excluded", "revenue", "days_since_activity", "date_transition"]
    return rounded(rows.select(*names), "revenue")


# --- ingest ----------------------------------------------------------------------------------------


@query(MARKET_SQL + """SELECT code, count(*) AS n FROM (SELECT 'ORPHAN_PRODUCT_SHOP' AS code FROM products WHERE shop_id >= 7 GROUP BY country_code, shop_id UNION ALL SELECT 'ORPHAN_CATEGORY_MAPPING_PRODUCT' FROM products WHERE item_id % 4 = 0 GROUP BY item_id
UNION ALL SELECT 'ORPHAN_CATEGORY_MAPPING_SHELF' FROM products WHERE item_id % 5 = 0 GROUP BY country_code, shop_id, item_id % 5 UNION ALL SELECT 'ORPHAN_PLATFORM_CATEGORY' FROM products WHERE catid_num > 4 GROUP BY country_code, catid_num) GROUP BY 1""")
def reference_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = products(spark, sf_dir)
    mapping = rows.select("country_code", "shop_id", "item_id", (F.col("item_id") % 5).alias("category_id")).distinct()
    tables = {
        "products": rows.where("item_id % 4 <> 0").unionByName(rows.where("item_id % 4 = 0").withColumn("item_id", -F.col("item_id") - 1)), "shop_info": shop_info(spark, sf_dir).where("shop_id < 7"), "product_categories": mapping,
        "category_list": mapping.where("category_id <> 0").select("country_code", "shop_id", "category_id").distinct(), "category_platform": category_platform(spark, sf_dir).where("category_id_num <= 4").withColumnRenamed("category_id_num", "catid_num"),
    }
    return r.value_counts(quality.reference_issues(tables), "code")


@query("SELECT * FROM (VALUES ('all_null_column', 'nothing'), ('constant_column', 'one'), ('missing_date_in_range', 'date')) t(code, \"column\")")
def publish_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = products(spark, sf_dir).where("date <> '2024-01-15'").select("item_id", F.col("date").cast("string").alias("date"), "price_num", F.lit(1).alias("one"), F.lit(None).cast("string").alias("nothing"))
    return quality.publish_issues(rows, "products_clean")


@query("""WITH v AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '12.5' WHEN 1 THEN 'n/a' WHEN 2 THEN '' ELSE ' 7 ' END AS num, CASE event_id % 4 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'maybe' WHEN 2 THEN '0' END AS flag, CASE event_id % 4 WHEN 0 THEN '[1,2]' WHEN 1 THEN '{bad' WHEN 2 THEN '[]' END AS arr, CASE event_id % 4 WHEN 0 THEN '2024-01-05' WHEN 1 THEN '2024-13-05' WHEN 2 THEN ' ' END AS day FROM events)
SELECT 'warning' AS severity, code, 'events' AS dataset, count(*) AS n FROM v, (VALUES ('INVALID_NUMBER'), ('INVALID_BOOLEAN'), ('INVALID_JSON_ARRAY'), ('INVALID_DATE')) t(code) WHERE event_id % 4 = 1 GROUP BY code""")
def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4

    def pick(*values):
        return F.when(k == 0, values[0]).when(k == 1, values[1]).when(k == 2, values[2]).otherwise(values[3])

    raw = table(spark, sf_dir, "events").select("event_id", pick("12.5", "n/a", "", " 7 ").alias("num"), pick("TRUE", "maybe", "0", None).alias("flag"), pick("[1,2]", "{bad", "[]", None).alias("arr"), pick("2024-01-05", "2024-13-05", " ", None).alias("day"))
    return mart.issue_counts(quality.typed(raw, "events", "event_id", ["num"], ["flag"], ["arr"], ["day"])[1])


@query("SELECT o_orderkey, o_custkey, count(*) OVER w > 1 AS repeated, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) > 1 AS repeats_earlier FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderstatus)")
def repeat_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repeat_flags(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], "o_orderkey").select("o_orderkey", "o_custkey", "repeated", "repeats_earlier")


def export(spark: SparkSession, sf_dir: str) -> adapter.Export:
    """The marketplace as a database export: products on their last day, prices by day."""
    rows = products(spark, sf_dir)
    last = r.latest(rows, ["item_id"], "date", ["shop_id"])
    keys = ["country_code", "shop_id", "item_id", "date"]
    brands = rows.where("brand is not null").select("country_code", (F.col("item_id") % 6).alias("brand_id"), "brand").distinct()
    static = last.select(*keys, "product_name", (F.col("item_id") % 6).alias("brand_id"), F.col("catid_num").alias("shopee_category_id"), F.lit("2024-01-01 00:00:10").alias("ctime"), F.col("rating_num").alias("rating"), F.col("monthly_sold_value_num").alias("monthly_sold"))
    stats = shop_stats(spark, sf_dir)
    shops = shop_info(spark, sf_dir).withColumn("shop_created_at", F.lit("2020-02-03 04:05:06"))
    return adapter.Export(static, rows.select(*keys, F.col("price_num").alias("price")), shops, stats, product_categories(spark, sf_dir).withColumnRenamed("k", "category_id"), product_categories(spark, sf_dir).select("item_id", F.col("k").alias("category_id"), F.lit("slug").alias("category_slug")), adapter.brand_names(brands), category_platform(spark, sf_dir))


@query(MARKET_SQL + """, l AS (SELECT item_id, max(date) AS d FROM products GROUP BY 1) SELECT country_code, products.shop_id, item_id, date, price_num AS price, product_name, coalesce(brand, '') AS brand, CASE WHEN date = l.d THEN CAST(monthly_sold_value_num AS VARCHAR) ELSE '' END AS monthly_sold_value, CAST(date = l.d AS VARCHAR) AS attributes_observed, '1704067210' AS ctime, s_name AS shop_name
FROM products JOIN l USING (item_id) JOIN supplier ON s_suppkey = products.shop_id""")
def export_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.adapted(export(spark, sf_dir))["products"].select("country_code", "shop_id", "item_id", "date", "price", "product_name", "brand", "monthly_sold_value", "attributes_observed", "ctime", "shop_name")


@query(MARKET_SQL + """, s AS (SELECT country_code, shop_id, date, count(*) AS items FROM products GROUP BY ALL) SELECT s.country_code, s.shop_id, date, items, shop_name, '2020-02-03T04:05:06+00:00' AS created_at FROM s JOIN shop_info i ON s.shop_id = i.shop_id WHERE date = (SELECT max(date) FROM s)""")
def export_shop_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.shop_snapshot(export(spark, sf_dir)).select("country_code", "shop_id", "date", "items", "shop_name", "created_at")


@query(MARKET_SQL + ", s AS (SELECT country_code, shop_id, date, count(*) AS items FROM products GROUP BY ALL) SELECT s.country_code, s.shop_id, date, items, shop_name, is_official_shop FROM s JOIN shop_info i ON s.shop_id = i.shop_id")
def export_shop_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.shop_daily(export(spark, sf_dir)).select("country_code", "shop_id", "date", "items", "shop_name", "is_official_shop")


@query(MARKET_SQL + "SELECT count(DISTINCT item_id) FILTER (brand IS NOT NULL) AS mapped, count(DISTINCT item_id) FILTER (item_id % 6 = 5) AS unmapped, count(DISTINCT item_id) FILTER (item_id % 6 = 0 AND brand IS NULL) + count(DISTINCT item_id) FILTER (item_id % 6 = 0) AS without_id FROM products")
def export_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.brand_report(adapter.adapted(export(spark, sf_dir))["products"])


# --- functions -------------------------------------------------------------------------------------


@query("""SELECT p_partkey, trim(regexp_replace(replace(replace(p_name, 'hot', ' '), 'new', ' '), '\\s+', ' ', 'g')) AS plain, CASE WHEN contains(p_name, 'hot') THEN 'sale,hot,new' ELSE 'sale,new' END AS removed, CAST(p_partkey AS VARCHAR) AS leaf, strftime(DATE '2024-01-01' + CAST(p_partkey % 30 AS INT), '%Y-%m-%d') AS day, 1704067200 - 25200 + p_partkey AS seconds, CASE WHEN p_partkey % 2 = 0 THEN '1,2' ELSE '2,1' END AS seen, p_partkey % 3 = 0 AS flag, p_partkey % 5 = 0 AS nines,
'{"k":' || p_partkey || ',"b":"' || p_brand || '"}' AS json FROM part""")
def more_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    title = text.lower_plain(F.concat(F.lit("[SALE] "), "p_name", F.lit(" NEW")))
    stamp = F.date_format(F.timestamp_seconds(1704067200 + key), "yyyy-MM-dd HH:mm:ss")
    twice = F.when(key % 2 == 0, F.array(F.lit(1), F.lit(2), F.lit(1))).otherwise(F.array(F.lit(2), F.lit(2), F.lit(1)))
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.without_phrases(title).alias("plain"), F.array_join(text.removed_phrases(title), ",").alias("removed"), text.leaf_of(F.concat(F.lit("dim.part."), key)).alias("leaf"),
        text.iso(F.date_add(F.lit("2024-01-01").cast("date"), (key % 30).cast("int"))).alias("day"), text.epoch(stamp, "Asia/Bangkok").alias("seconds"), F.array_join(F.array_distinct(twice), ",").alias("seen"),
        text.truthy(F.when(key % 3 == 0, "True").otherwise("no")).alias("flag"), text.all_nines(F.when(key % 5 == 0, 99999999).otherwise(99999998), 7).alias("nines"), F.to_json(F.struct(key.alias("k"), F.col("p_brand").alias("b"))).alias("json"),
    )


@query("""WITH s AS (SELECT q.vec_id AS a, i.vec_id AS b, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])) AS t, q.label = i.label AS same, q.vec_id % 3 = i.vec_id % 3 AS deep FROM embeddings q JOIN embeddings i ON i.vec_id = q.vec_id + 1)
SELECT a, round(t, 6) AS text_sim, round((CAST(same AS INT) + CAST(deep AS INT)) / 2.0, 6) AS category_overlap_depth, CASE WHEN a % 4 IN (2, 3) THEN 0.5 ELSE 0.0 END AS brand_match, round(1 - least(1.0, 1.0 / (a + 1)), 6) AS price_distance, CAST(a // 10 = (a + 1) // 10 AS DOUBLE) AS same_shelf_bonus FROM s""")
def pair_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("vec_id")
    item = F.struct(F.col("embedding").alias("vector"), F.when(key % 4 != 3, key % 2).alias("brand"), (key + 1).cast("double").alias("price"), F.array(F.concat(F.lit("l"), "label"), F.concat(F.lit("m"), key % 3)).alias("path"), F.floor(key / 10).alias("shop"), F.array(F.lit("s")).alias("shelves"))
    rows = table(spark, sf_dir, "embeddings").select(key, item.alias("x"))
    pairs = rows.select(key.alias("k"), F.col("x").alias("a")).join(rows.select((key - 1).alias("k"), F.col("x").alias("b")), "k")
    return tools.similarity_parts(pairs).select(F.col("k").alias("a"), "text_sim", "category_overlap_depth", "brand_match", "price_distance", "same_shelf_bonus")


@query("""WITH s AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS listings, avg(CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END) AS rate, median(l_discount / l_quantity) AS depth, median(l_extendedprice) FILTER (l_discount >= 0.05) - median(l_extendedprice) FILTER (NOT l_discount >= 0.05) AS gap FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 5)
SELECT l_suppkey, round(0.4 * (rate - min(rate) OVER ()) / (max(rate) OVER () - min(rate) OVER ()) + 0.3 * (depth - min(depth) OVER ()) / (max(depth) OVER () - min(depth) OVER ()) + 0.3 * (gap - min(gap) OVER ()) / (max(gap) OVER () - min(gap) OVER ()), 4) AS profile_score FROM s WHERE gap IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 1""")
def best_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("voucher", F.col("l_discount") >= 0.05)
    return tools.best_profile(tools.voucher_profile(rows, "l_suppkey", "l_partkey", "voucher", "l_discount", "l_quantity", "l_extendedprice"), "l_suppkey").select("l_suppkey", "profile_score")


@query(MARKET_SQL + "SELECT DISTINCT n_nationkey AS nation FROM nation WHERE n_nationkey < 20 UNION SELECT s_nationkey FROM supplier")
def set_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("nation"))
    return nations.union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()
