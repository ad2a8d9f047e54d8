"""The reference operators as queries over the driver's tables, each with the SQL that states the same.

The listing panel of the reference has its analogue in `events` (a user a day) and in `lineitem` with its
relations: supplier for shop, nation and region for market and category, part for listing and brand.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import numbers, text
from quern.operators import evidence, mart, order, panel, quality, tools
from quern.operators import relational as r
from quern.plans.model import Measure, Pack, Relation, Request, answer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function under its name, with the SQL that gives the same rows."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: str | Column) -> Column:
    """Exact sums: two decimals, whatever the order of the rows."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def day(c: str) -> Column:
    return F.to_date(c)


# --- plans over the sales pack ---------------------------------------------------------------------


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by the first day of their month."""
    return table(spark, sf_dir, "lineitem").withColumn("month", F.to_date(F.date_trunc("month", "l_shipdate")))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"))


SALES = Pack(
    base="sales",
    tables={"sales": sales, "places": places, "part": lambda spark, sf_dir: table(spark, sf_dir, "part")},
    relations=(
        Relation("places", {"l_suppkey": "s_suppkey"}, {"r_name": "market", "n_name": "nation", "s_name": "shop"}),
        Relation("part", {"l_partkey": "p_partkey"}, {"p_brand": "brand", "p_type": "kind"}),
    ),
    dimensions={"market": "market", "nation": "nation", "shop": "shop", "brand": "brand", "kind": "kind", "month": "month", "flag": "l_returnflag", "quantity": "l_quantity"},
    entities={"order": "l_orderkey", "listing": "l_partkey", "shop": "l_suppkey"},
    measures={"price": Measure("l_extendedprice", "snapshot_stock", monetary=True), "quantity": Measure("l_quantity", "additive"), "discount": Measure("l_discount", "ratio")},
    snapshot="month",
    currency="market",
)
SALES_SQL = """WITH sales AS (SELECT l.*, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, r_name AS market, n_name AS nation, s_name AS shop, p_brand AS brand, p_type AS kind
FROM lineitem l LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON l_partkey = p_partkey)
"""


@query(SALES_SQL + "SELECT market, median(l_extendedprice) AS median_price, count(DISTINCT l_orderkey) AS orders FROM sales WHERE month = DATE '1998-03-01' GROUP BY market")
def plan_market_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = {"snapshot": datetime.date(1998, 3, 1), "by": ("market",)}
    asked = Request("price", "median", also=(("order", "count"),), **where)
    return answer(SALES, asked, spark=spark, sf_dir=sf_dir).withColumnsRenamed({"value": "median_price", "count_order": "orders"})


@query(SALES_SQL + "SELECT shop, CAST(sum(l_quantity) AS DOUBLE) AS value FROM sales WHERE market = 'ASIA' AND l_quantity >= 10 AND brand IN ('Brand#1', 'Brand#2') AND contains(shop, '00') GROUP BY shop")
def plan_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = (("market", "eq", "ASIA"), ("quantity", "gte", 10.0), ("brand", "in", ["Brand#1", "Brand#2"]), ("shop", "contains", "00"))
    return answer(SALES, Request("quantity", "sum", ("shop",), where), spark=spark, sf_dir=sf_dir)


@query(SALES_SQL + """, v AS (SELECT brand, count(DISTINCT l_orderkey) AS value FROM sales WHERE flag_ok GROUP BY brand),
n AS (SELECT *, row_number() OVER (ORDER BY value DESC, brand) AS position, lead(value) OVER (ORDER BY value DESC, brand) AS nx, lag(value) OVER (ORDER BY value DESC, brand) AS bf FROM v)
SELECT brand, value, CAST(position AS INT) AS position, (coalesce(position = 7 AND value = nx, false) OR coalesce(position = 3 AND value = bf, false)) AS tie_at_cut FROM n WHERE position BETWEEN 3 AND 7""".replace("flag_ok", "l_returnflag <> 'N'"))  # fmt: skip
def plan_rank_with_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer(SALES, Request("order", "count", ("brand",), (("flag", "ne", "N"),), limit=5, offset=2), spark=spark, sf_dir=sf_dir)


@query(SALES_SQL + "SELECT kind, round(avg(l_discount), 6) AS value FROM sales GROUP BY kind")
def plan_mean_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer(SALES, Request("discount", "mean", ("kind",)), spark=spark, sf_dir=sf_dir).withColumn("value", F.round("value", 6))


@query(SALES_SQL + "SELECT market, max(l_extendedprice) AS value FROM sales WHERE month = (SELECT max(month) FROM sales) GROUP BY market")
def plan_latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer(SALES, Request("price", "max", ("market",), snapshot="latest"), spark=spark, sf_dir=sf_dir)


# --- joins, sets and aggregates --------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, c_name AS customer, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def relation_join_n_to_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return r.relation_join(orders, table(spark, sf_dir, "customer"), {"o_custkey": "c_custkey"}, {"c_name": "customer", "c_mktsegment": "segment"})


@query("""SELECT e.user_id, e.date, e.n, f.errors FROM (SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1, 2) e
LEFT JOIN (SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1, 2) f ON e.user_id = f.user_id AND e.date = f.date""")
def relation_join_date_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("date", day("ts"))
    whole = events.groupBy("user_id", "date").agg(F.count(F.lit(1)).alias("n"))
    errors = events.where("event_type = 'error'").groupBy("user_id", "date").agg(F.count(F.lit(1)).alias("errors"))
    return r.relation_join(whole, errors, {"user_id": "user_id"}, {"errors": "errors"}, ("date", "date"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return r.orphans(customers, table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


@query("""SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#3') GROUP BY l_returnflag""")
def filter_then_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    producer = table(spark, sf_dir, "part").where("p_brand = 'Brand#3'").select(F.col("p_partkey").alias("l_partkey"))
    found = r.filter_then_measure(producer, table(spark, sf_dir, "lineitem"), "l_partkey")
    return found.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum(money("l_extendedprice")).cast("double").alias("total"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS date FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1""")
def dedupe_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r.latest(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", ["o_orderkey"])
    return rows.select("o_custkey", "o_orderkey", "o_totalprice", day("o_orderdate").alias("date"))


@query("""SELECT user_id, arg_max(value, ts) FILTER (event_type = 'purchase') AS last_purchase, arg_max(value, ts) FILTER (event_type = 'error') AS last_error FROM events GROUP BY user_id""")
def last_known_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    split = events.select("user_id", "ts", *(F.when(F.col("event_type") == t, F.col("value")).alias(f"last_{t}") for t in ("purchase", "error")))
    return r.last_known(split, ["user_id"], "ts", ["last_purchase", "last_error"])


@query("""SELECT p_brand, count(DISTINCT CASE WHEN l_discount >= 0.05 THEN l_partkey END) AS numerator, count(DISTINCT l_partkey) AS denominator,
round(100.0 * CAST(count(DISTINCT CASE WHEN l_discount >= 0.05 THEN l_partkey END) AS DOUBLE) / nullif(count(DISTINCT l_partkey), 0), 6) AS rate
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""")
def declared_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return r.declared_share(rows, ["p_brand"], F.col("l_discount") >= 0.05, "l_partkey", 100.0)


@query("""SELECT event_type, CAST(max(CASE WHEN d = DATE '2024-01-02' THEN n END) AS BIGINT) AS value_start, CAST(max(CASE WHEN d = DATE '2024-01-29' THEN n END) AS BIGINT) AS value_end,
CAST(max(CASE WHEN d = DATE '2024-01-29' THEN n END) - max(CASE WHEN d = DATE '2024-01-02' THEN n END) AS BIGINT) AS difference
FROM (SELECT event_type, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2) WHERE d IN (DATE '2024-01-02', DATE '2024-01-29') GROUP BY event_type""")
def temporal_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "events").groupBy("event_type", day("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    date = datetime.date
    return r.compare_dates(daily, ["event_type"], "n", "d", date(2024, 1, 2), date(2024, 1, 29))


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-11' GROUP BY event_type")
def window_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = table(spark, sf_dir, "events").where(day("ts").between("2024-01-05", "2024-01-11"))
    return inside.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.value_counts(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query("SELECT s_nationkey, s_suppkey, s_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS n FROM supplier) WHERE n = 1")
def argmax_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.best_row(table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_acctbal", ["s_suppkey"]).select("s_nationkey", "s_suppkey", "s_acctbal")


@query("SELECT * FROM (SELECT 'customer' AS kind, n_nationkey AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 2 UNION ALL SELECT 'supplier', n_nationkey, count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 2)")
def union_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    def counted(kind: str, key: str) -> DataFrame:
        return table(spark, sf_dir, kind).groupBy(F.lit(kind).alias("kind"), F.col(key).alias("nation")).agg(F.count(F.lit(1)).alias("n"))

    return r.union_scope([counted("customer", "c_nationkey"), counted("supplier", "s_nationkey")])


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 520")
def group_size_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.large_groups(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_partkey", 520)


@query("SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("nation"))
    return customers.intersect(table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("custkey")).exceptAll(orders.where("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = {"n": F.count(F.lit(1)), "quantity": F.sum(money("l_quantity")).cast("double")}
    return r.fold_levels(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], measures)


@query("SELECT c_mktsegment, CAST(c_nationkey % 3 AS INT) AS zone, count(*) AS n, CAST(grouping(c_mktsegment, CAST(c_nationkey % 3 AS INT)) AS BIGINT) AS level FROM customer GROUP BY CUBE (c_mktsegment, CAST(c_nationkey % 3 AS INT))")
def cube_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = table(spark, sf_dir, "customer").withColumn("zone", (F.col("c_nationkey") % 3).cast("int"))
    return r.fold_levels(zones, ["c_mktsegment", "zone"], {"n": F.count(F.lit(1))}, cube=True)


@query("SELECT event_type, round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.999), 4) AS p999, quantile_disc(value, 0.95) AS nearest_95, round(median(value), 4) AS median FROM events GROUP BY event_type")
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    linear = order.quantiles(events, ["event_type"], "value", {"p90": 0.9, "p999": 0.999, "median": 0.5}).withColumns({c: F.round(c, 4) for c in ("p90", "p999", "median")})
    return linear.join(order.quantiles(events, ["event_type"], "value", {"nearest_95": 0.95}, nearest=True), "event_type")


# --- windows over the panel ------------------------------------------------------------------------

PANEL_SQL = """WITH panel AS (SELECT CAST(user_id % 2 AS BIGINT) AS market, CAST(user_id % 7 AS BIGINT) AS category, user_id AS listing, CAST(ts AS DATE) AS date,
CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS price, CAST(count(*) FILTER (event_type = 'view') AS BIGINT) AS views, CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS likes, CAST(max(event_id) % 100000 AS BIGINT) AS sold,
bool_or(event_type = 'error') AS sold_out, bool_or(event_type = 'purchase') AS has_voucher FROM events GROUP BY user_id, CAST(ts AS DATE))
"""


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per user and day, as a listing's snapshot."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("listing"), day("ts").alias("date")).agg(
        F.sum(money("value")).cast("double").alias("price"), F.count_if(kind == "view").alias("views"), F.count_if(kind == "click").alias("likes"), (F.max("event_id") % 100000).alias("sold"),
        F.bool_or(kind == "error").alias("sold_out"), F.bool_or(kind == "purchase").alias("has_voucher"),
    ).withColumns({"market": F.col("listing") % 2, "category": F.col("listing") % 7})


TRANSITION_SQL = PANEL_SQL + """, lagged AS (SELECT *, lag(date) OVER w AS previous_date, lag(price) OVER w AS p_price, lag(views) OVER w AS p_views, lag(sold) OVER w AS p_sold, lag(likes) OVER w AS p_likes, lag(sold_out) OVER w AS p_out
FROM panel WINDOW w AS (PARTITION BY listing ORDER BY date)),
moves AS (SELECT listing, market, category, previous_date, date, CAST(date - previous_date AS INT) AS days, date - previous_date = 1 AS eligible, has_voucher,
CASE WHEN date - previous_date = 1 THEN round(price - p_price, 4) END AS price_change, CASE WHEN date - previous_date = 1 THEN round(100 * (price - p_price) / nullif(p_price, 0), 4) END AS price_change_percent,
CASE WHEN date - previous_date = 1 THEN sold - p_sold END AS sold_delta_raw, coalesce(date - previous_date = 1 AND sold < p_sold, false) AS sold_fell, CASE WHEN date - previous_date = 1 AND sold >= p_sold THEN sold - p_sold END AS sold_delta,
CASE WHEN date - previous_date = 1 THEN likes - p_likes END AS likes_change,
CASE WHEN date - previous_date <> 1 THEN 'not_comparable_snapshot_gap' WHEN NOT p_out AND sold_out THEN 'newly_sold_out' WHEN p_out AND NOT sold_out THEN 'restocked' WHEN p_out THEN 'still_sold_out' ELSE 'available' END AS stock_status
FROM lagged WHERE previous_date IS NOT NULL)
"""
MOVES = ["listing", "previous_date", "date", "days", "eligible", "price_change", "price_change_percent", "sold_delta_raw", "sold_fell", "sold_delta", "likes_change", "stock_status"]


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions of the daily panel under the short names used here."""
    views = F.col("views").cast("double")
    rows = daily_panel(spark, sf_dir).withColumns({"price_num": F.col("price"), "discount_percent_analysis": views, "monthly_sold_value_num": views, "history_sold_value_num": F.col("sold"), "rating_num": views, "rating_count_num": views, "liked_count_num": F.col("likes"), "is_sold_out_bool": F.col("sold_out"), "has_structured_voucher": F.col("has_voucher")})
    out = panel.transition_metrics(rows, ["listing"])
    names = {"days_since_previous": "days", "transition_metric_eligible": "eligible", "history_sold_delta_raw": "sold_delta_raw", "history_sold_decrease_flag": "sold_fell", "snapshot_sales_delta_clean": "sold_delta", "like_delta": "likes_change"}
    return out.withColumnsRenamed(names).withColumns({c: F.round(c, 4) for c in ("price_change", "price_change_percent")})


@query(TRANSITION_SQL + "SELECT " + ", ".join(MOVES) + " FROM moves")
def transition_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moves(spark, sf_dir).select(*MOVES)


@query(PANEL_SQL + """, s AS (SELECT listing, min(date) AS low, max(date) AS high FROM panel GROUP BY listing), d AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM panel), (SELECT max(date) FROM panel), INTERVAL 1 DAY)) AS DATE) AS date)
SELECT listing, date, CASE WHEN date BETWEEN low AND high THEN 'internal' ELSE 'edge' END AS kind FROM s, d WHERE NOT EXISTS (SELECT 1 FROM panel p WHERE p.listing = s.listing AND p.date = d.date)""")
def snapshot_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.gaps(daily_panel(spark, sf_dir), ["listing"])


@query(PANEL_SQL + ", n AS (SELECT count(DISTINCT listing) AS listings, count(DISTINCT date) AS dates, count(*) AS observed FROM panel) SELECT *, listings * dates AS cells, listings * dates - observed AS missing FROM n")
def panel_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.balance(daily_panel(spark, sf_dir), ["listing"])


@query(PANEL_SQL + """, b AS (SELECT listing FROM panel GROUP BY 1 HAVING count(DISTINCT date) = (SELECT count(DISTINCT date) FROM panel)), n AS (SELECT round((SELECT count(*) FROM b) / CAST(count(DISTINCT listing) AS DOUBLE), 6) AS share FROM panel)
SELECT listing, date, min(price) AS price, CASE WHEN date < DATE '2024-01-13' THEN 'before' WHEN date > DATE '2024-01-17' THEN 'after' ELSE 'during' END AS phase, any_value(share) AS selection_share FROM panel, n WHERE listing IN (SELECT listing FROM b) GROUP BY listing, date""")
def price_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.price_panel(daily_panel(spark, sf_dir), ["listing"], "2024-01-15")


@query(TRANSITION_SQL + """, i AS (SELECT *, coalesce(lead(previous_date) OVER (PARTITION BY listing ORDER BY date) = date, true) AS joins FROM moves WHERE eligible AND previous_date >= DATE '2024-01-10' AND date <= DATE '2024-01-14')
SELECT listing, CAST(sum(sold_delta) AS BIGINT) AS delta, count(sold_delta) AS observed FROM i GROUP BY listing HAVING bool_and(joins) AND min(previous_date) = DATE '2024-01-10' AND max(date) = DATE '2024-01-14'""")
def sales_decline(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = datetime.date
    return panel.window_delta(moves(spark, sf_dir).withColumn("delta", F.col("sold_delta")), ["listing"], date(2024, 1, 10), date(2024, 1, 14))


@query("""WITH n AS (SELECT c_custkey, c_mktsegment, c_acctbal, rank() OVER (PARTITION BY c_mktsegment ORDER BY round(c_acctbal, -2)) + (count(*) OVER (PARTITION BY c_mktsegment, round(c_acctbal, -2)) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT c_custkey, round(CASE WHEN n = 1 THEN 0.5 ELSE (rk - 1) / (n - 1) END, 6) AS percentile, CAST(least(5, floor(round(CASE WHEN n = 1 THEN 0.5 ELSE (rk - 1) / (n - 1) END, 6) * 5) + 1) AS INT) AS quintile FROM n""")
def average_rank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").withColumn("v", F.round("c_acctbal", -2))
    out = order.rank_percentiles(customers, ["c_mktsegment"], "v", "p").select("c_custkey", F.round("p", 6).alias("percentile"))
    return out.withColumn("quintile", numbers.quintile(F.col("percentile")))


@query("SELECT s_suppkey, round(CASE WHEN max(s_acctbal) OVER w = min(s_acctbal) OVER w THEN 1.0 ELSE (s_acctbal - min(s_acctbal) OVER w) / (max(s_acctbal) OVER w - min(s_acctbal) OVER w) END, 6) AS scaled FROM supplier WINDOW w AS (PARTITION BY s_nationkey)")
def min_max_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.scaled(table(spark, sf_dir, "supplier"), ["s_nationkey"], {"x": "s_acctbal"}).select("s_suppkey", F.round("x", 6).alias("scaled"))


@query("SELECT p_brand, p_partkey, p_retailprice, CAST(position AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS position FROM part) WHERE position <= 3")
def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("p_retailprice").desc(), F.col("p_partkey").asc()]
    return r.top_per_group(table(spark, sf_dir, "part"), ["p_brand"], order, 3).select("p_brand", "p_partkey", "p_retailprice", "position")


@query("""SELECT o_orderkey, CAST(ntile(4) OVER w AS INT) AS quarter, CAST(dense_rank() OVER w AS INT) AS place, round(cume_dist() OVER w, 6) AS share,
CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = w.rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.ntile(4).over(w).alias("quarter"), F.dense_rank().over(w).alias("place"), F.round(F.cume_dist().over(w), 6).alias("share"), F.sum(money("o_totalprice")).over(rows).cast("double").alias("running")
    )


# --- derived columns, quality and density ----------------------------------------------------------

@query("""SELECT severity, code, dataset, count(*) AS n FROM (
SELECT 'warning' AS severity, 'INVALID_NUMBER' AS code, 'events' AS dataset FROM events WHERE try_cast(event_type || event_id AS DOUBLE) IS NULL
UNION ALL SELECT 'error', 'DUPLICATE_KEY', 'events' FROM (SELECT user_id, ts::DATE FROM events GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'warning', 'ORPHAN_CUSTOMER', 'customer' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) GROUP BY ALL""")
def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", day("ts").alias("date"), F.concat("event_type", F.col("event_id").cast("string")).alias("amount"))
    _, bad = quality.typed(events, "events", "user_id", numbers=["amount"])
    repeated = quality.key_issues(events, "events", ["user_id", "date"])
    lost = quality.orphan_issues(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], "ORPHAN_CUSTOMER", "customer")
    return mart.issue_counts(bad.union(repeated).union(lost))


@query("""SELECT 'signup' AS "column", event_date, count(*) FILTER (event_type = 'signup') AS observed, count(*) AS rows, round(CAST(count(*) FILTER (event_type = 'signup') AS DOUBLE) / count(*), 6) AS coverage FROM (SELECT *, CAST(ts AS DATE) AS event_date FROM events) GROUP BY event_date
UNION ALL SELECT 'value', event_date, count(value), count(*), round(CAST(count(value) AS DOUBLE) / count(*), 6) FROM (SELECT *, CAST(ts AS DATE) AS event_date FROM events) GROUP BY event_date""")
def observation_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(day("ts").alias("event_date"), "value", F.when(F.col("event_type") == "signup", F.col("value")).alias("signup"))
    return r.coverage(events, ["signup", "value"], "event_date")


@query("""SELECT 'value' AS "column", count(value) AS observed, count(DISTINCT value) AS distinct_values, 'ok' AS verdict FROM events UNION ALL SELECT 'one', count(*), 1, 'constant' FROM events UNION ALL SELECT 'none', 0, 0, 'all_null'""")
def degenerate_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("value", F.lit(1).alias("one"), F.lit(None).cast("string").alias("none"))
    return quality.degenerate(events, ["value", "one", "none"])


@query("SELECT p_brand, round(avg(CASE WHEN p_size = m THEN 1.0 ELSE 0.0 END), 6) AS share, avg(CASE WHEN p_size = m THEN 1.0 ELSE 0.0 END) >= 0.2 AS capped FROM (SELECT *, max(p_size) OVER (PARTITION BY p_brand) AS m FROM part) GROUP BY p_brand")
def capped_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.capped(table(spark, sf_dir, "part"), "p_size", "p_brand")


@query("""SELECT p_partkey, kind FROM (SELECT p_partkey, CASE WHEN p_partkey % 50 = 1 THEN 'removed' WHEN p_partkey % 50 = 2 THEN 'added' WHEN p_partkey % 50 IN (3, 4) THEN 'changed' END AS kind FROM part) WHERE kind IS NOT NULL""")
def rebuild_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 50
    old = part.where(k != 2)
    new = part.where(k != 1).withColumns({"p_retailprice": F.when(k == 3, F.col("p_retailprice") * 1.01).otherwise(F.col("p_retailprice") * (1 + 1e-9)), "p_brand": F.when(k == 4, F.lit("other")).otherwise(F.col("p_brand"))})
    return quality.rebuilt_differences(old, new, ["p_partkey"], ["p_retailprice"], ["p_brand"])


# --- tools, mart and entities ----------------------------------------------------------------------


@query("SELECT min(CAST(ts AS DATE)) AS first_date, max(CAST(ts AS DATE)) AS last_date, count(DISTINCT CAST(ts AS DATE)) AS n_dates FROM events")
def dataset_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.dataset_coverage(table(spark, sf_dir, "events").select(day("ts").alias("date")), "date")


@query(PANEL_SQL + "SELECT has_voucher, count(DISTINCT listing) AS listings, round(avg(views), 6) AS mean, CAST(median(views) AS DOUBLE) AS median, count(*) FILTER (views IS NULL) AS excluded FROM (SELECT has_voucher, listing, nullif(views, 0) AS views FROM panel WHERE date = (SELECT max(date) FROM panel)) GROUP BY has_voucher")
def promotion_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = tools.at_latest(daily_panel(spark, sf_dir), "date").withColumn("views", F.nullif("views", F.lit(0)))
    return tools.promotion_observation(last, "has_voucher", "views", "listing").withColumns({"mean": F.round("mean", 6), "median": F.col("median").cast("double")})


@query("SELECT n_regionkey AS market, count(DISTINCT CASE WHEN c_acctbal < -900 THEN c_custkey END) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_regionkey")
def flagged_by_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "market")
    customers = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return tools.flagged_by_market(customers, nation, "market", F.col("c_acctbal") < -900, "c_custkey")


@query("SELECT count(*) AS n, round(median(l_extendedprice), 4) AS median FROM lineitem WHERE l_discount * 100 BETWEEN 2.5 AND 5.5")
def discount_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("percent", F.col("l_discount") * 100)
    return tools.around(rows, "percent", 4, 1.5, "l_extendedprice").withColumn("median", F.round("median", 4))


@query("""WITH s AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS listings, avg(CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END) AS rate, median(l_discount / l_quantity) AS depth, median(l_extendedprice) FILTER (l_discount >= 0.05) - median(l_extendedprice) FILTER (NOT l_discount >= 0.05) AS gap FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 5)
SELECT l_suppkey, listings, round(rate, 6) AS rate, round(depth, 6) AS depth, round(gap, 4) AS gap, round(0.4 * (rate - min(rate) OVER ()) / (max(rate) OVER () - min(rate) OVER ()) + 0.3 * (depth - min(depth) OVER ()) / (max(depth) OVER () - min(depth) OVER ()) + 0.3 * (gap - min(gap) OVER ()) / (max(gap) OVER () - min(gap) OVER ()), 4) AS profile_score FROM s WHERE gap IS NOT NULL""")
def voucher_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("voucher", F.col("l_discount") >= 0.05)
    return tools.voucher_profile(rows, "l_suppkey", "l_partkey", "voucher", "l_discount", "l_quantity", "l_extendedprice")


@query(TRANSITION_SQL + """, up AS (SELECT * FROM moves WHERE date = DATE '2024-01-20' AND sold_delta > 0), e AS (SELECT market, quantile_cont(sold_delta, 0.9) AS p90, max(sold_delta) AS top FROM up GROUP BY market), t AS (SELECT up.market, count(*) AS tied_at_top FROM up JOIN e ON up.market = e.market AND sold_delta = top GROUP BY 1)
SELECT n.market, listing, sold_delta, CAST(position AS INT) AS position, CASE WHEN sold_delta >= p90 THEN 'high' ELSE 'medium' END AS priority, tied_at_top FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY sold_delta DESC, listing) AS position FROM up) n JOIN e ON n.market = e.market JOIN t ON n.market = t.market WHERE position <= 5""")
def top_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart.top_movers(moves(spark, sf_dir).where("date = '2024-01-20'"), "market", "listing", "sold_delta")


@query(TRANSITION_SQL + "SELECT listing, date, price_change_percent, sold_delta FROM moves WHERE eligible AND price_change_percent <= -10 AND sold_delta > 0 AND listing NOT IN (SELECT listing FROM panel WHERE price > 1000) ORDER BY price_change_percent, listing LIMIT 5")
def price_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    dear = daily_panel(spark, sf_dir).where("price > 1000").select("listing")
    return mart.price_moves(moves(spark, sf_dir), "listing", dear).select("listing", "date", "price_change_percent", "sold_delta")


@query(PANEL_SQL + """, f AS (SELECT has_voucher, views FROM panel WHERE market = 0 AND date = (SELECT max(date) FROM panel)), g AS (SELECT count(*) FILTER (has_voucher) AS n_with, count(*) FILTER (NOT has_voucher) AS n_without, median(views) FILTER (has_voucher) AS median_with, median(views) FILTER (NOT has_voucher) AS median_without FROM f)
SELECT n_with, n_without, CAST(median_with AS DOUBLE) AS median_with, CAST(median_without AS DOUBLE) AS median_without, CASE WHEN n_with >= 10 AND n_without >= 10 THEN CAST(median_with - median_without AS DOUBLE) END AS gap FROM g""")
def voucher_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart.voucher_gap(tools.at_latest(daily_panel(spark, sf_dir), "date").where("market = 0"), "has_voucher", "views")


def _percentiles(column: str, descending: bool = False) -> str:
    sign = "-" if descending else ""

    def one(group: str) -> str:
        return f"(rank() OVER (PARTITION BY {group}, {column} IS NULL ORDER BY {sign}{column}) + (count(*) OVER (PARTITION BY {group}, {column}) - 1) / 2.0 - 1) / nullif(count({column}) OVER (PARTITION BY {group}), 1) ".replace("nullif(count", "nullif(-1 + count").replace(", 1)", ", 0)")

    return f"CASE WHEN {column} IS NULL THEN NULL WHEN fallback THEN coalesce({one('market')}, 0.5) ELSE coalesce({one('market, category')}, 0.5) END"


SCORE_SQL = TRANSITION_SQL + f""", last AS (SELECT p.listing, p.market, CASE WHEN p.category < 2 THEN NULL ELSE p.category END AS category, arg_max(p.views, p.date) AS monthly_sold, arg_max(p.price, p.date) AS revenue, DATE '2024-01-31' - max(p.date) AS days_since_activity FROM panel p GROUP BY 1, 2, 3),
d AS (SELECT listing, arg_max(sold_delta, date) FILTER (sold_delta IS NOT NULL) AS sold_delta FROM moves GROUP BY 1),
c AS (SELECT last.*, d.sold_delta, (last.category IS NULL OR count(*) OVER (PARTITION BY last.market, last.category) < 12) AS fallback FROM last LEFT JOIN d ON last.listing = d.listing),
s AS (SELECT *, {_percentiles("days_since_activity", True)} AS activity, {_percentiles("monthly_sold")} AS sold_p, {_percentiles("sold_delta")} AS delta_p, {_percentiles("revenue")} AS value FROM c),
m AS (SELECT *, CASE WHEN delta_p IS NULL THEN sold_p ELSE 0.7 * sold_p + 0.3 * delta_p END AS momentum FROM s)
"""


def scored_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = daily_panel(spark, sf_dir).withColumn("category", F.when(F.col("category") >= 2, F.col("category")))
    last = rows.groupBy("listing", "market", "category").agg(F.max_by("views", "date").alias("monthly_sold"), F.max_by("price", "date").alias("revenue"), F.date_diff(F.lit("2024-01-31").cast("date"), F.max("date")).alias("days_since_activity"))
    deltas = r.last_known(moves(spark, sf_dir), ["listing"], "date", ["sold_delta"])
    return mart.scores(last.join(deltas, "listing", "left"), "listing", "market", "category", least=12)


@query(SCORE_SQL + """SELECT listing, market, fallback, round(activity, 4) AS activity, round(momentum, 4) AS momentum, round(value, 4) AS value, round(100 * (0.3 * activity + 0.4 * momentum + 0.3 * value), 2) AS score FROM m""")
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scored_listings(spark, sf_dir)
    return scored.select("listing", "market", "fallback", *(F.round(c, 4).alias(c) for c in ("activity", "momentum", "value")), F.round("score", 2).alias("score"))


SEGMENT_SQL = SCORE_SQL + """, q AS (SELECT *, least(5, floor(activity * 5) + 1) AS a5, least(5, floor(momentum * 5) + 1) AS m5, least(5, floor(value * 5) + 1) AS v5, activity + momentum + value AS total FROM m),
g AS (SELECT listing, market, CASE WHEN v5 IS NULL OR total IS NULL THEN 'InsufficientData' WHEN a5 IN (1, 2) AND (monthly_sold IS NULL OR monthly_sold = 0) THEN 'Dormant' WHEN coalesce(sold_delta < 0, false) OR m5 IN (1, 2) THEN 'Cooling'
WHEN a5 IN (4, 5) AND m5 IN (4, 5) AND v5 IN (4, 5) THEN 'Star' WHEN m5 IN (4, 5) AND v5 < 4 THEN 'Rising' ELSE 'Steady' END AS segment FROM q)
"""


@query(SEGMENT_SQL + "SELECT segment, count(*) AS n FROM g GROUP BY segment")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.value_counts(scored_listings(spark, sf_dir).withColumn("segment", mart.segment()), "segment")


@query(r"""WITH t AS (SELECT p_partkey, p_name, regexp_split_to_array(lower(p_name), ' ') AS w FROM part), x AS (SELECT DISTINCT p_partkey, unnest(w) AS token FROM t), n AS (SELECT count(*) AS n FROM part)
SELECT token, count(DISTINCT p_partkey) AS documents, round(count(DISTINCT p_partkey) / any_value(n), 6) AS share, round(count(DISTINCT p_partkey) / any_value(n), 6) <= 0.05 AS rare FROM x, n WHERE length(token) >= 3 GROUP BY token""")
def token_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.token_frequency(table(spark, sf_dir, "part"), "p_partkey", text.tokens(F.col("p_name")))


@query("""SELECT 'brand' AS ref, CAST(p_partkey % 2 AS BIGINT) AS market, lower(replace(p_brand, '#', ' ')) AS folded, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS originals, count(DISTINCT p_brand) > 1 AS ambiguous FROM part GROUP BY 1, 2, 3""")
def value_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("market", F.col("p_partkey") % 2)
    return tools.value_index(part, "brand", "market", "p_brand", text.fold(F.col("p_brand"))).withColumn("originals", F.array_join("originals", ","))


@query("""WITH q AS (SELECT vec_id AS query, embedding AS qe FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query, vec_id, round(list_cosine_similarity(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS similarity FROM q, embeddings WHERE query <> vec_id),
n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS position FROM s) SELECT query, vec_id, similarity, CAST(position AS INT) AS position FROM n WHERE position <= 5""")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return tools.nearest(vectors, vectors.where("vec_id % 100 = 0"), "vec_id", "embedding", 5)


@query("""WITH s AS (SELECT q.vec_id AS query, i.vec_id, CAST(1 + CASE WHEN q.vec_id % 3 = i.vec_id % 3 THEN 1 ELSE 0 END AS INT) AS depth, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])), 6) AS similarity
FROM embeddings q JOIN embeddings i ON q.label = i.label AND q.vec_id <> i.vec_id WHERE q.vec_id % 100 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY depth DESC, similarity DESC, vec_id) AS position FROM s)
SELECT query, vec_id, depth, similarity, CAST(position AS INT) AS position FROM n WHERE position <= 5""")
def similar_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.array(F.col("label"), F.col("vec_id") % 3).alias("path"))
    return tools.similar_items(items, items.where("vec_id % 100 = 0"), "vec_id", "path", "embedding")


MENTIONS = [(0, "small ring", 0), (1, "blue nothing", 1), (2, "absent words", 2), (3, "7", 3), (4, "", 4), (5, "cold widget small", 5)]


@query("""WITH m(mention, text, v) AS (VALUES (0, 'small ring', 0), (1, 'blue nothing', 1), (2, 'absent words', 2), (3, '7', 3), (4, '', 4), (5, 'cold widget small', 5)), p AS (SELECT p_partkey, string_split(p_name, ' ') AS w, embedding AS e FROM part JOIN embeddings ON vec_id = p_partkey % 50),
f AS (SELECT token FROM (SELECT DISTINCT p_partkey, unnest(w) AS token FROM p) GROUP BY token HAVING count(*) > 0.05 * (SELECT count(*) FROM p)), fl AS (SELECT list(token) AS common FROM f),
x AS (SELECT m.mention, p_partkey, list_distinct(string_split(m.text, ' ')) AS mw, list_distinct(p.w) AS pw, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) AS c FROM m JOIN embeddings ON vec_id = v, p WHERE regexp_matches(m.text, '[a-z]')),
s AS (SELECT mention, p_partkey, round(len(list_intersect(mw, pw)) / CAST(len(list_distinct(list_concat(mw, pw))) AS DOUBLE), 6) AS lex, round(greatest(c, 0), 6) AS dense, list_filter(mw, lambda t: NOT list_contains(common, t)) AS rare, pw FROM x, fl WHERE list_has_any(mw, pw)),
k AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY lex DESC, p_partkey) AS a, row_number() OVER (PARTITION BY mention ORDER BY dense DESC, p_partkey) AS b, len(rare) > 0 AND list_has_all(pw, rare) AS r FROM s),
z AS (SELECT *, row_number() OVER (PARTITION BY mention, r ORDER BY p_partkey) AS c FROM k), w AS (SELECT mention, p_partkey, round(0.45 * lex + 0.55 * dense, 6) AS score FROM z WHERE a <= 20 OR b <= 20 OR (r AND c <= 20) UNION ALL SELECT 3, p_partkey, 1.0 FROM part WHERE p_partkey = 7),
n AS (SELECT *, row_number() OVER o AS i, lead(score) OVER o AS nx FROM w WINDOW o AS (PARTITION BY mention ORDER BY score DESC, p_partkey))
SELECT CAST(m.mention AS INT) AS mention, p_partkey, CAST(score AS DOUBLE) AS score, CASE WHEN m.text = '' THEN 'not_found' WHEN score IS NULL OR score < 0.5 THEN 'invalid_extraction' WHEN nx IS NULL OR round(score - nx, 6) >= 0.05 THEN 'resolved' ELSE 'ambiguous_broad' END AS outcome FROM m LEFT JOIN n ON m.mention = n.mention AND i = 1""")
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), (F.col("p_partkey") % 50).alias("vec_id"))
    asked = spark.createDataFrame(MENTIONS, "mention int, text string, vec_id long")
    return tools.resolve_entities(asked.join(vectors, "vec_id"), parts.join(vectors, "vec_id"), "p_partkey")


@query("""SELECT o_orderkey, 'lines' AS metric FROM (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 9)""")
def evidence_outside_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return evidence.outside(lines, "n", 0, 9).select("o_orderkey", F.lit("lines").alias("metric"))


@query("SELECT substr(sha256('nation|n_nationkey=' || s_nationkey || '|suppliers'), 1, 16) AS evidence_id, 'suppliers' AS metric, CAST(count(*) AS DOUBLE) AS value, 'n_nationkey=' || s_nationkey AS locator FROM supplier GROUP BY s_nationkey")
def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    return evidence.evidence(counts, ["n_nationkey"], ["suppliers"], "nation")


@query("""SELECT window_start, event_type, n, value FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events GROUP BY 1, 2)""")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.streaming import windows

    events = windows.stamped(table(spark, sf_dir, "events"))
    out = windows.windowed(events, "6 hours", None, "1 hour", ["event_type"], {"n": F.count(F.lit(1)), "value": F.sum(money("value")).cast("double")})
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "value")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.streaming import windows

    out = windows.sessions(windows.stamped(table(spark, sf_dir, "events")), "6 hours", "1 hour", ["user_id"], {"n": F.count(F.lit(1))})
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


# --- scalar functions ------------------------------------------------------------------------------


@query("""SELECT p_partkey, lower(replace(p_brand, '#', ' ')) AS folded, 'part:' || p_partkey || ':' || p_size AS key, substr(sha256('part|' || p_name), 1, 16) AS id, p_name AS plain, contains(p_brand, '#1') AS marked FROM part""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    decorated = F.concat(F.lit(" [new]  "), F.replace("p_name", F.lit(" "), F.lit("   ")), F.lit(" (sale)"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.fold(F.col("p_brand")).alias("folded"), F.concat_ws(":", F.lit("part"), "p_partkey", "p_size").alias("key"), text.short_hash(F.lit("part"), F.col("p_name")).alias("id"),
        text.without_decoration(decorated).alias("plain"), text.contains(F.col("p_brand"), "#1").alias("marked"),
    )


@query("SELECT p_partkey, round(1 - levenshtein(p_name, 'small ring') / CAST(greatest(length(p_name), 10) AS DOUBLE), 6) AS similarity FROM part")
def string_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(text.similarity(F.col("p_name"), F.lit("small ring")), 6).alias("similarity"))


@query("""SELECT CASE WHEN d = 0 THEN '0' WHEN d > 0 AND d <= 2 THEN '(0,2]' WHEN d > 2 AND d <= 5 THEN '(2,5]' WHEN d > 5 AND d <= 10 THEN '(5,10]' END AS bucket, count(*) AS n FROM (SELECT round(l_discount * 100, 2) AS d FROM lineitem) GROUP BY 1""")
def value_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    percent = F.round(F.col("l_discount") * 100, 2)
    return r.value_counts(table(spark, sf_dir, "lineitem").select(numbers.bucket(percent, [0, 2, 5, 10]).alias("bucket")), "bucket")


@query("SELECT CAST(json_extract(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "events").select(F.from_json("props", "k int")["k"].alias("k"))
    return r.value_counts(parsed, "k")


@query("SELECT s_suppkey, s_acctbal FROM (SELECT *, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS position FROM supplier) WHERE position BETWEEN 6 AND 25")
def result_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, by = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), {"s_acctbal": True, "s_suppkey": False}
    last = mart.page(rows, by, 5).collect()[-1]
    return mart.page(rows, by, 20, (last["s_acctbal"], last["s_suppkey"]))


@query("SELECT p_partkey, p_brand, p_retailprice FROM part JOIN (SELECT p_brand AS b, quantile_cont(p_retailprice, 0.97) AS edge FROM part GROUP BY 1) ON p_brand = b WHERE p_retailprice > edge")
def review_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.review_candidates(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice"), ["p_brand"], "p_retailprice", 0.97)


@query("""SELECT 'signup' AS "column", count(*) FILTER (event_type = 'signup') AS observed, count(*) AS rows, round(CAST(count(*) FILTER (event_type = 'signup') AS DOUBLE) / count(*), 6) AS coverage, 'clarify' AS gate FROM events UNION ALL SELECT 'value', count(value), count(*), 1.0, 'answer' FROM events""")
def density_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("value", "user_id", F.when(F.col("event_type") == "signup", F.col("value")).alias("signup"))
    return quality.density_gate(r.coverage(events, ["signup", "value", "user_id"]), ["signup", "value"])


@query("SELECT user_id, event_id, event_type FROM events e WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events f WHERE f.user_id = e.user_id)")
def latest_snapshot_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.at_latest(table(spark, sf_dir, "events").withColumn("date", day("ts")), "date", "user_id").select("user_id", "event_id", "event_type")


@query("""SELECT l_orderkey, CAST(parts AS DOUBLE) AS parts, total FROM (SELECT coalesce(l_orderkey, o_orderkey) AS l_orderkey, parts, o_totalprice AS total FROM (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS parts FROM lineitem GROUP BY 1) FULL JOIN orders ON l_orderkey = o_orderkey) WHERE NOT coalesce(abs(parts - total) <= 0.9 * greatest(1, abs(total)), false)""")
def evidence_parts_and_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", money("l_extendedprice").alias("amount"))
    totals = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("amount"))
    off = evidence.parts_off_total(lines, totals, ["l_orderkey"], "amount", 0.9)
    return off.withColumn("parts", F.col("parts").cast("double"))


@query("SELECT s_nationkey, s_suppkey, s_acctbal, CAST(lead(s_suppkey) OVER w AS BIGINT) AS following, round(s_acctbal - lag(s_acctbal) OVER w, 2) AS step FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)")
def lead_and_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal", F.lead("s_suppkey").over(w).alias("following"), F.round(F.col("s_acctbal") - F.lag("s_acctbal").over(w), 2).alias("step"))


# The queries over the marketplace are registered with these.
from quern import market_queries  # noqa: E402, F401
