"""The insight mart: cohorts, percentile scores, segments, and the miners that turn them into findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.numbers import quintile
from quern.operators.order import join_equal, quantiles, rank_percentiles, running_counts
from quern.operators.relational import ContractError, best_of, last_known

COHORT_LEAST = 20
MOST_PAGE = 50
FORMULA = "pam-1"
#: Days of the window in which activity is looked for.
WINDOW_DAYS = 30
#: The columns that a scorecard has to have.
SCORECARD = ["listing", "market", "shop_id", "activity", "momentum", "value", "score", "segment", "price_sentinel_excluded", "transition_missing", "formula_version"]
WEIGHTS = {"activity": 0.3, "momentum": 0.4, "value": 0.3}


def cohorts(df: DataFrame, market: str, category: str, least: int = COHORT_LEAST) -> DataFrame:
    """Adds cohort_size and fallback: a category that is missing or has under `least` rows is scored by market.

    The cohort of a row with fallback is its whole market, not only the rows that fell back.
    """
    own = df.groupBy(market, category).agg(F.count(F.lit(1)).alias("__own"))
    all_of = df.groupBy(market).agg(F.count(F.lit(1)).alias("__market"))
    both = join_equal(join_equal(df, own, [market, category]), all_of, [market])
    fallback = F.col(category).isNull() | (F.col("__own") < least)
    return both.withColumn("fallback", fallback).withColumn("cohort_size", F.when(F.col("fallback"), F.col("__market")).otherwise(F.col("__own"))).drop("__own", "__market")


def scores(df: DataFrame, key: str, market: str, category: str, least: int = COHORT_LEAST) -> DataFrame:
    """Percentile scores from days_since_activity (fewer is better), monthly_sold, sold_delta and revenue; key is unique.

    Each is a percentile in (market, category), or among the whole market for rows with fallback. Momentum
    weighs sold .7 and delta .3, or sold alone where there is no delta; the score is null if any part is.
    """
    cut = cohorts(df, market, category, least)
    parts = {"activity": -F.col("days_since_activity"), "sold_p": F.col("monthly_sold"), "delta_p": F.col("sold_delta"), "value": F.col("revenue")}
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("part"), c.cast("double").alias("v")) for n, c in parts.items())))
    # Every row counts in its market; in its category only those count that are scored there.
    cohorts_of = F.array_compact(F.array(F.struct(F.lit("market").alias("level"), F.lit(None).cast("string").alias("c")), F.when(~F.col("fallback"), F.struct(F.lit("category").alias("level"), F.col(category).cast("string").alias("c")))))
    long = cut.select(key, F.col(market).alias("__m"), "fallback", F.explode(cohorts_of).alias("__cohort"), cells.alias("__cell"))
    long = long.select(key, "__m", "fallback", F.col("__cohort.level").alias("__level"), F.col("__cohort.c").alias("__c"), F.col("__cell.part").alias("__part"), F.col("__cell.v").alias("__v"))
    ranked = rank_percentiles(long, ["__m", "__level", "__c", "__part"], "__v", "__p").where(F.col("__level") == F.when(F.col("fallback"), "market").otherwise("category"))
    wide = ranked.groupBy(key).agg(*(F.max(F.when(F.col("__part") == n, F.col("__p"))).alias(n) for n in parts))
    made = cut.join(wide, key).withColumn("momentum", F.when(F.col("delta_p").isNull(), F.col("sold_p")).otherwise(0.7 * F.col("sold_p") + 0.3 * F.col("delta_p")))
    total = sum((w * F.col(n) for n, w in WEIGHTS.items()), F.lit(0.0))
    return made.withColumn("score", F.round(100 * total, 4)).drop("sold_p", "delta_p")


def latest_listings(snapshots: DataFrame, transitions: DataFrame, key: str, as_of, date: str = "date", window_days: int = WINDOW_DAYS) -> DataFrame:
    """A row per listing known at a day: each column's last value that is not null, with the last eligible transition's beside it.

    Adds days_since_activity (since the last positive clean delta, or window_days + 1 if there was none),
    price_sentinel_excluded, transition_missing, and revenue, which is void where the last price stands for
    none. Columns of transitions that are in snapshots too get the ending _transition.
    """
    known = snapshots.where(F.col(date) <= F.lit(as_of))
    last = last_known(known, [key], date, [c for c in known.columns if c != key])
    legs = transitions.where(F.col("transition_metric_eligible") & (F.col(date) <= F.lit(as_of)))
    leg = last_known(legs, [key], date, ["snapshot_sales_delta_clean", "price_change_percent", date])
    leg = leg.withColumnsRenamed({c: f"{c}_transition" for c in leg.columns if c != key and c in last.columns})
    out = last.join(leg, key, "left").join(last_sale_day(legs, key, "snapshot_sales_delta_clean", date), key, "left")
    days = F.date_diff(F.lit(as_of).cast("date"), F.col("last_sale_date"))
    return out.withColumns({
        "days_since_activity": F.coalesce(days, F.lit(window_days + 1)),
        "price_sentinel_excluded": F.coalesce("price_sentinel_flag", F.lit(False)),
        "transition_missing": F.col("snapshot_sales_delta_clean").isNull(),
        "monthly_sold": F.col("monthly_sold_value_num"),
        "sold_delta": F.col("snapshot_sales_delta_clean"),
        "revenue": F.when(~F.coalesce("price_sentinel_flag", F.lit(False)), F.col("estimated_recent_revenue")),
    })


def build_scorecard(snapshots: DataFrame, transitions: DataFrame, as_of, key: str = "product_listing_key", least: int = COHORT_LEAST) -> DataFrame:
    """The scorecard of all listings known at a day, with segment and formula version."""
    scored = scores(latest_listings(snapshots, transitions, key, as_of), key, "country_code", "catid_num", least)
    return scored.withColumns({"segment": segment(), "formula_version": F.lit(FORMULA), "as_of_date": F.lit(as_of).cast("date")})


def card(found: DataFrame, insight_id: str) -> DataFrame:
    return found.where(F.col("insight_id") == insight_id).limit(1)


def evidence_of(found: DataFrame, evidence: DataFrame, insight_id: str) -> DataFrame:
    """The evidence that a card names (evidence_ids); what is not there is left out."""
    ids = card(found, insight_id).select(F.explode("evidence_ids").alias("evidence_id"))
    return evidence.join(F.broadcast(ids), "evidence_id", "left_semi")


def segment() -> Column:
    """The first that fits of InsufficientData, Dormant, Cooling, Star, Rising, Steady.

    From the fifths (1 to 5) of activity, momentum and value, the latest monthly_sold and sold_delta, and
    score. What is missing fits no comparison; a missing value or score is insufficient.
    """
    a, m, v = (quintile(F.col(c)) for c in ("activity", "momentum", "value"))
    return (
        F.when(v.isNull() | F.col("score").isNull(), "InsufficientData")
        .when((a <= 2) & (F.coalesce(F.col("monthly_sold"), F.lit(0)) == 0), "Dormant")
        .when((F.col("sold_delta") < 0) | (m <= 2), "Cooling")
        .when((a >= 4) & (m >= 4) & (v >= 4), "Star")
        .when((m >= 4) & (v < 4), "Rising")
        .otherwise("Steady")
    )


def top_movers(df: DataFrame, market: str, key: str, delta: str, k: int = 5) -> DataFrame:
    """The k largest positive deltas of each market; high where at or above its 90th percentile, and ties at the top."""
    up = df.where(F.col(delta) > 0)
    counted = running_counts(up, [market], delta)
    tied = counted.groupBy(market).agg(F.max_by("n", delta).alias("tied_at_top"))
    edges = quantiles(up, [market], delta, {"p90": 0.9})
    best = best_of(up, [market], key, [F.col(delta).desc(), F.col(key).asc()], k)
    out = best.join(edges, market).join(tied, market)
    return out.select(market, key, delta, "position", F.when(F.col(delta) >= F.col("p90"), "high").otherwise("medium").alias("priority"), "tied_at_top")


def price_moves(df: DataFrame, key: str, without: DataFrame | None = None, most: float = -10, k: int = 5) -> DataFrame:
    """Prices that fell by 10 % or more from one day to the next while sales rose, the deepest first.

    without: the keys of listings whose price has stood for "no price"; none of their moves count.
    """
    found = df.where((F.col("price_change_percent") <= most) & (F.col("sold_delta") > 0) & F.col("eligible"))
    if without is not None:
        found = found.join(without.select(key).distinct(), key, "left_anti")
    return found.orderBy("price_change_percent", key).limit(k)


def voucher_gap(df: DataFrame, flag: str, value: str, least: int = 10) -> DataFrame:
    """Measured rows and medians with and without a voucher, and their gap; null unless each side has `least` rows.

    df is the scope: one market's snapshot, as vouchers are observed in one market only.
    """
    sides = df.where(F.col(value).isNotNull()).select(F.when(F.col(flag), "with").otherwise("without").alias("__side"), value)
    medians = quantiles(sides, ["__side"], value, {"median": 0.5}).join(sides.groupBy("__side").agg(F.count(F.lit(1)).alias("n")), "__side")
    both = {s: F.col("__side") == s for s in ("with", "without")}
    out = medians.agg(*(F.coalesce(F.max(F.when(c, F.col("n"))), F.lit(0)).alias(f"n_{s}") for s, c in both.items()), *(F.max(F.when(c, F.col("median"))).alias(f"median_{s}") for s, c in both.items()))
    return out.withColumn("gap", F.when((F.col("n_with") >= least) & (F.col("n_without") >= least), F.col("median_with") - F.col("median_without")))


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity", "code", "dataset").agg(F.count(F.lit(1)).alias("n"))


def card_order() -> list[Column]:
    """high, medium, low; then kind, market, category and id."""
    rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    return [rank, *(F.col(c).asc_nulls_last() for c in ("kind", "market", "category", "insight_id"))]


def cards(found: DataFrame, **only: str | None) -> DataFrame:
    """The cards of one market, kind, category or priority, each where it is given, in their order."""
    for column, value in only.items():
        if value is not None:
            found = found.where(F.col(column) == value)
    return found.orderBy(*card_order())


def page(df: DataFrame, order: dict[str, bool], size: int = 50, after: tuple | None = None) -> DataFrame:
    """A page of 1 to 50 rows after the row with the key `after`; order: column to whether it descends.

    The order's columns have to tell rows apart and hold no nulls. A page is found by its key, so a late
    page costs what the first one does.
    """
    if not 1 <= size <= MOST_PAGE:
        raise ContractError("PAGE_SIZE", str(size))
    if after is not None:
        beyond, same = F.lit(False), F.lit(True)
        for (c, down), value in zip(order.items(), after, strict=True):
            beyond = beyond | (same & ((F.col(c) < F.lit(value)) if down else (F.col(c) > F.lit(value))))
            same = same & (F.col(c) == F.lit(value))
        df = df.where(beyond)
    return df.orderBy(*(F.col(c).desc() if down else F.col(c).asc() for c, down in order.items())).limit(size)


def overview(scorecard: DataFrame, market: str) -> DataFrame:
    """Per market: listings, shops, quality warnings, and the listings of each segment as JSON in order of name."""
    warned = F.coalesce(F.col("price_sentinel_excluded").cast("int"), F.lit(0)) + F.coalesce(F.col("transition_missing").cast("int"), F.lit(0))
    totals = scorecard.groupBy(market).agg(F.count(F.lit(1)).alias("listings"), F.count_distinct("shop_id").alias("shops"), F.sum(warned).alias("warnings"))
    counts = scorecard.groupBy(market, "segment").agg(F.count(F.lit(1)).alias("n")).groupBy(market)
    segments = counts.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("segment", "n"))))).alias("segments"))
    return totals.join(segments, market)


def price_move_points(moves: DataFrame, key: str) -> DataFrame:
    """The points of the price move chart: x is the price's change in percent, y the sold proxy's."""
    return moves.select(F.col(key).alias("listing_key"), F.col("price_change_percent").alias("x"), F.col("sold_delta").alias("y"))


def health(scorecard: DataFrame, version: str, as_of: str) -> DataFrame:
    """One row: versions, the date, rows, and whether the scorecard keeps its contract."""
    out = scorecard.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("formula_version") != FORMULA).alias("__other"))
    status = F.when(F.col("__other") > 0, "stale_formula").when(F.col("rows") == 0, "empty").otherwise("ok")
    return out.select(F.lit(version).alias("dataset_version"), F.lit(FORMULA).alias("formula_version"), F.lit(as_of).alias("as_of_date"), "rows", status.alias("status"))


def invalid_scorecard(scorecard: DataFrame, keys: list[str]) -> DataFrame:
    """(code, detail, n) of what breaks the scorecard's contract: missing columns, repeated keys, other formula versions."""
    missing = sorted(set(SCORECARD) - set(scorecard.columns))
    if missing:
        return scorecard.sparkSession.createDataFrame([("SCHEMA_INVALID", ", ".join(missing), len(missing))], "code string, detail string, n long")
    twice = scorecard.groupBy(*keys).count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("UNIQUE_KEY_VIOLATION").alias("code"), F.lit(", ".join(keys)).alias("detail"), "n")
    other = scorecard.agg(F.count_if(~F.col("formula_version").eqNullSafe(F.lit(FORMULA))).alias("n")).select(F.lit("LINEAGE_INVALID").alias("code"), F.lit("formula_version").alias("detail"), "n")
    return twice.union(other).where("n > 0")


def last_sale_day(moves: DataFrame, key: str, delta: str, date: str) -> DataFrame:
    """The last date of each key on which its delta was positive; null if there was none."""
    return moves.groupBy(key).agg(F.max(F.when(F.col(delta) > 0, F.col(date))).alias("last_sale_date"))
