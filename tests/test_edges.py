"""Empty tables and nulls through the engine's operators."""

import pytest
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import evidence, mart, order, panel, quality, tools
from quern.operators import relational as r

SCHEMA = "listing long, market string, category string, date date, price double, sold long, views long, likes long, sold_out boolean, has_voucher boolean, discount double, rating double, name string"


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame([(None,) * 13, (None,) * 13, (1,) + (None,) * 12], SCHEMA)


def physical(df):
    """The table under the names of the cleaned columns."""
    empty = {c: F.lit(None).cast("double") for c in ("price_before_promo_num", "history_sold_value_num", "rating_num", "rating_count_num", "liked_count_num", "voucher_discount_num", "promotion_id_num")}
    return df.withColumns({"price_num": F.col("price"), "price_original_num": F.col("price"), "discount_percent_num": F.col("discount"), "monthly_sold_value_num": F.col("sold"), "is_sold_out_bool": F.col("sold_out"), **empty})


OPERATORS = {
    "latest": lambda df: r.latest(df, ["listing"], "date", ["price"]),
    "last_known": lambda df: r.last_known(df, ["listing"], "date", ["price", "name"]),
    "share": lambda df: r.declared_share(df, ["market"], F.col("has_voucher"), "listing"),
    "ranked": lambda df: r.ranked(df.select("listing", "price"), "price", 2, ["listing"]),
    "best_row": lambda df: r.best_row(df, ["market"], "price", ["listing"]),
    "coverage": lambda df: r.coverage(df, ["price", "name"], "market"),
    "rollup": lambda df: r.fold_levels(df, ["market"], {"n": F.count(F.lit(1))}),
    "transitions": lambda df: panel.transition_metrics(panel.snapshot_metrics(physical(df)), ["listing"]),
    "gap_flag": lambda df: panel.with_gap_flag(df, ["listing"]),
    "snapshot_issues": lambda df: panel.snapshot_issues(physical(df), "listing"),
    "gaps": lambda df: panel.gaps(df, ["listing"]),
    "balanced": lambda df: panel.balanced(df, ["listing"]),
    "balance": lambda df: panel.balance(df, ["listing"]),
    "price_panel": lambda df: panel.price_panel(df, ["listing"], "2024-01-01"),
    "degenerate": lambda df: quality.degenerate(df, ["price", "name"]),
    "capped": lambda df: quality.capped(df, "price"),
    "keys": lambda df: quality.key_issues(df, "t", ["listing"]),
    "orphans": lambda df: quality.orphan_issues(df, df, ["listing"], "ORPHAN", "t"),
    "voucher_gap": lambda df: mart.voucher_gap(df, "has_voucher", "price"),
    "top_movers": lambda df: mart.top_movers(df, "market", "listing", "sold"),
    "observation": lambda df: tools.promotion_observation(df, "has_voucher", "price", "listing"),
    "coverage_dates": lambda df: tools.dataset_coverage(df, "date"),
    "profile": lambda df: tools.voucher_profile(df, "market", "listing", "has_voucher", "discount", "price", "price"),
    "token_frequency": lambda df: tools.token_frequency(df, "listing", text.tokens(F.col("name"))),
    "value_index": lambda df: tools.value_index(df, "r", "market", "name", text.fold(F.col("name"))),
    "quantiles": lambda df: order.quantiles(df, ["market"], "price", {"p": 0.5}),
    "ranks": lambda df: order.rank_percentiles(df, [], "price", "p"),
    "scaled": lambda df: order.scaled(df, ["market"], {"x": "price"}),
    "cohorts": lambda df: mart.cohorts(df, "market", "category"),
    "scores": lambda df: mart.scores(df.select("listing", "market", "category", *(F.lit(None).cast("double").alias(c) for c in ("days_since_activity", "monthly_sold", "sold_delta", "revenue"))).where("listing is not null"), "listing", "market", "category"),
    "price_moves": lambda df: mart.price_moves(df.withColumns({"price_change_percent": F.col("price"), "sold_delta": F.col("sold"), "eligible": F.lit(True)}), "listing", df),
    "page": lambda df: mart.page(df, {"price": True, "listing": False}, 2, (5.0, 1)),
    "publish_issues": lambda df: quality.publish_issues(df.select("date"), "t"),
    "references": lambda df: quality.reference_issues({t: df.select(*(F.lit(None).cast("string").alias(c) for c in ("country_code", "shop_id", "item_id", "category_id", "catid_num"))) for t in ("products", "shop_info", "product_categories", "category_list", "category_platform")}),
    "repeats": lambda df: quality.repeat_flags(df.limit(1), ["listing"], "date"),
    "off_unit": lambda df: evidence.off_unit(df, "price", "name").limit(2),
    "off_share": lambda df: evidence.off_share(df.select(F.col("name").alias("id"), F.col("price").alias("value"), F.col("market").alias("top"), F.col("category").alias("bottom"), F.col("rating").alias("scale")), "id", ("top", "bottom"), "scale"),
    "similar": lambda df: tools.similar_items(df.select("listing", F.array("name").alias("path"), F.array("price").alias("v")), df.select("listing", F.array("name").alias("path"), F.array("price").alias("v")), "listing", "path", "v"),
    "nearest": lambda df: tools.nearest(df.select("listing", F.array("price").alias("v")), df.select("listing", F.array("price").alias("v")), "listing", "v", 2).limit(2),
    "resolve": lambda df: tools.resolve_entities(df.select(F.col("listing").alias("mention"), F.col("name").alias("text")), df.select("listing", "name"), "listing"),
    "candidates": lambda df: tools.review_candidates(df, ["market"], "price"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_and_null_rows_do_not_crash(none, nulls, name):
    assert OPERATORS[name](none).count() <= 2
    OPERATORS[name](nulls).collect()
