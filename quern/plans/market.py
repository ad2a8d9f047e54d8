"""The pack of a marketplace: listings by day with their shops, categories, shelves, sales metrics and shop statistics.

The pack declares what may be asked; the tables are given as functions by name, so that any source that has
the columns can stand behind it. The columns are those of the cleaned tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from quern.operators.panel import SENTINEL
from quern.plans.model import Dimension, Exclusion, Measure, Pack, Qualifier, Relation

#: The reviewed rule by which a price stands for none; repeated nines and a price without a companion are still open.
NO_PRICE = (Exclusion("price-sentinel", equals=(float(SENTINEL),)), Exclusion("price-nines", nines=7, approved=False))
SHOP_STATISTICS = ("rating", "followers", "items", "response_rate", "response_time", "cancellation_rate", "rating_good", "rating_normal", "rating_bad", "rating_total", "following")
EXACT = ("eq", "ne", "in", "contains")

DIMENSIONS = {
    "country": Dimension("country_code", filters=("eq", "in")),
    "date": Dimension("date", filters=("eq", "lt", "lte", "gt", "gte", "in")),
    "product_name": Dimension("product_name", filters=EXACT),
    "brand": Dimension("brand", filters=EXACT),
    "shop": Dimension("shop_id", label="shop_name", filters=("eq", "in")),
    "shop_name": Dimension("shop_name", filters=EXACT),
    "item_id": Dimension("item_id", groupable=False, filters=("eq", "in")),
    "platform_category_name": Dimension("display_category_name", filters=EXACT, family="platform"),
    "platform_category_has_children": Dimension("has_children", filters=("eq",), family="platform"),
    "shop_category_name": Dimension("shelf_name", filters=EXACT, family="shelf"),
    "shop_category_parent": Dimension("is_parent_category", filters=("eq",), family="shelf"),
    "shop_category_child": Dimension("is_sub_category", filters=("eq",), family="shelf"),
    "shop_official": Dimension("is_official_shop", filters=("eq",)),
    "shop_vacation": Dimension("vacation", filters=("eq",)),
    "display_variation": Dimension("tier_variation_name", filters=EXACT),
    "shopee_verified": Dimension("shopee_verified", filters=("eq",)),
}
ENTITIES = {"country": "country_code", "shop": "shop_id", "brand": "brand", "product_listing": "product_listing_key", "platform_category": "catid_num", "date_snapshot": "date"}
MEASURES = {
    **{n: Measure(f"{n}_num", "snapshot_stock", monetary=True, unit="local_currency", exclude=NO_PRICE) for n in ("price", "price_original", "price_before_promo")},
    "discount_percent": Measure("discount_percent_num", "snapshot_stock", unit="percent"),
    "monthly_sold": Measure("monthly_sold_value_num", "proxy_window", unit="units_recent_window", proxy=True),
    "history_sold": Measure("history_sold_value_num", "proxy_window", unit="units_cumulative", proxy=True),
    "rating": Measure("rating_num", "ordinal", unit="rating_point"),
    "shop_rating": Measure("rating_star", "ordinal", unit="rating_point"),
    **{n: Measure(f"{n}_num", "additive", unit="count") for n in ("rating_count", "liked_count", "images_count", "variation_options_count", "vouchers_count")},
    **{n: Measure(f"{n}_num", "undeclared", monetary=True, unit="local_currency") for n in ("voucher_discount", "voucher_min_spend")},
    **{n: Measure(f"{n}_num", "undeclared", unit="timestamp") for n in ("voucher_start_time", "voucher_end_time")},
    "shop_followers": Measure("follower_count", "undeclared", unit="count"),
    "shop_items": Measure("item_count", "undeclared", unit="listings_declared"),
    "shop_response_rate": Measure("response_rate", "undeclared", unit="percent"),
    "shop_response_time": Measure("response_time", "undeclared", unit="seconds"),
    "shop_cancellation_rate": Measure("cancellation_rate", "undeclared", unit="percent"),
    **{f"shop_{n}": Measure(n, "undeclared", unit="count") for n in ("rating_good", "rating_normal", "rating_bad")},
    "shop_category_total": Measure("shelf_total", "undeclared", unit="listings"),
    **{f"shop_daily_{n}": Measure(f"daily_{n}", "undeclared", unit="count") for n in SHOP_STATISTICS},
    "estimated_recent_revenue": Measure("estimated_recent_revenue", "snapshot_stock", monetary=True, unit="local_currency", proxy=True),
    "displayed_discount": Measure("has_displayed_discount", "ratio", unit="share"),
}
QUALIFIERS = {
    "shop_official": Qualifier("is_official_shop"),
    "shop_vacation": Qualifier("vacation"),
    "has_structured_voucher": Qualifier("has_structured_voucher"),
    "has_voucher_label": Qualifier("vouchers_count_num", "gte", 1, "lte", 0),
    "shopee_verified": Qualifier("shopee_verified"),
}


def relations() -> tuple[Relation, ...]:
    """The declared edges; the two taxonomies (the platform's categories and a shop's shelves) are never joined to each other."""
    listing = {c: c for c in ("country_code", "shop_id", "item_id")}
    shop = {"country_code": "country_code", "shop_id": "shop_id"}
    shop_columns = ("shop_name", "is_official_shop", "vacation", "rating_star", "follower_count", "item_count", "response_rate", "response_time", "cancellation_rate", "rating_good", "rating_normal", "rating_bad")
    return (
        Relation("shop_info", shop, {c: c for c in shop_columns}, name="belongs_to"),
        Relation("category_platform", {"country_code": "country_code", "catid_num": "category_id_num"}, {c: c for c in ("display_category_name", "has_children")}, family="platform", name="in_platform_category"),
        Relation("product_categories", listing, {"display_name": "shelf_name", "total": "shelf_total", "is_parent_category": "is_parent_category", "is_sub_category": "is_sub_category"}, ("date", "date"), many=True, family="shelf", name="in_shop_category"),
        Relation("snapshot_metrics", listing, {c: c for c in ("estimated_recent_revenue", "has_displayed_discount", "has_structured_voucher")}, ("date", "date"), name="has_sales_metric"),
        Relation("shop_stats", shop, {c: f"daily_{c}" for c in SHOP_STATISTICS}, ("date", "date"), name="has_daily_statistics"),
    )


def market_pack(tables: dict[str, Callable[..., DataFrame]]) -> Pack:
    """The pack over the tables given; a relation to a table that was not collected, and what hangs on it, is left out."""
    kept = tuple(r for r in relations() if r.table in tables)
    lost = {c for r in relations() if r.table not in tables for c in r.columns.values()}
    return Pack(
        base="products", tables=tables, relations=kept,
        dimensions={n: d for n, d in DIMENSIONS.items() if d.column not in lost and d.label not in lost}, entities=ENTITIES,
        measures={n: m for n, m in MEASURES.items() if m.column not in lost}, qualifiers={n: q for n, q in QUALIFIERS.items() if q.column not in lost},
        snapshot="date", currency="country", grain=("country_code", "shop_id", "item_id", "date"),
    )
