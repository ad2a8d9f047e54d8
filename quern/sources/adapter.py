"""A database export as the tables of a raw drop: a panel of listings by day, with what was observed on one day only left blank on others."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.relational import ContractError, one_per_key, relation_join

LISTING, SHOP = ["country_code", "shop_id", "item_id"], ["country_code", "shop_id"]
#: Columns of a product that say who it is, columns that hold on the day of its snapshot only, and columns that an export has not.
IDENTITY = (
    "product_name", "url", "image_url", "images", "seller_flag", "image_overlay", "is_ad", "is_sold_out", "ctime", "vouchers", "brand_id", "tier_variation_name", "tier_variation_options", "location",
    "shopee_category_id", "global_category_id",
)
POINT_IN_TIME = ("rating", "rating_count", "rating_count_detail", "liked_count", "history_sold", "monthly_sold", "discount_percent")
UNAVAILABLE = ("shopee_verified", "seller_flag_hash", "image_overlay_hash", "key")
EPOCHS = ("ctime", "voucher_start_time", "voucher_end_time")
STAMPS = ("created_at", "last_active_time")


@dataclass(frozen=True)
class Export:
    """The tables of an export, and two borrowed ones: names of brands by country and id, and the platform's categories."""

    products: DataFrame
    promotions: DataFrame
    shop_info: DataFrame
    shop_stats: DataFrame
    categories: DataFrame
    product_categories: DataFrame
    brands: DataFrame
    taxonomy: DataFrame


def filled(df: DataFrame, name: str, fill: str = "") -> DataFrame:
    return df.withColumn(name, F.coalesce(F.col(name).cast("string"), F.lit(fill)))


def seconds(name: str):
    return F.coalesce(F.unix_seconds(F.try_to_timestamp(F.nullif(F.col(name), F.lit("")))).cast("string"), F.lit(""))


def stamp(name: str):
    return F.coalesce(F.date_format(F.try_to_timestamp(F.nullif(F.col(name), F.lit(""))), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.lit(""))


def brand_names(reference: DataFrame) -> DataFrame:
    """(country_code, brand_id, brand): an id that stands for two names is an error when it is read."""
    pairs = reference.where("brand is not null and brand_id is not null").select("country_code", F.col("brand_id").cast("string").alias("brand_id"), "brand").distinct()
    return one_per_key(pairs, ["country_code", "brand_id"])


def stale_products(export: Export) -> DataFrame:
    """Listings whose product row is not of the last day of their promotions; an export with one is not adapted."""
    last = export.promotions.groupBy("country_code", "item_id").agg(F.max("date").alias("last"))
    stated = export.products.select("country_code", "item_id", "date")
    return last.join(stated, ["country_code", "item_id"], "left").where(~F.col("date").eqNullSafe(F.col("last")))


def panel(export: Export) -> DataFrame:
    """Products by day: every row of the promotions with the product's identity and, on its own day, what was observed then."""
    promotions = one_per_key(export.promotions, [*LISTING, "date"])
    columns = [c for c in (*IDENTITY, *POINT_IN_TIME) if c in export.products.columns and c not in promotions.columns]
    names = {c: c for c in columns} | {"date": "observed_date"}
    out = relation_join(promotions, export.products, {k: k for k in LISTING}, names)
    observed = F.coalesce(F.col("date") == F.col("observed_date"), F.lit(False))
    out = out.withColumns({c: F.when(observed, F.col(c).cast("string")).otherwise("") for c in columns if c in POINT_IN_TIME})
    out = out.withColumn("attributes_observed", observed.cast("string")).drop("observed_date")
    out = relation_join(out.withColumn("brand_id", F.col("brand_id").cast("long").cast("string")), export.brands, {"country_code": "country_code", "brand_id": "brand_id"}, {"brand": "brand"})
    out = relation_join(out, export.shop_info, {k: k for k in SHOP}, {"shop_name": "shop_name"})
    renamed = {"shopee_category_id": "catid", "global_category_id": "global_catids", "history_sold": "history_sold_value", "monthly_sold": "monthly_sold_value"}
    out = out.withColumnsRenamed({a: b for a, b in renamed.items() if a in out.columns})
    out = out.withColumns({c: seconds(c) for c in EPOCHS if c in out.columns})
    return filled(filled(out, "brand"), "shop_name").withColumns({"platform": F.lit("Shopee"), "shop_slug": F.lit("")} | {c: F.lit("") for c in UNAVAILABLE})


def identities(export: Export) -> DataFrame:
    shops = one_per_key(export.shop_info, SHOP)
    made = {c: stamp(c) for c in STAMPS if c in shops.columns}
    if "shop_created_at" in shops.columns:
        made["created_at"] = stamp("shop_created_at")
    return shops.withColumns(made).drop("shop_created_at")


def shop_snapshot(export: Export) -> DataFrame:
    """A row per shop: its statistics on their last day, with its identity."""
    last = export.shop_stats.agg(F.max("date").alias("date"))
    stats = one_per_key(export.shop_stats.join(F.broadcast(last), "date", "left_semi"), [*SHOP, "date"])
    identity = identities(export)
    return relation_join(stats, identity, {k: k for k in SHOP}, {c: c for c in identity.columns if c not in SHOP and c not in stats.columns}).withColumn("username", F.lit(""))


def shop_daily(export: Export) -> DataFrame:
    """A row per shop and day, with the columns of its identity that hold on all days."""
    identity = identities(export)
    fixed = [c for c in ("shop_name", "is_official_shop", "is_shopee_verified", "is_preferred_plus_seller") if c in identity.columns]
    return relation_join(one_per_key(export.shop_stats, [*SHOP, "date"]), identity, {k: k for k in SHOP}, {c: c for c in fixed})


def shelves(export: Export) -> DataFrame:
    """The shelves with the panel's last day as their date: the export has none, and no other day was observed."""
    last = export.promotions.agg(F.max("date")).first()[0]
    renamed = export.categories.withColumnsRenamed({"category_id": "shop_category_id", "parent_category_id": "parent_shop_category_id"})
    return renamed.withColumn("date", F.lit(last))


def adapted(export: Export) -> dict[str, DataFrame]:
    """The datasets of a drop by name; an export of another shape than this one is refused."""
    if not stale_products(export).isEmpty():
        raise ContractError("EXPORT_STALE", "a product's row is not of its last day")
    categories = export.product_categories.withColumnRenamed("category_slug", "category_slug_text").withColumn("category_slug", F.col("category_id"))
    taxonomy = export.taxonomy.drop(*(c for c in export.taxonomy.columns if c.startswith(("path_", "source_")) or c.endswith("_num")))
    return {"products": panel(export), "shop_info": shop_snapshot(export), "shop_stats": shop_daily(export), "category_list": shelves(export), "product_categories": categories, "category_platform": taxonomy}


def brand_report(panel_rows: DataFrame) -> DataFrame:
    """One row: listings whose brand has a name, an id without a name, and no id."""
    each = panel_rows.groupBy("country_code", "item_id").agg(F.max("brand").alias("brand"), F.max("brand_id").alias("brand_id"))
    has = F.coalesce(~F.col("brand_id").isin("", "0"), F.lit(False))
    return each.agg(F.count_if(F.col("brand") != "").alias("mapped"), F.count_if(has & (F.col("brand") == "")).alias("unmapped"), F.count_if(~has).alias("without_id"))
