"""The questions that are asked most, as requests over the market pack."""

from __future__ import annotations

from quern.plans.model import Request


def listing_count(country: str, snapshot="latest") -> Request:
    return Request("product_listing", "count", where=(("country", "eq", country),), snapshot=snapshot)


def highest_price(country: str, snapshot="latest") -> Request:
    return Request("price", "max", where=(("country", "eq", country),), snapshot=snapshot)


def highest_sold(country: str, snapshot="latest") -> Request:
    return Request("monthly_sold", "max", where=(("country", "eq", country),), snapshot=snapshot)


def top_shop(country: str, snapshot="latest") -> Request:
    """The shop with the most listings."""
    return Request("product_listing", "count", by=("shop",), where=(("country", "eq", country),), snapshot=snapshot, rank="one")


def median_price_by_date(country: str) -> Request:
    return Request("price", "median", by=("date",), where=(("country", "eq", country),))


def highest_revenue_day(country: str) -> Request:
    """The day of the largest median of the revenue proxy; its sum would count a sale again every day."""
    return Request("estimated_recent_revenue", "median", by=("date",), where=(("country", "eq", country),), rank="one")
