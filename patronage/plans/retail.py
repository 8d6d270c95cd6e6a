"""Cleaning of customers and stores, enrichment of transactions, and the returns reports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.functions import calendar, labels
from patronage.functions.arithmetic import ratio
from patronage.functions.calendar import WEEK_REPAIRS
from patronage.functions.text import without
from patronage.operators.aggregate import frequency
from patronage.operators.columns import derive
from patronage.operators.fills import fill_constants, lump_rare
from patronage.operators.joins import join_dimension, share_of_group
from patronage.operators.reshape import spread, unite

# The birth date assumed when unknown, the years reported, the regions of the home-state
# report, and the label an unspecified nationality gets.
UNKNOWN_BIRTH = "01JAN1900:00:00:00"
REPORT_YEARS = (2016, 2017)
NEAR_REGIONS = ("Abu Dhabi", "Sharjah", "Dubai")
UNSPECIFIED = "Unspecified"
UNDEFINED = "UNDEFINED"

# Columns the cleaned tables do not keep, where a source has them.
CUSTOMER_DROPS = ("territory",)
STORE_DROPS = ("mall_name", "store_name", "geo_field", "business", "territory")
TRANSACTION_DROPS = ("city_name", "store_type", "business", "territory")


def clean_customers(
    customers: DataFrame,
    rare_limit: int = labels.RARE_NATIONALITY_LIMIT,
    stamps: Mapping[str, str] | None = None,
) -> DataFrame:
    """Dates from stamps (``{raw column: date column}``), repaired labels, rare nationalities lumped."""
    stamps = stamps or {"birth_date_raw": "birth_date", "last_accr_raw": "last_accr_date"}
    df = fill_constants(customers, {"birth_date_raw": UNKNOWN_BIRTH})
    df = df.withColumns({new: calendar.parse_stamp(F.col(raw)) for raw, new in stamps.items()})
    df = df.drop(*stamps, *CUSTOMER_DROPS).withColumns(
        {
            "job_type": labels.relabel(
                F.col("job_type"), labels.LONG_JOB_TITLE, labels.SHORT_JOB_TITLE
            ),
            "income_range": labels.relabel(F.col("income_range"), "Unknown", UNSPECIFIED),
        }
    )
    df = lump_rare(df, "nationality", "nationality_group", rare_limit)
    return df.withColumn(
        "nationality_group", labels.relabel(F.col("nationality_group"), UNSPECIFIED, UNDEFINED)
    )


def clean_stores(stores: DataFrame, age_day: dt.date = calendar.STORE_AGE_DAY) -> DataFrame:
    """Store format, region without prefix, age and revenue ratios."""
    return derive(
        stores,
        store_format=labels.store_format(F.col("mall_name")),
        region=without(F.col("region"), labels.REGION_PREFIX),
        store_age=calendar.age_in_days(F.col("store_launch_date"), age_day),
        rev_age=ratio(F.col("total_revenue"), F.col("store_age")),
        rev_sqft=ratio(F.col("sales_per_day"), F.col("store_size_sq_ft")),
    ).drop(*STORE_DROPS)


def enrich_transactions(
    transactions: DataFrame,
    stores: DataFrame,
    customers: DataFrame,
    years: Sequence[int] = REPORT_YEARS,
    week_repairs: Mapping[tuple[int, int], dt.date] = WEEK_REPAIRS,
    store_columns: Sequence[str] = ("region", "store_format", "sales_per_day"),
    customer_columns: Sequence[str] = ("state", "points", "nationality_group"),
) -> DataFrame:
    """Transactions of the reported years with store and customer columns, calendar and amounts.

    ``store_columns`` may name any cleaned or clustered store column, as ``customer_columns`` may.
    Transactions without a store or customer drop out. Catalyst moves the year filter below the joins.
    """
    kept = transactions.drop(*TRANSACTION_DROPS)
    df = join_dimension(kept, stores, "store_code", store_columns)
    df = join_dimension(df, customers, "customer_id", customer_columns)
    df = fill_constants(df.where(F.col("year").isin(*years)), {"return_reason": labels.NO_RETURN})
    return derive(
        df,
        return_group=labels.collapse(F.col("return_reason")),
        week_start=calendar.week_start_repaired(F.col("year"), F.col("week"), week_repairs),
        year_quarter=calendar.year_quarter(F.col("week_start")),
        y_m=calendar.year_month(F.col("week_start")),
        is_return=labels.return_flag(F.col("transaction_type")),
        extra_items=F.col("units_sold") - F.col("item_count"),
        gross=F.col("revenue") + F.col("discount"),
    )


def quarters(years: Sequence[int]) -> list[str]:
    """All ``yyyy-q`` labels a table of these years can hold, with that of an unknown week."""
    return [f"{y}-{q}" for y in years for q in (1, 2, 3, 4)] + ["NA-NA"]


def pairs_of(left: Sequence, right: Sequence) -> list[str]:
    return [f"{a}_{b}" for a in left for b in right]


def customer_quarter_counts(enriched: DataFrame, values: Sequence[str]) -> DataFrame:
    """Customer by (quarter, type): transaction counts, zero where there are none."""
    counts = frequency(enriched, "customer_id", "year_quarter", "transaction_type")
    labelled = unite(counts, "label", ["year_quarter", "transaction_type"])
    return spread(labelled, ["customer_id"], "label", values, F.sum("n"), fill=0)


def store_quarter_means(enriched: DataFrame, values: Sequence[str], prefix: str = "n.AVG_") -> DataFrame:
    """Store by (quarter, type): mean gross amount, in prefixed columns."""
    labelled = unite(
        enriched.select("store_code", "year_quarter", "transaction_type", "gross"),
        "label",
        ["year_quarter", "transaction_type"],
    )
    mean = F.sum("gross").cast("double") / F.count("gross")
    wide = spread(labelled, ["store_code"], "label", values, mean)
    return wide.withColumnsRenamed({v: prefix + v for v in values})


def region_year_gross(enriched: DataFrame, values: Sequence[str]) -> DataFrame:
    """Region by (year, type): gross amount."""
    labelled = unite(
        enriched.select("region", "year", "transaction_type", "gross"), "label", ["year", "transaction_type"]
    )
    return spread(labelled, ["region"], "label", values, F.sum("gross"))


def returns_by_reason(enriched: DataFrame) -> DataFrame:
    """Gross amount per reason group, smallest first."""
    totals = enriched.groupBy("return_group").agg(F.sum("gross").alias("total_return"))
    return totals.orderBy("total_return", "return_group")


def _returned_items(enriched: DataFrame, keys: Sequence[str]) -> DataFrame:
    returns = enriched.where(F.col("transaction_type") == labels.RETURN_TYPE)
    return returns.groupBy(*keys).agg(F.sum("item_count").alias("total_return"))


def region_reason_shares(enriched: DataFrame, values: Sequence[str]) -> DataFrame:
    """Region by reason group: share of the region's returned items, zero filled."""
    items = _returned_items(enriched, ["region", "return_group"])
    shares = share_of_group(items, "total_return", ["region"], "percent")
    return spread(shares, ["region"], "return_group", values, F.max("percent"), fill=0.0)


def region_quarter_reason_shares(
    enriched: DataFrame, values: Sequence[str], keep_total: bool = True
) -> DataFrame:
    """Region by (quarter, reason group): share of the quarter's returned items, zero filled.

    With ``keep_total`` the item total stays a row key, which spreads a region over one sparse row per
    total; without it there is one row per region.
    """
    items = _returned_items(enriched, ["region", "year_quarter", "return_group"])
    shares = share_of_group(items, "total_return", ["region", "year_quarter"], "percent")
    labelled = unite(shares, "label", ["year_quarter", "return_group"])
    keys = ["region", "total_return"] if keep_total else ["region"]
    return spread(labelled, keys, "label", values, F.max("percent"), fill=0.0)


def customer_store_totals(enriched: DataFrame) -> DataFrame:
    """Customer and store: gross amount and extra items."""
    return enriched.groupBy("customer_id", "store_code").agg(
        F.sum("gross").alias("rev"), F.sum("extra_items").alias("extra_items")
    )


def home_state_by_region(enriched: DataFrame, regions: Sequence[str] = NEAR_REGIONS) -> DataFrame:
    """Transactions per home state and shop region for the named regions, most first."""
    counts = frequency(enriched.where(F.col("region").isin(*regions)), "state", "region")
    return counts.orderBy(F.desc("n"), "state", "region")
