"""Customers, stores, transactions, test pairs and bookings derived from the given tables.

The given tables hold no nulls; the views put some in by arithmetic on keys, so that every rule about
missing values has rows to act on. Each view covers its whole tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.functions.labels import REGION_PREFIX, RETURN_TYPE, STANDALONE
from patronage.sources.tables import table

PURCHASE_TYPE = "Purchase"
RETURN_REASONS = ("Size Problem", "Fit Problem", "Zip Defect", "Adhesive", "Gift Exchange", "Color Exchange")
FIRST_LAUNCH = dt.date(2010, 1, 1)
TEST_STORES = 4
BOOKING_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _every(key: Column, step: int, otherwise: Column) -> Column:
    """Null on every ``step``-th key."""
    return F.when(key % step != 0, otherwise)


def _money(column: str) -> Column:
    return F.col(column).cast("decimal(18,2)")


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    reason = F.lit(None).cast("string")
    for number, text in enumerate(RETURN_REASONS, start=1):
        reason = F.when(F.col("l_linenumber") == number, text).otherwise(reason)
    shipped = F.col("l_shipdate").cast("date")
    is_return = F.col("l_returnflag") == "R"
    week = F.floor((F.dayofyear(shipped) + 6 - F.weekday(shipped)) / 7)
    items = F.col("l_quantity").cast("int")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("customer_id"),
        F.col("l_suppkey").alias("store_code"),
        F.when(is_return, RETURN_TYPE).otherwise(PURCHASE_TYPE).alias("transaction_type"),
        F.when(is_return, reason).alias("return_reason"),
        items.alias("item_count"),
        (items + F.col("l_linenumber") % 3).cast("int").alias("units_sold"),
        _money("l_extendedprice").alias("revenue"),
        (_money("l_extendedprice") * F.col("l_discount").cast("decimal(4,2)"))
        .cast("decimal(18,4)")
        .alias("discount"),
        F.year(shipped).alias("year"),
        week.cast("int").alias("week"),
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    latest = (
        table(spark, folder, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_order"))
    )
    key = F.col("c_custkey")
    stamp = F.upper(F.date_format("last_order", "ddMMMyyyy:HH:mm:ss"))
    named = F.when(key % 19 == 0, "Unspecified").otherwise(F.col("n_name"))
    return (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(latest, key == F.col("o_custkey"), "left")
        .select(
            key.alias("customer_id"),
            _every(key, 9, F.lit("15MAR1980:00:00:00")).alias("birth_date_raw"),
            _every(key, 17, stamp).alias("last_accr_raw"),
            _every(key, 23, named).alias("nationality"),
            _every(key, 13, F.col("c_mktsegment")).alias("job_type"),
            F.when(key % 4 == 0, "Unknown").otherwise(F.col("c_mktsegment")).alias("income_range"),
            _money("c_acctbal").alias("points"),
            F.col("n_name").alias("state"),
        )
    )


def _test_codes(supplier: DataFrame) -> Column:
    """The highest codes there are, as one array."""
    highest = supplier.select("s_suppkey").distinct().orderBy(F.desc("s_suppkey")).limit(TEST_STORES)
    return highest.agg(F.array_sort(F.collect_list("s_suppkey"))).scalar()


def stores(spark: SparkSession, folder: str) -> DataFrame:
    supplier = table(spark, folder, "supplier")
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    code = F.col("s_suppkey")
    revenue = _money("s_acctbal")
    return (
        supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select(
            code.alias("store_code"),
            F.concat(F.lit(REGION_PREFIX), "r_name").alias("region"),
            F.when(code % 3 == 0, STANDALONE)
            .otherwise(F.concat(F.lit("MALL "), (code % 7).cast("string")))
            .alias("mall_name"),
            F.date_add(F.lit(FIRST_LAUNCH), (code % 1000).cast("int")).alias("store_launch_date"),
            revenue.alias("total_revenue"),
            (revenue.cast("double") / 30).alias("sales_per_day"),
            ((code % 5) * 100).cast("int").alias("store_size_sq_ft"),
            F.when(F.array_contains(_test_codes(supplier), code), "Test")
            .otherwise("Train")
            .alias("train_test_store"),
        )
    )


def test_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer with each of the test stores (the four highest codes); codes come as text."""
    codes = _test_codes(table(spark, folder, "supplier")).cast("array<string>")
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.explode(codes).alias("store_code")
    )


test_pairs.__test__ = False  # not a test, whatever its name suggests to a collector


def bookings(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders")
    order, number = F.col("l_orderkey"), F.col("l_linenumber")
    part, supplier, customer = F.col("l_partkey"), F.col("l_suppkey"), F.col("o_custkey")
    guests = F.col("l_quantity").cast("int")
    is_test = order % 5 == 0
    arrival = F.col("l_shipdate").cast("date")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        *BOOKING_KEY,
        F.concat(F.lit("member-"), customer.cast("string")).alias("memberid"),
        F.when(is_test, 0).otherwise(1).alias("is_train"),
        F.col("o_orderdate").cast("date").alias("booking_date"),
        arrival.alias("checkin_date"),
        F.date_add(arrival, number).alias("checkout_date"),
        (number - 1).alias("roomnights"),
        (guests % 7).alias("total_pax"),
        (guests % 4).alias("numberofadults"),
        (guests % 3).alias("numberofchildren"),
        _every(part, 11, (part % 4).cast("int")).alias("season_holidayed_code"),
        _every(customer, 12, (customer % 25).cast("int")).alias("state_code_residence"),
        (supplier % 25).cast("int").alias("state_code_resort"),
        (supplier % 3).cast("int").alias("resort_region_code"),
        (supplier % 4).cast("int").alias("resort_type_code"),
        (customer % 6).cast("int").alias("cluster_code"),
        (customer % 5).cast("int").alias("member_age_buckets"),
        (part % 4).cast("int").alias("room_type_booked_code"),
        F.col("o_orderstatus").alias("reservationstatusid_code"),
        F.when(~is_test, _money("l_extendedprice")).alias("amount"),
    )
