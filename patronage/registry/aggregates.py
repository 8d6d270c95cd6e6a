"""Aggregation, imputation from groups, and profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronage.functions import labels
from patronage.functions.missing import strict
from patronage.operators import aggregate, fills, profile
from patronage.operators.ranking import exact_quantiles
from patronage.plans import bookings as booking_plan
from patronage.plans import rfm
from patronage.registry.core import query
from patronage.sources import views
from patronage.sources.tables import table

KEY = views.BOOKING_KEY
KEY_SQL = ", ".join(KEY)

# ---- counts and sums ----


@query("SELECT total_pax, count(*) AS n FROM fx_bookings GROUP BY total_pax")
def agg_freq(spark, folder):
    counts = aggregate.frequency(views.bookings(spark, folder), "total_pax")
    return aggregate.most_frequent_first(counts)


@query(
    """SELECT customer_id, store_code, count(*) AS n FROM fx_transactions GROUP BY customer_id, store_code"""
)
def agg_freq_multi(spark, folder):
    counts = aggregate.frequency(views.transactions(spark, folder), "customer_id", "store_code")
    return aggregate.most_frequent_first(counts)


@query(
    """SELECT checkin_quarter, season_holidayed_code, count(*) AS n
       FROM (SELECT CAST(quarter(checkin_date) AS INTEGER) AS checkin_quarter, season_holidayed_code
             FROM fx_bookings) GROUP BY checkin_quarter, season_holidayed_code"""
)
def agg_crosstab(spark, folder):
    df = views.bookings(spark, folder).withColumn("checkin_quarter", F.quarter("checkin_date"))
    return aggregate.frequency(df, "checkin_quarter", "season_holidayed_code")


@query(
    """SELECT store_code, CAST(sum(revenue) AS DOUBLE) AS revenue FROM fx_transactions GROUP BY store_code"""
)
def agg_sum(spark, folder):
    df = views.transactions(spark, folder)
    sums = aggregate.grouped_sum(df, ["store_code"], F.col("revenue"), "revenue")
    return sums.withColumn("revenue", F.col("revenue").cast("double"))


@query(
    """SELECT year, transaction_type, CAST(sum(revenue + discount) AS DOUBLE) AS gross
       FROM fx_transactions GROUP BY year, transaction_type"""
)
def agg_sum_expr(spark, folder):
    gross = F.col("revenue") + F.col("discount")
    sums = aggregate.grouped_sum(
        views.transactions(spark, folder), ["year", "transaction_type"], gross, "gross"
    )
    return sums.withColumn("gross", F.col("gross").cast("double"))


@query(
    """SELECT customer_id, store_code, CAST(sum(revenue) AS DOUBLE) AS p
       FROM fx_transactions GROUP BY customer_id, store_code"""
)
def agg_customer_store_sum(spark, folder):
    sums = aggregate.grouped_sum(
        views.transactions(spark, folder), ["customer_id", "store_code"], F.col("revenue"), "p"
    )
    return sums.withColumn("p", F.col("p").cast("double"))


@query(
    """SELECT customer_id, CAST(sum(CASE WHEN transaction_type = 'Return' THEN -item_count ELSE item_count END)
              AS BIGINT) AS items FROM fx_transactions GROUP BY customer_id"""
)
def agg_signed_sum(spark, folder):
    items = labels.signed(F.col("item_count"), F.col("transaction_type"))
    df = views.transactions(spark, folder)
    return aggregate.grouped_sum(df, ["customer_id"], items, "items", skip_missing=True)


@query(
    """SELECT adv_booking, CAST(sum(amount) AS DOUBLE) / count(amount) AS mean_amount
       FROM v_cleaned_bookings WHERE amount IS NOT NULL GROUP BY adv_booking"""
)
def agg_mean_nonnull(spark, folder):
    df = booking_plan.repair_lead(views.bookings(spark, folder))
    known = df.where(F.col("amount").isNotNull())
    return known.groupBy(labels.lead_time(F.col("advance_booking")).alias("adv_booking")).agg(
        aggregate.exact_mean(F.col("amount")).alias("mean_amount")
    )


@query(
    """SELECT memberid, CASE WHEN count(amount) = count(*) THEN CAST(sum(amount) AS DOUBLE) END AS strict_sum,
              CAST(sum(amount) AS DOUBLE) AS known_sum FROM fx_bookings GROUP BY memberid"""
)
def agg_null_strict(spark, folder):
    df = views.bookings(spark, folder)
    total = F.sum("amount").cast("double")
    return df.groupBy("memberid").agg(
        strict(total, F.col("amount")).alias("strict_sum"), total.alias("known_sum")
    )


# ---- target encodings ----


def _encoding_sql(prefix: str) -> str:
    keys = ", ".join(booking_plan.ENCODINGS[prefix])
    return f"""
        SELECT {keys}, n AS {prefix}_spent, CAST(lo AS DOUBLE) / n AS {prefix}_min,
               CAST(hi AS DOUBLE) / n AS {prefix}_max, CAST(total AS DOUBLE) / n / n AS {prefix}_avg
        FROM (SELECT {keys}, count(*) AS n, min(amount) AS lo, max(amount) AS hi, sum(amount) AS total
              FROM v_cleaned_bookings WHERE is_train = 1 GROUP BY {keys})"""


def _encoding(spark, folder, prefix):
    training = booking_plan.clean(views.bookings(spark, folder)).where(F.col("is_train") == 1)
    return aggregate.target_encoding(training, booking_plan.ENCODINGS[prefix], "amount", prefix)


@query(_encoding_sql("prac"))
def te_prac(spark, folder):
    return _encoding(spark, folder, "prac")


@query(_encoding_sql("cmpr"))
def te_cmpr(spark, folder):
    return _encoding(spark, folder, "cmpr")


@query(_encoding_sql("sssr"))
def te_sssr(spark, folder):
    return _encoding(spark, folder, "sssr")


# ---- imputation from groups ----

_MODES_SQL = """
    SELECT checkin_quarter, season_holidayed_code, n,
           rank() OVER (PARTITION BY checkin_quarter ORDER BY n DESC) AS place
    FROM (SELECT CAST(quarter(checkin_date) AS INTEGER) AS checkin_quarter, season_holidayed_code, count(*) AS n
          FROM fx_bookings WHERE season_holidayed_code IS NOT NULL GROUP BY 1, 2)"""


def _by_quarter(spark, folder):
    return views.bookings(spark, folder).select(
        *KEY, F.quarter("checkin_date").alias("checkin_quarter"), "season_holidayed_code"
    )


@query(f"SELECT checkin_quarter, season_holidayed_code, n FROM ({_MODES_SQL}) WHERE place = 1")
def na_group_mode(spark, folder):
    return fills.group_mode(_by_quarter(spark, folder), ["checkin_quarter"], "season_holidayed_code")


@query(
    f"""SELECT {KEY_SQL}, b.checkin_quarter, coalesce(b.season_holidayed_code, m.mode) AS season_holidayed_code
        FROM (SELECT *, CAST(quarter(checkin_date) AS INTEGER) AS checkin_quarter FROM fx_bookings) b
        LEFT JOIN (SELECT checkin_quarter, min(season_holidayed_code) AS mode FROM ({_MODES_SQL})
                   WHERE place = 1 GROUP BY checkin_quarter) m
               ON b.checkin_quarter IS NOT DISTINCT FROM m.checkin_quarter"""
)
def na_fill_group_mode(spark, folder):
    return fills.fill_by_group_mode(
        _by_quarter(spark, folder), ["checkin_quarter"], "season_holidayed_code"
    )


@query(
    """SELECT customer_id, coalesce(job_length, max(job_length) OVER ()) AS job_length
       FROM (SELECT customer_id, CAST(length(job_type) AS INTEGER) AS job_length FROM fx_customers)"""
)
def na_fill_max(spark, folder):
    df = views.customers(spark, folder).select("customer_id", F.length("job_type").alias("job_length"))
    return fills.fill_with_max(df, "job_length")


@query("SELECT customer_id, CAST(recency AS INTEGER) AS recency FROM v_rfm")
def rfm_recency(spark, folder):
    return rfm.recency(views.customers(spark, folder))


@query("SELECT customer_id, frequency FROM v_rfm WHERE frequency IS NOT NULL")
def rfm_frequency(spark, folder):
    return rfm.activity(views.transactions(spark, folder)).select("customer_id", "frequency")


@query("SELECT customer_id, CAST(monetary AS DOUBLE) AS monetary FROM v_rfm WHERE frequency IS NOT NULL")
def rfm_monetary(spark, folder):
    activity = rfm.activity(views.transactions(spark, folder))
    return activity.select("customer_id", F.col("monetary").cast("double").alias("monetary"))


# ---- profiling ----


@query(
    """SELECT round(quantile_cont(o_totalprice, 0), 6) AS p0, round(quantile_cont(o_totalprice, 0.25), 6) AS p1,
              round(quantile_cont(o_totalprice, 0.5), 6) AS p2, round(quantile_cont(o_totalprice, 0.75), 6) AS p3,
              round(quantile_cont(o_totalprice, 1), 6) AS p4 FROM orders"""
)
def agg_quantiles(spark, folder):
    five = exact_quantiles(table(spark, folder, "orders"), "o_totalprice", profile.QUARTERS)
    return five.select([F.round(c, 6).alias(c) for c in five.columns])


@query(
    """SELECT o_orderpriority, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
              round(any_value(q3), 6) AS q3,
              min(v) FILTER (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)) AS whisker_low,
              max(v) FILTER (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
              count(*) FILTER (NOT (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1))) AS outliers
       FROM (SELECT o_orderpriority, o_totalprice AS v,
                    quantile_cont(o_totalprice, 0.25) OVER w AS q1, quantile_cont(o_totalprice, 0.5) OVER w AS median,
                    quantile_cont(o_totalprice, 0.75) OVER w AS q3
             FROM orders WINDOW w AS (PARTITION BY o_orderpriority)) GROUP BY o_orderpriority"""
)
def agg_boxplot(spark, folder):
    boxes = profile.box_plot(table(spark, folder, "orders"), "o_orderpriority", "o_totalprice")
    return boxes.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query(
    """SELECT CAST(least(floor((o_totalprice - lo) * 30 / (hi - lo)), 29) AS INTEGER) AS bin, count(*) AS n
       FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) GROUP BY 1"""
)
def agg_histogram(spark, folder):
    return profile.histogram(table(spark, folder, "orders"), "o_totalprice")


_SUMMARISED = ("total_pax", "roomnights", "numberofadults", "state_code_residence", "amount")


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{name}' AS measure, round(CAST({expression} AS DOUBLE), 6) AS value
            FROM fx_bookings"""
        for c in _SUMMARISED
        for name, expression in (
            ("min", f"min({c})"),
            ("q1", f"quantile_cont(CAST({c} AS DOUBLE), 0.25)"),
            ("median", f"quantile_cont(CAST({c} AS DOUBLE), 0.5)"),
            ("q3", f"quantile_cont(CAST({c} AS DOUBLE), 0.75)"),
            ("max", f"max({c})"),
            ("mean", f"CAST(sum({c}) AS DOUBLE) / count({c})"),
            ("missing", f"count(*) - count({c})"),
        )
    )
)
def prof_summary(spark, folder):
    long = profile.summary(views.bookings(spark, folder), _SUMMARISED)
    return long.withColumn("value", F.round("value", 6))


_CUSTOMER_COLUMNS = {
    "customer_id": "bigint",
    "birth_date_raw": "string",
    "last_accr_raw": "string",
    "nationality": "string",
    "job_type": "string",
    "income_range": "string",
    "points": "decimal(18,2)",
    "state": "string",
}


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing FROM fx_customers"""
        for c in _CUSTOMER_COLUMNS
    )
)
def prof_null_census(spark, folder):
    return profile.null_census(views.customers(spark, folder))


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(count(*) - count({c}) AS DOUBLE) / count(*) AS share FROM fx_customers"""
        for c in _CUSTOMER_COLUMNS
    )
)
def prof_missing_share(spark, folder):
    return profile.missing_share(views.customers(spark, folder))


@query(
    "SELECT concat("
    + ", ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in _CUSTOMER_COLUMNS)
    + ") AS pattern, count(*) AS n FROM fx_customers GROUP BY 1"
)
def prof_null_patterns(spark, folder):
    return profile.null_patterns(views.customers(spark, folder))


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{kind}' AS type, CAST(min({c}) AS VARCHAR) AS sample, count(*) AS rows
            FROM fx_customers"""
        for c, kind in _CUSTOMER_COLUMNS.items()
    )
)
def prof_schema(spark, folder):
    return profile.schema_peek(views.customers(spark, folder))
