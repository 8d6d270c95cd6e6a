"""Group statistics on every row, tiles, top-n, shares, and positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronage.operators import joins, ranking
from patronage.operators.aggregate import frequency
from patronage.plans import affinity
from patronage.plans import bookings as booking_plan
from patronage.plans import rfm
from patronage.registry.core import query
from patronage.session import durable
from patronage.sources import views
from patronage.sources.tables import table

KEY = views.BOOKING_KEY
KEY_SQL = ", ".join(KEY)


@query(
    f"""SELECT {KEY_SQL}, memberid, count(*) OVER (PARTITION BY memberid) AS total_visit FROM fx_bookings"""
)
def win_group_count(spark, folder):
    df = views.bookings(spark, folder).select(*KEY, "memberid")
    return joins.attach_group_stats(df, ["memberid"], {"total_visit": F.count(F.lit(1))})


@query(
    f"""SELECT {KEY_SQL}, memberid, max(total_pax) OVER w AS max_total_pax, min(total_pax) OVER w AS min_total_pax,
               max(roomnights) OVER w AS max_roomnight, min(roomnights) OVER w AS min_roomnight,
               max(numberofadults) OVER w AS max_adult, min(numberofadults) OVER w AS min_adult,
               max(numberofchildren) OVER w AS max_children, min(numberofchildren) OVER w AS min_children,
               count(*) OVER w AS total_visit
        FROM fx_bookings WINDOW w AS (PARTITION BY memberid)"""
)
def win_member_stats(spark, folder):
    df = views.bookings(spark, folder)
    stats = durable(booking_plan.member_stats(df))
    return joins.null_safe_join(df.select(*KEY, "memberid"), stats, booking_plan.MEMBER)


@query(
    f"""SELECT {KEY_SQL}, memberid, resort_region_code, resort_type_code,
               max(roomnights) OVER w AS max_roomnight_rrc, min(roomnights) OVER w AS min_roomnight_rrc,
               count(*) OVER w AS total_visit_rrc, min(numberofadults) OVER w AS min_adult_rrc,
               max(numberofchildren) OVER w AS max_children_rrc, min(numberofchildren) OVER w AS min_children_rrc
        FROM fx_bookings WINDOW w AS (PARTITION BY memberid, resort_region_code, resort_type_code)"""
)
def win_member_region_stats(spark, folder):
    df = views.bookings(spark, folder)
    stats = durable(booking_plan.resort_stats(df))
    keys = booking_plan.MEMBER_RESORT
    return joins.null_safe_join(df.select(*KEY, *keys), stats, keys)


@query(
    f"""SELECT {KEY_SQL}, memberid, d, r, lead FROM (
            SELECT *, count(*) OVER w AS d, CAST(checkin_date - booking_date AS INTEGER) AS lead,
                   CASE WHEN count(amount) OVER w = count(*) OVER w
                        THEN CAST(sum(amount) OVER w AS DOUBLE) END AS r
            FROM fx_bookings WINDOW w AS (PARTITION BY memberid)) WHERE lead < 0"""
)
def win_group_stat_filter(spark, folder):
    lead = F.datediff("checkin_date", "booking_date")
    df = views.bookings(spark, folder).select(*KEY, "memberid", "amount", lead.alias("lead"))
    total = F.when(F.count("amount") == F.count(F.lit(1)), F.sum("amount")).cast("double")
    stats = {"d": F.count(F.lit(1)), "r": total}
    return joins.attach_group_stats(df, ["memberid"], stats).where(F.col("lead") < 0).drop("amount")


# ---- tiles and positions ----


@query(
    """SELECT customer_id, recency, CAST(ntile(4) OVER (ORDER BY recency, customer_id) AS INTEGER) AS r
       FROM (SELECT customer_id, CAST(recency AS INTEGER) AS recency FROM v_rfm)"""
)
def win_ntile_asc(spark, folder):
    recency = rfm.recency(views.customers(spark, folder))
    return ranking.exact_ntile(recency, "recency", "customer_id", 4, "r")


@query(
    """SELECT b.customer_id, b.frequency, t.f FROM v_rfm b LEFT JOIN
       (SELECT customer_id, CAST(ntile(4) OVER (ORDER BY frequency DESC, customer_id) AS INTEGER) AS f
        FROM v_rfm WHERE frequency IS NOT NULL) t ON b.customer_id = t.customer_id"""
)
def win_ntile_desc(spark, folder):
    base = rfm.base(views.customers(spark, folder), views.transactions(spark, folder))
    base = base.select("customer_id", "frequency")
    return ranking.exact_ntile(base, "frequency", "customer_id", 4, "f", descending=True)


_LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")


@query(
    f"""SELECT {", ".join(_LINE_ORDER)}, row_number() OVER (ORDER BY {", ".join(_LINE_ORDER)}) AS position
        FROM lineitem"""
)
def srt_multi(spark, folder):
    lines = table(spark, folder, "lineitem").select(*_LINE_ORDER)
    return ranking.global_position(lines, [F.col(c).asc() for c in _LINE_ORDER], "position")


# ---- top-n ----


@query(
    """SELECT checkin_quarter, state_code_residence, n FROM (
           SELECT *, rank() OVER (PARTITION BY checkin_quarter ORDER BY n DESC) AS place FROM (
               SELECT CAST(quarter(checkin_date) AS INTEGER) AS checkin_quarter, state_code_residence, count(*) AS n
               FROM fx_bookings GROUP BY 1, 2)) WHERE place <= 3"""
)
def win_top_n_group(spark, folder):
    df = views.bookings(spark, folder).withColumn("checkin_quarter", F.quarter("checkin_date"))
    counts = durable(frequency(df, "checkin_quarter", "state_code_residence"))
    return ranking.top_n_per_group(counts, "n", ["checkin_quarter"], 3)


@query(
    """SELECT customer_id, n FROM (
           SELECT *, rank() OVER (ORDER BY n DESC) AS place FROM (
               SELECT customer_id, count(*) AS n FROM fx_transactions GROUP BY customer_id)) WHERE place <= 30"""
)
def win_top_n_global(spark, folder):
    counts = durable(frequency(views.transactions(spark, folder), "customer_id"))
    return ranking.top_n(counts, "n", 30)


# ---- shares ----


@query(
    """SELECT store_code, return_reason, items, CAST(items AS DOUBLE) / sum(items) OVER (PARTITION BY store_code)
              AS share
       FROM (SELECT store_code, return_reason, CAST(sum(item_count) AS BIGINT) AS items FROM fx_transactions
             WHERE transaction_type = 'Return' GROUP BY store_code, return_reason)"""
)
def win_share_of_group(spark, folder):
    returns = views.transactions(spark, folder).where(F.col("transaction_type") == "Return")
    items = returns.groupBy("store_code", "return_reason").agg(F.sum("item_count").alias("items"))
    return joins.share_of_group(items, "items", ["store_code"], "share")


@query(
    """SELECT customer_id, CAST(revenue AS DOUBLE) AS revenue,
              CAST(sum(revenue) OVER (ORDER BY revenue DESC, customer_id ROWS UNBOUNDED PRECEDING) AS DOUBLE)
              / CAST(sum(revenue) OVER () AS DOUBLE) AS share
       FROM (SELECT customer_id, sum(revenue) AS revenue FROM fx_transactions GROUP BY customer_id)"""
)
def win_cumulative_share(spark, folder):
    sums = views.transactions(spark, folder).groupBy("customer_id").agg(F.sum("revenue").alias("revenue"))
    shares = affinity.cumulative_share(sums, "revenue", "customer_id", "share")
    return shares.withColumn("revenue", F.col("revenue").cast("double"))
