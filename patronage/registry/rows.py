"""Row-wise queries: projections, filters, recoding, strings, dates, arithmetic."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from patronage.functions import arithmetic, calendar, labels, missing, text
from patronage.operators import columns, fills
from patronage.plans import bookings as booking_plan
from patronage.plans import retail
from patronage.registry.core import query
from patronage.sources import views
from patronage.sources.tables import table

KEY = views.BOOKING_KEY
KEY_SQL = ", ".join(KEY)
WEEK_REPAIRS = {(1997, 0): dt.date(1997, 1, 6)}

LEAD_SQL = f"""
    SELECT {KEY_SQL}, checkin_date,
           CASE WHEN checkin_date < booking_date THEN checkin_date ELSE booking_date END AS booking_date,
           CAST(CASE WHEN checkin_date < booking_date THEN 0 ELSE checkin_date - booking_date END AS INTEGER)
           AS advance_booking
    FROM fx_bookings"""


# ---- projections ----


@query(LEAD_SQL)
def prj_sequential_derive(spark, folder):
    df = views.bookings(spark, folder).select(*KEY, "booking_date", "checkin_date")
    late = F.col("advance_booking") < 0
    return columns.derive(
        df,
        advance_booking=calendar.days_between(F.col("checkin_date"), F.col("booking_date")),
        booking_date=F.when(late, F.col("checkin_date")).otherwise(F.col("booking_date")),
    ).withColumn("advance_booking", F.when(late, 0).otherwise(F.col("advance_booking")))


@query("SELECT customer_id, nationality, income_range, state FROM fx_customers")
def prj_drop(spark, folder):
    return views.customers(spark, folder).drop("birth_date_raw", "last_accr_raw", "job_type", "points")


@query("SELECT customer_id, state, points FROM fx_customers")
def prj_select(spark, folder):
    return views.customers(spark, folder).select("customer_id", "state", "points")


@query(
    f"""SELECT {KEY_SQL}, total_pax, roomnights, numberofadults, numberofchildren, cluster_code,
               member_age_buckets, amount FROM fx_bookings"""
)
def prj_feature_list(spark, folder):
    features = ["total_pax", "roomnights", "numberofadults", "numberofchildren"]
    codes = ["cluster_code", "member_age_buckets"]
    return views.bookings(spark, folder).select(*KEY, *features, *codes, "amount")


@query(
    """SELECT customer_id, CAST(store_code AS BIGINT) AS store_code, TRY_CAST('x' || store_code AS BIGINT) AS bad_code
       FROM fx_test_pairs"""
)
def prj_cast(spark, folder):
    code = F.col("store_code")
    return views.test_pairs(spark, folder).select(
        "customer_id",
        code.try_cast("long").alias("store_code"),
        F.concat(F.lit("x"), code).try_cast("long").alias("bad_code"),
    )


@query(
    f"""SELECT {KEY_SQL}, CAST(cluster_code AS VARCHAR) AS cluster_code,
               CAST(member_age_buckets AS VARCHAR) AS member_age_buckets,
               CAST(season_holidayed_code AS VARCHAR) AS season_holidayed_code FROM fx_bookings"""
)
def prj_apply_across(spark, folder):
    codes = ["cluster_code", "member_age_buckets", "season_holidayed_code"]
    df = views.bookings(spark, folder).select(*KEY, *codes)
    return columns.across(df, codes, lambda c: c.cast("string"))


@query("SELECT customer_id, points, nationality FROM fx_customers WHERE income_range <> 'Unknown'")
def prj_scatter_points(spark, folder):
    df = views.customers(spark, folder).where(F.col("income_range") != "Unknown")
    return df.select("customer_id", "points", "nationality")


# ---- filters ----


@query(f"SELECT {KEY_SQL}, memberid, total_pax FROM fx_bookings WHERE total_pax > 4")
def flt_compare(spark, folder):
    return views.bookings(spark, folder).where(F.col("total_pax") > 4).select(*KEY, "memberid", "total_pax")


@query(
    """SELECT customer_id, store_code, transaction_type, year, revenue FROM fx_transactions
       WHERE year IN (1996, 1997)"""
)
def flt_in(spark, folder):
    df = views.transactions(spark, folder).where(F.col("year").isin(1996, 1997))
    return df.select("customer_id", "store_code", "transaction_type", "year", "revenue")


@query(
    """SELECT customer_id, job_type FROM fx_customers
       WHERE job_type IS NULL OR job_type NOT IN ('MACHINERY', 'FURNITURE')"""
)
def flt_not_in_keep_null(spark, folder):
    df = views.customers(spark, folder).select("customer_id", "job_type")
    return df.where(missing.not_among(F.col("job_type"), ["MACHINERY", "FURNITURE"]))


@query(
    """SELECT customer_id, birth_date_raw, nationality FROM fx_customers
       WHERE last_accr_raw IS NULL AND job_type IS NOT NULL"""
)
def flt_null(spark, folder):
    df = views.customers(spark, folder)
    df = df.where(F.col("last_accr_raw").isNull() & F.col("job_type").isNotNull())
    return df.select("customer_id", "birth_date_raw", "nationality")


@query(
    """SELECT is_train, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount
       FROM fx_bookings GROUP BY is_train"""
)
def flt_train_test_split(spark, folder):
    train, test = columns.split_by_flag(views.bookings(spark, folder), "is_train")
    parts = [
        part.groupBy("is_train").agg(
            F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("amount")
        )
        for part in (train, test)
    ]
    return columns.stack(*parts)


# ---- recoding ----


@query(
    f"""SELECT {KEY_SQL}, total_pax, CASE WHEN total_pax > 4 OR total_pax < 2 THEN 'others'
               WHEN total_pax = 2 THEN 'couple' ELSE 'family' END AS pax FROM fx_bookings"""
)
def cnd_bin_party(spark, folder):
    df = views.bookings(spark, folder).select(*KEY, "total_pax")
    return df.withColumn("pax", labels.party_size(F.col("total_pax")))


@query(
    f"""SELECT {KEY_SQL}, roomnights, CASE WHEN roomnights <= 2 THEN 'VShort' WHEN roomnights <= 4 THEN 'Normal'
               WHEN roomnights <= 7 THEN 'Week' WHEN roomnights > 7 THEN 'Long' END AS room_stay FROM fx_bookings"""
)
def cnd_bin_stay(spark, folder):
    df = views.bookings(spark, folder).select(*KEY, "roomnights")
    return df.withColumn("room_stay", labels.stay_length(F.col("roomnights")))


@query(
    f"""SELECT {KEY_SQL}, CASE WHEN d <= 2 THEN 'Sudden' WHEN d <= 15 THEN 'Fortnite' WHEN d <= 31 THEN 'Amonth'
               WHEN d > 31 THEN 'Long Booking' END AS adv_booking
        FROM (SELECT *, checkin_date - booking_date AS d FROM fx_bookings)"""
)
def cnd_bin_lead(spark, folder):
    lead = calendar.days_between(F.col("checkin_date"), F.col("booking_date"))
    return views.bookings(spark, folder).select(*KEY, labels.lead_time(lead).alias("adv_booking"))


@query(LEAD_SQL)
def cnd_repair_lead(spark, folder):
    df = views.bookings(spark, folder).select(*KEY, "booking_date", "checkin_date")
    return booking_plan.repair_lead(df)


@query(
    f"""SELECT {KEY_SQL}, CAST(CASE WHEN roomnights < 1 THEN checkout_date - checkin_date ELSE roomnights END
               AS INTEGER) AS roomnights FROM fx_bookings"""
)
def cnd_repair_nights(spark, folder):
    return booking_plan.repair_nights(views.bookings(spark, folder)).select(*KEY, "roomnights")


@query(
    """SELECT customer_id, CASE WHEN income_range = 'Unknown' THEN 'Unspecified' ELSE income_range END
       AS income_range, CASE WHEN job_type = 'MACHINERY' THEN 'Machines' ELSE job_type END AS job_type
       FROM fx_customers"""
)
def cnd_relabel(spark, folder):
    return views.customers(spark, folder).select(
        "customer_id",
        labels.relabel(F.col("income_range"), "Unknown", "Unspecified").alias("income_range"),
        labels.relabel(F.col("job_type"), "MACHINERY", "Machines").alias("job_type"),
    )


@query(
    """SELECT customer_id, store_code, revenue, CASE WHEN transaction_type = 'Return' THEN 1 ELSE 0 END
       AS is_return FROM fx_transactions"""
)
def cnd_flag(spark, folder):
    flag = labels.return_flag(F.col("transaction_type")).alias("is_return")
    return views.transactions(spark, folder).select("customer_id", "store_code", "revenue", flag)


@query(
    """SELECT store_code, CASE WHEN mall_name = 'STANDALONE' THEN 'Stand Alone Store' ELSE 'Mall Store' END
       AS store_format FROM fx_stores"""
)
def cnd_store_format(spark, folder):
    format_ = labels.store_format(F.col("mall_name")).alias("store_format")
    return views.stores(spark, folder).select("store_code", format_)


@query(
    """SELECT customer_id, store_code, revenue, return_reason,
              CASE WHEN return_reason IN ('Size Problem', 'Ordered wrong size', 'Fit Problem') THEN 'Size.Problem'
                   WHEN return_reason IN ('Mfg. Defect', 'Adhesive', 'Accessory/Trim', 'Zip Defect', 'Warranty',
                        'Squins/Button Detachment', 'Handling Defect', 'Motif/Print Defect',
                        'Material/Fabric Defect', 'Appearance Change After wash') THEN 'Mfg.Defect'
                   WHEN return_reason IN ('Gift Exchange', 'Color Exchange') THEN 'Others'
                   ELSE return_reason END AS return_group
       FROM fx_transactions"""
)
def cnd_collapse_levels(spark, folder):
    df = views.transactions(spark, folder).select("customer_id", "store_code", "revenue", "return_reason")
    return df.withColumn("return_group", labels.collapse(F.col("return_reason")))


@query(
    """SELECT customer_id, nationality, n_nationality,
              CASE WHEN n_nationality < 60 THEN 'Others' ELSE nationality END AS nationality_group
       FROM (SELECT customer_id, nationality, count(*) OVER (PARTITION BY nationality) AS n_nationality
             FROM fx_customers)"""
)
def cnd_lump_rare(spark, folder):
    df = views.customers(spark, folder).select("customer_id", "nationality")
    return fills.lump_rare(df, "nationality", "nationality_group", limit=60)


@query(
    f"""SELECT {KEY_SQL}, coalesce(state_code_residence, 8) AS state_code_residence FROM fx_bookings"""
)
def na_fill_const(spark, folder):
    df = views.bookings(spark, folder).select(*KEY, "state_code_residence")
    return fills.fill_constants(df, {"state_code_residence": booking_plan.HOME_STATE})


@query(
    f"""SELECT {KEY_SQL}, CAST(quarter(checkin_date) AS INTEGER) AS checkin_quarter,
               CASE WHEN season_holidayed_code IS NOT NULL THEN season_holidayed_code
                    WHEN quarter(checkin_date) = 2 THEN 2 WHEN quarter(checkin_date) = 3 THEN 4
                    WHEN quarter(checkin_date) = 4 THEN 2 END AS season_holidayed_code FROM fx_bookings"""
)
def na_fill_by_map(spark, folder):
    df = views.bookings(spark, folder).select(
        *KEY, F.quarter("checkin_date").alias("checkin_quarter"), "season_holidayed_code"
    )
    return fills.fill_by_map(
        df, "season_holidayed_code", "checkin_quarter", booking_plan.SEASON_OF_QUARTER
    )


@query(
    """SELECT customer_id, store_code, year, week, revenue, discount, units_sold,
              CASE WHEN revenue - 50000 > 0 THEN 1 ELSE 0 END AS above
       FROM fx_transactions"""
)
def cnd_threshold(spark, folder):
    above = labels.positive_flag(F.col("revenue") - 50000).alias("above")
    return views.transactions(spark, folder).select(
        "customer_id", "store_code", "year", "week", "revenue", "discount", "units_sold", above
    )


# ---- strings ----


@query(
    f"""SELECT {KEY_SQL}, CASE WHEN length(memberid) > 10 THEN substr(memberid, 1, 7) || '...' ELSE memberid END
               AS memberid FROM fx_bookings"""
)
def str_truncate(spark, folder):
    short = text.shorten(F.col("memberid"), 10).alias("memberid")
    return views.bookings(spark, folder).select(*KEY, short)


@query("SELECT store_code, regexp_replace(region, 'MX - ', '', 'g') AS region FROM fx_stores")
def str_strip_pattern(spark, folder):
    region = text.without(F.col("region"), labels.REGION_PREFIX).alias("region")
    return views.stores(spark, folder).select("store_code", region)


@query(
    """SELECT customer_id, parts[1] AS accr_date, parts[2] AS accr_hrs, parts[3] AS accr_min, parts[4] AS accr_sec,
              parts[5] AS accr_rest
       FROM (SELECT customer_id, string_split(last_accr_raw, ':') AS parts FROM fx_customers)"""
)
def str_separate(spark, folder):
    names = ["accr_date", "accr_hrs", "accr_min", "accr_sec", "accr_rest"]
    parts = {n: text.piece(F.col("last_accr_raw"), ":", i) for i, n in enumerate(names)}
    df = views.customers(spark, folder).select("customer_id", "last_accr_raw")
    return df.withColumns(parts).drop("last_accr_raw")


@query(
    """SELECT customer_id, concat(coalesce(nationality, 'NA'), '_', coalesce(job_type, 'NA'), '_',
              coalesce(income_range, 'NA')) AS profile FROM fx_customers"""
)
def str_paste(spark, folder):
    parts = [F.col(c) for c in ("nationality", "job_type", "income_range")]
    return views.customers(spark, folder).select("customer_id", text.glue("_", *parts).alias("profile"))


# ---- dates ----


@query(
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date, CAST(NULL AS DATE) AS bad_date FROM orders"""
)
def dt_parse_dmy(spark, folder):
    written = F.date_format("o_orderdate", "dd/MM/yy")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        # 1995-1999 return from two digits through the pivot year, 2000 and later directly
        calendar.parse_day_month_year(written).alias("order_date"),
        calendar.parse_day_month_year(F.concat(F.lit("x"), written)).alias("bad_date"),
    )


@query(
    """SELECT customer_id, CAST(strptime(split_part(last_accr_raw, ':', 1), '%d%b%Y') AS DATE) AS last_accr_date,
              CAST(strptime(split_part(birth_date_raw, ':', 1), '%d%b%Y') AS DATE) AS birth_date
       FROM fx_customers"""
)
def dt_parse_ddmonyyyy(spark, folder):
    return views.customers(spark, folder).select(
        "customer_id",
        calendar.parse_stamp(F.col("last_accr_raw")).alias("last_accr_date"),
        calendar.parse_stamp(F.col("birth_date_raw")).alias("birth_date"),
    )


@query(f"SELECT {KEY_SQL}, CAST(checkin_date - booking_date AS INTEGER) AS days FROM fx_bookings")
def dt_diff(spark, folder):
    days = calendar.days_between(F.col("checkin_date"), F.col("booking_date")).alias("days")
    return views.bookings(spark, folder).select(*KEY, days)


@query(
    f"""SELECT {KEY_SQL}, CAST(month(booking_date) AS INTEGER) AS booking_month,
               CAST(day(booking_date) AS INTEGER) AS booking_day,
               CAST(quarter(checkin_date) AS INTEGER) AS checkin_quarter,
               CAST(year(checkin_date) AS INTEGER) AS checkin_year FROM fx_bookings"""
)
def dt_parts(spark, folder):
    return views.bookings(spark, folder).select(
        *KEY,
        F.month("booking_date").alias("booking_month"),
        F.dayofmonth("booking_date").alias("booking_day"),
        F.quarter("checkin_date").alias("checkin_quarter"),
        F.year("checkin_date").alias("checkin_year"),
    )


@query(
    f"""SELECT {KEY_SQL}, dayname(booking_date) AS booking_d, dayname(checkin_date) AS checkin_d,
               dayname(checkout_date) AS checkout_d FROM fx_bookings"""
)
def dt_weekday(spark, folder):
    days = {"booking_d": "booking_date", "checkin_d": "checkin_date", "checkout_d": "checkout_date"}
    return views.bookings(spark, folder).select(
        *KEY, *[calendar.day_name(F.col(c)).alias(name) for name, c in days.items()]
    )


@query(f"SELECT {KEY_SQL}, isodow(checkin_date) >= 6 AS checkin_weekend FROM fx_bookings")
def dt_weekend(spark, folder):
    weekend = calendar.is_weekend(F.col("checkin_date")).alias("checkin_weekend")
    return views.bookings(spark, folder).select(*KEY, weekend)


@query(
    """SELECT customer_id, store_code, revenue, year, week, week_start_raw AS week_start FROM v_enriched_all"""
)
def dt_week_start(spark, folder):
    df = views.transactions(spark, folder).select("customer_id", "store_code", "revenue", "year", "week")
    return df.withColumn("week_start", calendar.week_start(F.col("year"), F.col("week")))


_REPAIRED_SQL = """CASE WHEN week_start_raw IS NOT NULL THEN week_start_raw
                        WHEN year = 1997 AND week = 0 THEN DATE '1997-01-06' END"""


def _with_week_start(spark, folder):
    df = views.transactions(spark, folder).select("customer_id", "store_code", "revenue", "year", "week")
    start = calendar.week_start_repaired(F.col("year"), F.col("week"), WEEK_REPAIRS)
    return df.withColumn("week_start", start)


@query(
    f"SELECT customer_id, store_code, revenue, year, week, {_REPAIRED_SQL} AS week_start FROM v_enriched_all"
)
def dt_week_start_repaired(spark, folder):
    return _with_week_start(spark, folder)


@query(
    f"""SELECT customer_id, store_code, revenue, coalesce(CAST(year(d) AS VARCHAR), 'NA') || '-' ||
               coalesce(CAST(quarter(d) AS VARCHAR), 'NA') AS year_quarter
        FROM (SELECT *, {_REPAIRED_SQL} AS d FROM v_enriched_all)"""
)
def dt_year_quarter(spark, folder):
    label = calendar.year_quarter(F.col("week_start")).alias("year_quarter")
    return _with_week_start(spark, folder).select("customer_id", "store_code", "revenue", label)


@query(
    f"""SELECT customer_id, store_code, revenue, strftime(d, '%Y-%m') AS y_m
        FROM (SELECT *, {_REPAIRED_SQL} AS d FROM v_enriched_all)"""
)
def dt_year_month(spark, folder):
    label = calendar.year_month(F.col("week_start")).alias("y_m")
    return _with_week_start(spark, folder).select("customer_id", "store_code", "revenue", label)


@query(
    """SELECT store_code, CAST(DATE '2018-03-01' - store_launch_date AS INTEGER) AS store_age FROM fx_stores"""
)
def dt_age_at(spark, folder):
    age = calendar.age_in_days(F.col("store_launch_date")).alias("store_age")
    return views.stores(spark, folder).select("store_code", age)


# ---- arithmetic ----


@query(
    """SELECT customer_id, store_code, revenue, CAST(revenue + discount AS DOUBLE) AS gross,
              units_sold - item_count AS extra_items FROM fx_transactions"""
)
def mth_derive_amounts(spark, folder):
    return views.transactions(spark, folder).select(
        "customer_id",
        "store_code",
        "revenue",
        (F.col("revenue") + F.col("discount")).cast("double").alias("gross"),
        (F.col("units_sold") - F.col("item_count")).alias("extra_items"),
    )


CLEAN_STORES_SQL = """
    SELECT store_code, replace(region, 'MX - ', '') AS region, store_launch_date, total_revenue, sales_per_day,
           store_size_sq_ft, train_test_store,
           CASE WHEN mall_name = 'STANDALONE' THEN 'Stand Alone Store' ELSE 'Mall Store' END AS store_format,
           CAST(DATE '2018-03-01' - store_launch_date AS INTEGER) AS store_age,
           CAST(total_revenue AS DOUBLE) / nullif(DATE '2018-03-01' - store_launch_date, 0) AS rev_age,
           sales_per_day / nullif(store_size_sq_ft, 0) AS rev_sqft
    FROM fx_stores"""


@query(f"SELECT store_code, rev_age, rev_sqft FROM ({CLEAN_STORES_SQL})")
def mth_ratios(spark, folder):
    df = views.stores(spark, folder)
    age = calendar.age_in_days(F.col("store_launch_date"))
    return df.select(
        "store_code",
        arithmetic.ratio(F.col("total_revenue"), age).alias("rev_age"),
        arithmetic.ratio(F.col("sales_per_day"), F.col("store_size_sq_ft")).alias("rev_sqft"),
    )


@query(
    """SELECT l_orderkey, l_linenumber, l_extendedprice * 0.55::DOUBLE + l_quantity * 0.4::DOUBLE + l_tax * 0.05::DOUBLE
       AS blend FROM lineitem"""
)
def ml_blend(spark, folder):
    parts = [F.col(c) for c in ("l_extendedprice", "l_quantity", "l_tax")]
    mixed = arithmetic.blend(parts).alias("blend")
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", mixed)


# ---- cleaned tables ----


@query(
    """SELECT customer_id, birth_date, last_accr_date, nationality, n_nationality, job_type, income_range, points,
              state, CASE WHEN g = 'Unspecified' THEN 'UNDEFINED' ELSE g END AS nationality_group
       FROM (SELECT *, CASE WHEN n_nationality < 60 THEN 'Others' ELSE nationality END AS g
             FROM (SELECT customer_id, nationality, points, state,
                          CAST(strptime(split_part(coalesce(birth_date_raw, '01JAN1900:00:00:00'), ':', 1), '%d%b%Y')
                               AS DATE) AS birth_date,
                          CAST(strptime(split_part(last_accr_raw, ':', 1), '%d%b%Y') AS DATE) AS last_accr_date,
                          job_type,
                          CASE WHEN income_range = 'Unknown' THEN 'Unspecified' ELSE income_range END
                          AS income_range,
                          count(*) OVER (PARTITION BY nationality) AS n_nationality
                   FROM fx_customers))"""
)
def clean_customers(spark, folder):
    return retail.clean_customers(views.customers(spark, folder), rare_limit=60)


@query(CLEAN_STORES_SQL)
def clean_stores(spark, folder):
    return retail.clean_stores(views.stores(spark, folder))
