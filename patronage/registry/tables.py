"""Sources, joins, stacking, reshaping, and the retail and booking jobs."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import functions as F

from patronage.functions.labels import RETURN_REASON_GROUPS, positive_flag
from patronage.operators import columns, encode, joins, reshape
from patronage.plans import bookings as booking_plan
from patronage.plans import retail, rfm
from patronage.registry.core import query
from patronage.registry.rows import WEEK_REPAIRS
from patronage.session import durable, fresh_folder
from patronage.sources import delimited, published, tables, views

KEY = views.BOOKING_KEY
KEY_SQL = ", ".join(KEY)
YEARS = (1996, 1997)
TYPES = ("Purchase", "Return")
REASONS = [*RETURN_REASON_GROUPS, "No Return"]
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")  # fixed values: the region table's names


def safe(label: str) -> str:
    """A pivot label as a plain column name."""
    return "c_" + re.sub(r"\W+", "_", label).lower()


def _safe_columns(df, labels_):
    return df.withColumnsRenamed({label: safe(label) for label in labels_})


# ---- sources ----


@query(
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in tables.TABLES)
)
def src_load_tables(spark, folder):
    return tables.row_counts(spark, folder)


@query("SELECT * FROM fx_customers")
def src_csv_roundtrip(spark, folder):
    df = views.customers(spark, folder)
    path = fresh_folder(spark, "customers-csv")
    delimited.write_delimited(df, path)
    return delimited.read_delimited(spark, path, df.schema)


@query(
    """SELECT doc_id, '  "' || source || '", ' || text || chr(10) || 'end ' AS text FROM documents"""
)
def src_csv_text_roundtrip(spark, folder):
    """Whole texts with quotes, commas, padding and line breaks."""
    text = F.concat(F.lit('  "'), "source", F.lit('", '), "text", F.lit("\nend "))
    df = tables.table(spark, folder, "documents").select("doc_id", text.alias("text"))
    path = fresh_folder(spark, "texts-csv")
    delimited.write_delimited(df, path)
    return delimited.read_delimited(spark, path, df.schema)


# ---- joins ----


@query(
    f"""SELECT {KEY_SQL}, b.season_holidayed_code, b.resort_type_code, n, mean_pax
        FROM fx_bookings b LEFT JOIN (
             SELECT season_holidayed_code, resort_type_code, count(*) AS n,
                    CAST(sum(total_pax) AS DOUBLE) / count(*) AS mean_pax
             FROM fx_bookings WHERE is_train = 1 GROUP BY 1, 2) s
        ON b.season_holidayed_code IS NOT DISTINCT FROM s.season_holidayed_code
       AND b.resort_type_code IS NOT DISTINCT FROM s.resort_type_code"""
)
def jn_natural_left_nullsafe(spark, folder):
    df = views.bookings(spark, folder)
    keys = ["season_holidayed_code", "resort_type_code"]
    stats = (
        df.where(F.col("is_train") == 1)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            (F.sum("total_pax").cast("double") / F.count("total_pax")).alias("mean_pax"),
        )
    )
    return joins.natural_left_join(df.select(*KEY, *keys), durable(stats))


@query(
    """SELECT customer_id, CAST(recency AS INTEGER) AS recency, frequency, CAST(monetary AS DOUBLE) AS monetary
       FROM v_rfm"""
)
def jn_left_chain(spark, folder):
    base = rfm.base(views.customers(spark, folder), views.transactions(spark, folder))
    return base.withColumn("monetary", F.col("monetary").cast("double"))


@query(
    """SELECT t.customer_id, t.store_code, t.revenue, s.region, s.train_test_store, c.state, c.points
       FROM fx_transactions t JOIN fx_stores s ON t.store_code = s.store_code
       JOIN fx_customers c ON t.customer_id = c.customer_id"""
)
def jn_inner_dims(spark, folder):
    facts = views.transactions(spark, folder).select("customer_id", "store_code", "revenue")
    out = joins.join_dimension(
        facts, views.stores(spark, folder), "store_code", ["region", "train_test_store"]
    )
    return joins.join_dimension(out, views.customers(spark, folder), "customer_id", ["state", "points"])


@query(
    """SELECT p.customer_id, CAST(p.store_code AS BIGINT) AS store_code, a.frequency
       FROM fx_test_pairs p LEFT JOIN v_rfm a ON p.customer_id = a.customer_id"""
)
def jn_left_submission(spark, folder):
    activity = rfm.activity(views.transactions(spark, folder)).select("customer_id", "frequency")
    pairs = views.test_pairs(spark, folder).withColumn("store_code", F.col("store_code").cast("long"))
    return pairs.join(activity, "customer_id", "left")


@query(f"SELECT {KEY_SQL}, is_train, amount FROM fx_bookings")
def set_union_by_name(spark, folder):
    df = views.bookings(spark, folder)
    train, test = columns.split_by_flag(df, "is_train")
    train = train.select(*KEY, "amount").withColumn("is_train", F.lit(1))
    test = test.select(*KEY).withColumn("is_train", F.lit(0))
    return columns.stack(train, test)


# ---- reshaping ----


def _cases(labels_, label_sql: str, cell: str, prefix: str = "") -> str:
    return ", ".join(
        cell.format(condition=f"{label_sql} = '{label}'") + f' AS "{prefix}{safe(label)}"' for label in labels_
    )


def _enriched(spark, folder):
    return retail.enrich_transactions(
        views.transactions(spark, folder),
        retail.clean_stores(views.stores(spark, folder)),
        retail.clean_customers(views.customers(spark, folder), rare_limit=60),
        YEARS,
        WEEK_REPAIRS,
    )


QUARTER_TYPES = retail.pairs_of(retail.quarters(YEARS), TYPES)
YEAR_TYPES = retail.pairs_of(YEARS, TYPES)
QUARTER_REASONS = retail.pairs_of(retail.quarters(YEARS), REASONS)


@query(
    f"""SELECT customer_id, {_cases(QUARTER_TYPES, "label", "count(CASE WHEN {condition} THEN 1 END)")}
        FROM (SELECT *, year_quarter || '_' || transaction_type AS label FROM v_enriched) GROUP BY customer_id"""
)
def rsh_pivot_counts(spark, folder):
    wide = retail.customer_quarter_counts(_enriched(spark, folder), QUARTER_TYPES)
    return _safe_columns(wide, QUARTER_TYPES)


@query(
    f"""SELECT region, {_cases(YEAR_TYPES, "label", "CAST(sum(CASE WHEN {condition} THEN gross END) AS DOUBLE)")}
        FROM (SELECT *, year || '_' || transaction_type AS label FROM v_enriched) GROUP BY region"""
)
def rsh_pivot_sum(spark, folder):
    wide = retail.region_year_gross(_enriched(spark, folder), YEAR_TYPES)
    wide = columns.across(wide, YEAR_TYPES, lambda c: c.cast("double"))
    return _safe_columns(wide, YEAR_TYPES)


_MEAN_CELL = (
    "CAST(sum(CASE WHEN {condition} THEN gross END) AS DOUBLE) / nullif(count(CASE WHEN {condition} THEN gross END), 0)"
)


@query(
    f"""SELECT store_code, {_cases(QUARTER_TYPES, "label", _MEAN_CELL, "n_avg_")}
        FROM (SELECT *, year_quarter || '_' || transaction_type AS label FROM v_enriched) GROUP BY store_code"""
)
def rsh_pivot_mean_prefixed(spark, folder):
    wide = retail.store_quarter_means(_enriched(spark, folder), QUARTER_TYPES, prefix="")
    return columns.prefix_all_but(_safe_columns(wide, QUARTER_TYPES), ["store_code"], "n_avg_")


_SHARE_CELL = "coalesce(max(CASE WHEN {condition} THEN percent END), 0)"


@query(
    f"""SELECT region, {_cases(REASONS, "return_group", _SHARE_CELL)}
        FROM (SELECT region, return_group, CAST(items AS DOUBLE) / sum(items) OVER (PARTITION BY region) AS percent
              FROM (SELECT region, return_group, CAST(sum(item_count) AS BIGINT) AS items FROM v_enriched
                    WHERE transaction_type = 'Return' GROUP BY region, return_group)) GROUP BY region"""
)
def rsh_return_share_region(spark, folder):
    return _safe_columns(retail.region_reason_shares(_enriched(spark, folder), REASONS), REASONS)


_QUARTER_SHARES = """
    SELECT region, items AS total_return, year_quarter || '_' || return_group AS label,
           CAST(items AS DOUBLE) / sum(items) OVER (PARTITION BY region, year_quarter) AS percent
    FROM (SELECT region, year_quarter, return_group, CAST(sum(item_count) AS BIGINT) AS items FROM v_enriched
          WHERE transaction_type = 'Return' GROUP BY region, year_quarter, return_group)"""


@query(
    f"""SELECT region, total_return, {_cases(QUARTER_REASONS, "label", _SHARE_CELL)}
        FROM ({_QUARTER_SHARES}) GROUP BY region, total_return"""
)
def rsh_return_share_quarter(spark, folder):
    wide = retail.region_quarter_reason_shares(_enriched(spark, folder), QUARTER_REASONS)
    return _safe_columns(wide, QUARTER_REASONS)


@query(
    f"""SELECT region, {_cases(QUARTER_REASONS, "label", _SHARE_CELL)} FROM ({_QUARTER_SHARES}) GROUP BY region"""
)
def rsh_return_share_quarter_by_region(spark, folder):
    wide = retail.region_quarter_reason_shares(_enriched(spark, folder), QUARTER_REASONS, keep_total=False)
    return _safe_columns(wide, QUARTER_REASONS)


def _customer_region(spark, folder):
    """Customer by region revenue, zero where nothing was bought."""
    sales = joins.join_dimension(
        views.transactions(spark, folder).select("customer_id", "store_code", "revenue"),
        retail.clean_stores(views.stores(spark, folder)),
        "store_code",
        ["region"],
    )
    wide = reshape.spread(sales, ["customer_id"], "region", REGIONS, F.sum("revenue"))
    wide = columns.across(wide, REGIONS, lambda c: c.cast("double"))
    return _safe_columns(wide, REGIONS)


_CUSTOMER_REGION_SQL = f"""
    SELECT customer_id, {_cases(REGIONS, "region", "CAST(sum(CASE WHEN {condition} THEN revenue END) AS DOUBLE)")}
    FROM (SELECT customer_id, revenue, replace(region, 'MX - ', '') AS region
          FROM fx_transactions t JOIN fx_stores s ON t.store_code = s.store_code) GROUP BY customer_id"""


@query(_CUSTOMER_REGION_SQL)
def rsh_customer_region_matrix(spark, folder):
    return _customer_region(spark, folder)


@query(
    " UNION ALL ".join(
        f"SELECT customer_id, '{safe(r)}' AS region, {safe(r)} AS revenue FROM ({_CUSTOMER_REGION_SQL})"
        for r in REGIONS
    )
)
def rsh_unpivot(spark, folder):
    wide = _customer_region(spark, folder)
    return reshape.gather(wide, ["customer_id"], [safe(r) for r in REGIONS], "region", "revenue")


@query(
    " UNION ALL ".join(
        f"""SELECT customer_id, '{safe(r)}' AS region, CASE WHEN {safe(r)} > 0 THEN 1 WHEN {safe(r)} <= 0 THEN 0 END
            AS bought FROM ({_CUSTOMER_REGION_SQL})"""
        for r in REGIONS
    )
)
def cnd_threshold_unpivoted(spark, folder):
    wide = _customer_region(spark, folder)
    long = reshape.gather(wide, ["customer_id"], [safe(r) for r in REGIONS], "region", "revenue")
    return long.select("customer_id", "region", positive_flag(F.col("revenue")).alias("bought"))


@query(
    """SELECT customer_id, CAST(count(*) AS INTEGER) AS stores,
              string_agg(store_code || ':' || value, ' ' ORDER BY store_code) AS row_text
       FROM (SELECT customer_id, store_code, sum(value) AS value FROM (
                 SELECT customer_id, store_code, sum(revenue) AS value FROM fx_transactions GROUP BY ALL
                 UNION ALL SELECT customer_id, CAST(store_code AS BIGINT), 0 FROM fx_test_pairs) GROUP BY ALL)
       GROUP BY customer_id"""
)
def rsh_customer_store_matrix(spark, folder):
    bought = views.transactions(spark, folder).select("customer_id", "store_code", F.col("revenue").alias("value"))
    asked = views.test_pairs(spark, folder).select(
        "customer_id", F.col("store_code").cast("long").alias("store_code"), F.lit(0).cast("decimal(18,2)").alias("value")
    )
    rows = reshape.sparse_rows(columns.stack(bought, asked), "customer_id", "store_code", "value")
    text = F.transform(
        F.arrays_zip("columns", "cells"),
        lambda c: F.concat_ws(":", c["columns"].cast("string"), c["cells"].cast("string")),
    )
    return rows.select("customer_id", F.size("columns").alias("stores"), F.array_join(text, " ").alias("row_text"))


# ---- retail reports ----


@query(
    """SELECT customer_id, store_code, region, store_format, sales_per_day, state, points, nationality_group,
              transaction_type, return_reason, return_group, year, week, week_start, year_quarter, y_m, is_return, item_count, units_sold,
              extra_items, revenue, discount, CAST(gross AS DOUBLE) AS gross FROM v_enriched"""
)
def enrich_transactions(spark, folder):
    return _enriched(spark, folder).withColumn("gross", F.col("gross").cast("double"))


@query("SELECT return_group, CAST(sum(gross) AS DOUBLE) AS total_return FROM v_enriched GROUP BY return_group")
def returns_by_reason(spark, folder):
    totals = retail.returns_by_reason(_enriched(spark, folder))
    return totals.withColumn("total_return", F.col("total_return").cast("double"))


@query(
    """SELECT customer_id, store_code, CAST(sum(gross) AS DOUBLE) AS rev,
              CAST(sum(extra_items) AS BIGINT) AS extra_items FROM v_enriched GROUP BY customer_id, store_code"""
)
def agg_customer_store_extra(spark, folder):
    totals = retail.customer_store_totals(_enriched(spark, folder))
    return totals.withColumn("rev", F.col("rev").cast("double"))


@query(
    """SELECT state, region, count(*) AS n FROM v_enriched WHERE region IN ('ASIA', 'EUROPE', 'AFRICA')
       GROUP BY state, region"""
)
def agg_state_region(spark, folder):
    return retail.home_state_by_region(_enriched(spark, folder), ["ASIA", "EUROPE", "AFRICA"])


# ---- scoring ----

_SCORE_COLUMNS = "customer_id, CAST(recency AS INTEGER) AS recency, frequency, CAST(monetary AS DOUBLE) AS monetary, r, f, m, rfm_code, agg_score"


def _scored(spark, folder):
    base = rfm.base(views.customers(spark, folder), views.transactions(spark, folder))
    return rfm.score(base)


@query(f"SELECT {_SCORE_COLUMNS} FROM v_scored")
def rfm_score(spark, folder):
    scored = _scored(spark, folder).drop("prediction")
    return scored.withColumn("monetary", F.col("monetary").cast("double"))


@query("SELECT customer_id, r, f, m, prediction FROM v_scored")
def rfm_predict(spark, folder):
    return _scored(spark, folder).select("customer_id", "r", "f", "m", "prediction")


_SUBMISSION_SQL = """
    SELECT p.customer_id, CAST(p.store_code AS DOUBLE) AS store_code, CAST(s.prediction AS DOUBLE) AS prediction
    FROM fx_test_pairs p LEFT JOIN v_scored s ON p.customer_id = s.customer_id"""


@query(_SUBMISSION_SQL)
def rfm_published(spark, folder):
    """The scoring job to its end: the submission published under a stamped name, and read back by its manifest."""
    data = [views.customers(spark, folder), views.transactions(spark, folder), views.test_pairs(spark, folder)]
    path = rfm.run(*data, fresh_folder(spark, "results"), dt.datetime.now())
    return published.read_published(spark, path)


@query(_SUBMISSION_SQL)
def rfm_submission(spark, folder):
    return rfm.submission(views.test_pairs(spark, folder), _scored(spark, folder))


# ---- booking features ----

_ENCODING_JOINS = "\n".join(
    f"""LEFT JOIN (SELECT {", ".join(keys)}, count(*) AS {p}_spent, CAST(min(amount) AS DOUBLE) / count(*) AS {p}_min,
                   CAST(max(amount) AS DOUBLE) / count(*) AS {p}_max,
                   CAST(sum(amount) AS DOUBLE) / count(*) / count(*) AS {p}_avg
            FROM v_cleaned_bookings WHERE is_train = 1 GROUP BY {", ".join(keys)}) {p}
        ON {" AND ".join(f"b.{k} IS NOT DISTINCT FROM {p}.{k}" for k in keys)}"""
    for p, keys in booking_plan.ENCODINGS.items()
)
_FEATURES = ", ".join(
    [
        *[
            f"b.{c}"
            for c in (
                *KEY, "memberid", "is_train", "booking_date", "checkin_date", "checkout_date", "roomnights",
                "total_pax", "numberofadults", "numberofchildren", "season_holidayed_code",
                "state_code_residence", "state_code_resort", "resort_region_code", "resort_type_code",
                "cluster_code", "member_age_buckets", "room_type_booked_code", "reservationstatusid_code",
                "amount", "advance_booking", "booking_month", "booking_day", "checkin_month", "checkin_day",
                "booking_d", "checkin_d", "checkout_d", "checkin_quarter", "checkin_weekend", "pax",
                "room_stay", "adv_booking",
            )
        ],
        "max(total_pax) OVER m AS max_total_pax", "min(total_pax) OVER m AS min_total_pax",
        "max(roomnights) OVER m AS max_roomnight", "min(roomnights) OVER m AS min_roomnight",
        "count(*) OVER m AS total_visit",
        "max(numberofadults) OVER m AS max_adult", "min(numberofadults) OVER m AS min_adult",
        "max(numberofchildren) OVER m AS max_children", "min(numberofchildren) OVER m AS min_children",
        "max(roomnights) OVER r AS max_roomnight_rrc", "min(roomnights) OVER r AS min_roomnight_rrc",
        "count(*) OVER r AS total_visit_rrc", "min(numberofadults) OVER r AS min_adult_rrc",
        "max(numberofchildren) OVER r AS max_children_rrc", "min(numberofchildren) OVER r AS min_children_rrc",
        *[f"{p}_{m}" for p in booking_plan.ENCODINGS for m in ("spent", "min", "max", "avg")],
    ]
)


@query(
    f"""SELECT {_FEATURES} FROM v_cleaned_bookings b {_ENCODING_JOINS}
        WINDOW m AS (PARTITION BY memberid), r AS (PARTITION BY memberid, resort_region_code, resort_type_code)"""
)
def booking_features(spark, folder):
    return booking_plan.features(views.bookings(spark, folder))


# ---- encodings of stores ----


@query(
    """SELECT store_code, region, mall_name, CAST(dense_rank() OVER (ORDER BY region) - 1 AS INTEGER) AS region_index,
              CAST(dense_rank() OVER (ORDER BY mall_name) - 1 AS INTEGER) AS mall_name_index FROM fx_stores"""
)
def feat_index(spark, folder):
    df = views.stores(spark, folder).select("store_code", "region", "mall_name")
    indexed = encode.level_index(df, ["region", "mall_name"])
    return indexed.withColumns({f"{c}_index": F.col(f"{c}_index").cast("int") for c in ("region", "mall_name")})


@query("SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_name) - 1 AS c_name_index FROM customer")
def feat_index_unique(spark, folder):
    """A column with a level of its own in every row."""
    df = tables.table(spark, folder, "customer").select("c_custkey", "c_name")
    return encode.level_index(df, ["c_name"])


@query(
    "SELECT store_code, region, "
    + ", ".join(f"CASE WHEN region = 'MX - {r}' THEN 1 ELSE 0 END AS region_{i}" for i, r in enumerate(REGIONS))
    + " FROM fx_stores"
)
def feat_one_hot(spark, folder):
    df = views.stores(spark, folder).select("store_code", "region")
    return encode.one_hot(df, "region", [f"MX - {r}" for r in REGIONS], "region")


_SCALED = ("store_size_sq_ft", "sales_per_day", "total_revenue")


@query(
    "SELECT store_code, "
    + ", ".join(
        f"""round((CAST({c} AS DOUBLE) - min(CAST({c} AS DOUBLE)) OVER ())
             / (max(CAST({c} AS DOUBLE)) OVER () - min(CAST({c} AS DOUBLE)) OVER ()), 6) AS {c}_range"""
        for c in _SCALED
    )
    + " FROM fx_stores"
)
def feat_range_scale(spark, folder):
    scaled = encode.range_scale(views.stores(spark, folder), _SCALED)
    return scaled.select("store_code", *[F.round(f"{c}_range", 6).alias(f"{c}_range") for c in _SCALED])


@query(
    "SELECT store_code, "
    + ", ".join(
        f"round(CAST({c} AS DOUBLE) / stddev_samp(CAST({c} AS DOUBLE)) OVER (), 6) AS {c}_sd" for c in _SCALED
    )
    + " FROM fx_stores"
)
def feat_sd_scale(spark, folder):
    scaled = encode.sd_scale(views.stores(spark, folder), _SCALED)
    return scaled.select("store_code", *[F.round(f"{c}_sd", 6).alias(f"{c}_sd") for c in _SCALED])
