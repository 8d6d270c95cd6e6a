"""Physical plans: no single-task sort of rows, no shuffle of rows joined with a small table."""

import datetime as dt

from pyspark.sql import functions as F

from patronage.operators import fills, joins, ranking
from patronage.plans import bookings as booking_plan
from patronage.plans import retail
from patronage.registry import QUERIES
from patronage.sources import delimited, views


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_position_join_keeps_rows_in_place(spark):
    df = spark.range(1000).withColumn("x", F.col("id") % 10)
    placed = ranking.global_position(df, [F.col("x").asc(), F.col("id").asc()], "position")
    text = plan(placed)
    assert "BroadcastHashJoin" in text
    # the one single-partition exchange is that of the row counts per partition, below the broadcast
    assert text.count("Exchange SinglePartition") <= 1
    assert text.index("BroadcastExchange") < text.index("Exchange SinglePartition")


def test_group_statistics_use_no_window(spark, small):
    for name in ("win_group_count", "win_member_stats", "win_member_region_stats", "cnd_lump_rare"):
        assert "Window" not in plan(QUERIES[name](spark, small)), name


def test_small_statistics_are_joined_without_shuffling_the_rows(spark, small):
    text = plan(booking_plan.features(views.bookings(spark, small)))
    assert "SortMergeJoin" not in text and "hashpartitioning" not in text


def test_scan_reads_only_what_is_asked(spark, small):
    text = plan(QUERIES["agg_customer_store_sum"](spark, small))
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_extendedprice:double>" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text


def test_year_filter_reaches_below_the_joins(spark, small):
    text = plan(QUERIES["enrich_transactions"](spark, small))
    lines = [line for line in text.splitlines() if "Filter" in line and "year" in line.lower()]
    assert lines and all("Join" not in line for line in lines)


def test_top_n_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("n"))
    text = plan(ranking.group_cuts(df, "n", ["g"], 3))
    assert "WindowGroupLimit" in text and "Partial" in text
    assert "TakeOrderedAndProject" in plan(df.orderBy(F.desc("n")).limit(3))


def test_hot_group_statistics_are_whole(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, 0).otherwise(F.col("id")).alias("g"),
        F.col("id"),
    )
    out = joins.attach_group_stats(df, ["g"], {"n": F.count(F.lit(1)), "top": F.max("id")}).collect()
    assert len(out) == 3000
    assert {(r.n, r.top) for r in out if r.g is None} == {(1000, 2997)}
    assert {(r.n, r.top) for r in out if r.g == 0} == {(1000, 2998)}
    assert all(r.n == 1 for r in out if r.g not in (None, 0))


def test_shuffled_join_gives_the_same_statistics(spark, small):
    """Beyond the broadcast threshold the same call shuffles, with equal results."""
    df = views.bookings(spark, small)
    few = sorted(map(str, booking_plan.features(df).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = booking_plan.features(df)
        assert "SortMergeJoin" in plan(shuffled)
        assert sorted(map(str, shuffled.collect())) == few
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_members_with_equal_cut_ids_share_statistics(spark, small):
    bookings = views.bookings(spark, small).withColumn("memberid", F.concat(F.lit("member-number-"), "memberid"))
    cut = booking_plan.features(bookings, id_width=10)
    assert [r[0] for r in cut.select("memberid").distinct().collect()] == ["member-..."]
    visits = bookings.count()
    assert cut.where(F.col("total_visit") != visits).count() == 0


def test_encodings_are_ordered(spark, small):
    cleaned = booking_plan.clean(views.bookings(spark, small))
    for prefix, table in booking_plan.encodings(cleaned, "amount").items():
        wrong = table.where(
            (F.col(f"{prefix}_min") > F.col(f"{prefix}_avg") + 1e-9)
            | (F.col(f"{prefix}_avg") > F.col(f"{prefix}_max") + 1e-9)
        )
        assert wrong.count() == 0


def test_booking_dates_from_text(spark):
    df = spark.createDataFrame([("05/04/18", "07/04/18", "31/02/18")], "booking_date string, checkin_date string, checkout_date string")
    row = booking_plan.parse_dates(df).first()
    assert tuple(row) == (dt.date(2018, 4, 5), dt.date(2018, 4, 7), None)


def test_unknown_lead_time_stays_unknown(spark):
    day = dt.date(2018, 4, 5)
    df = spark.createDataFrame([(day, None), (day, dt.date(2018, 4, 1)), (day, dt.date(2018, 4, 9))], "booking_date date, checkin_date date")
    rows = booking_plan.repair_lead(df).collect()
    assert [r.advance_booking for r in rows] == [None, 0, 4]
    assert [r.booking_date for r in rows] == [day, dt.date(2018, 4, 1), day]


def test_store_means_carry_their_prefix(spark):
    df = spark.createDataFrame([(1, "2016-1", "Return", 2), (1, "2016-1", "Return", 4)], "store_code int, year_quarter string, transaction_type string, gross int")
    wide = retail.store_quarter_means(df, ["2016-1_Return"])
    assert [tuple(r) for r in wide.collect()] == [(1, 3.0)]
    assert wide.columns == ["store_code", "n.AVG_2016-1_Return"]


def test_delimited_reads_empty_and_na_as_missing(spark, tmp_path):
    df = spark.createDataFrame([("x y", 1), (None, None), ("a,b", 3), ("", 4)], "s string, n int")
    path = delimited.stamped(str(tmp_path), "out", dt.datetime(2018, 1, 2, 3, 4, 5))
    assert path.endswith("out_20180102030405")
    delimited.write_delimited(df, path)
    assert any("NA,NA" in line for line in spark.read.text(path).toPandas()["value"])
    back = delimited.read_delimited(spark, path, df.schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(
        [("x y", 1), (None, None), ("a,b", 3), (None, 4)], key=str
    )


def test_constant_measure_fills(spark):
    df = spark.createDataFrame([(None,), (None,)], "x int")
    assert [r.x for r in fills.fill_with_max(df, "x").collect()] == [None, None]


def test_adaptive_execution_splits_a_hot_group(spark):
    """A group with a third of the rows, beyond the broadcast threshold: its partition is cut up."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        df = spark.range(0, 200_000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("g"), F.col("id")
        )
        out = joins.attach_group_stats(df, ["g"], {"n": F.count(F.lit(1))})
        assert {r["n"]: r["count"] for r in out.groupBy("n").count().collect()} == {66_667: 66_667, 1: 133_333}
        # its own execution, since a grouped result hides the join below another exchange
        out.write.format("noop").mode("overwrite").save()
        out.collect()
        assert "skew=true" in plan(out)
    finally:
        for name in settings:
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_sources_with_more_columns(spark):
    """Columns the cleaned tables do not keep are dropped where a source has them."""
    stores = spark.createDataFrame(
        [(1, "MX - Dubai", "STANDALONE", "name", "geo", dt.datetime(2018, 2, 1), 280.0, 10.0, 5)],
        "store_code long, region string, mall_name string, store_name string, geo_field string, "
        "store_launch_date timestamp_ntz, total_revenue double, sales_per_day double, store_size_sq_ft int",
    )
    row = retail.clean_stores(stores).first()
    assert (row.region, row.store_format, row.store_age, row.rev_age, row.rev_sqft) == (
        "Dubai", "Stand Alone Store", 28, 10.0, 2.0,
    )
    assert not {"mall_name", "store_name", "geo_field"} & set(row.asDict())
    bookings = spark.createDataFrame([("resort-number-1",)], "resort_id string")
    cut = bookings.select(F.col("resort_id"))
    assert booking_plan.across(cut, ["resort_id"], lambda c: booking_plan.shorten(c, 10)).first()[0] == "resort-..."
