"""The rules on missing values that SQL does not give by itself, on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from patronage.functions import arithmetic, calendar, labels, missing, text
from patronage.operators import aggregate, fills, joins, profile, ranking, reshape
from patronage.plans import retail
from patronage.sources import delimited


def values(df, *names):
    return [tuple(row[n] for n in names) for row in df.collect()]


def tiny(spark):
    return spark.createDataFrame(
        [(1, "a", 1.0), (2, "a", None), (3, "b", 5.0), (None, "b", 7.0), (5, None, 2.0), (6, "c", None)],
        "k int, g string, v double",
    )


def test_strict_and_skipping_sums(spark):
    df = tiny(spark)
    strict = dict(values(aggregate.grouped_sum(df, ["g"], F.col("v"), "s"), "g", "s"))
    skipping = dict(values(aggregate.grouped_sum(df, ["g"], F.col("v"), "s", skip_missing=True), "g", "s"))
    assert strict == {"a": None, "b": 12.0, None: 2.0, "c": None}
    assert skipping == {"a": 1.0, "b": 12.0, None: 2.0, "c": None}


def test_join_matches_null_to_null(spark):
    left = spark.createDataFrame([(1, "a", 10), (None, "a", 20), (3, None, 30)], "k int, g string, v int")
    right = spark.createDataFrame([(1, "a", 100), (None, "a", 200), (4, "z", 300)], "k int, g string, w int")
    joined = joins.natural_left_join(left, right)
    assert joined.columns == ["k", "g", "v", "w"]
    assert sorted(values(joined, "v", "w")) == [(10, 100), (20, 200), (30, None)]


def test_negated_membership_keeps_nulls(spark):
    kept = tiny(spark).where(missing.not_among(F.col("g"), ["a"]))
    assert sorted(r.k or 0 for r in kept.collect()) == [0, 3, 5, 6]


def test_if_else_keeps_unknown_and_bins_do_not(spark):
    df = spark.createDataFrame([("Return",), ("Purchase",), (None,)], "t string")
    assert [r[0] for r in df.select(labels.return_flag(F.col("t"))).collect()] == [1, 0, None]
    people = spark.createDataFrame([(0,), (2,), (3,), (5,), (None,)], "n int")
    found = [r[0] for r in people.select(labels.party_size(F.col("n"))).collect()]
    assert found == ["others", "couple", "family", "others", "family"]
    nights = spark.createDataFrame([(2,), (4,), (7,), (8,), (None,)], "n int")
    found = [r[0] for r in nights.select(labels.stay_length(F.col("n"))).collect()]
    assert found == ["VShort", "Normal", "Week", "Long", None]


def test_rule_with_unknown_tiles(spark):
    df = spark.createDataFrame([(1, 4, None), (None, None, None), (1, 2, 3)], "r int, f int, m int")
    rule = labels.purchase_rule(F.col("r"), F.col("f"), F.col("m"))
    assert [r[0] for r in df.select(rule).collect()] == [0, 1, 1]


def test_text_of_nulls_and_missing_pieces(spark):
    df = spark.createDataFrame([("x:y", None)], "a string, b string")
    row = df.select(
        text.glue("-", F.col("a"), F.col("b")).alias("glued"),
        text.piece(F.col("a"), ":", 1).alias("second"),
        text.piece(F.col("a"), ":", 4).alias("fifth"),
        text.shorten(F.lit("abcdefghijk"), 10).alias("short"),
        text.shorten(F.lit("abcdefghij"), 10).alias("whole"),
    ).first()
    assert tuple(row) == ("x:y-NA", "y", None, "abcdefg...", "abcdefghij")


def test_dates_that_are_none(spark):
    df = spark.createDataFrame(
        [("05/04/18",), ("05/04/75",), ("31/02/18",), ("",), (None,)], "s string"
    )
    found = [r[0] for r in df.select(calendar.parse_day_month_year(F.col("s"))).collect()]
    assert found == [dt.date(2018, 4, 5), dt.date(1975, 4, 5), None, None, None]
    stamps = spark.createDataFrame([("01JAN1900:00:00:00",), ("31FEB2000:00:00:00",)], "s string")
    assert [r[0] for r in stamps.select(calendar.parse_stamp(F.col("s"))).collect()] == [
        dt.date(1900, 1, 1),
        None,
    ]


def test_week_starts(spark):
    weeks = [(y, w) for y in (2016, 2017, 2018) for w in (0, 1, 52, 53)]
    df = spark.createDataFrame(weeks, "y int, w int")
    start = calendar.week_start_repaired(F.col("y"), F.col("w"))
    found = {(r.y, r.w): r.d for r in df.withColumn("d", start).collect()}

    def expected(year, week):
        monday = dt.datetime.strptime(f"{year}-{week}-1", "%Y-%W-%w").date()
        return monday if monday.year == year and int(monday.strftime("%W")) == week else None

    repaired = {(2016, 0): dt.date(2016, 1, 4), (2017, 53): dt.date(2017, 12, 25)}
    for y, w in weeks:
        assert found[y, w] == (repaired.get((y, w)) or expected(y, w)), (y, w)
    label = calendar.year_quarter(F.lit(None).cast("date"))
    assert df.select(label).first()[0] == "NA-NA"


def test_returns_count_negative_row_by_row(spark):
    df = spark.createDataFrame(
        [(1, "Purchase", 5), (1, "Return", 2), (1, "Purchase", None), (2, "Return", 4)],
        "cust int, type string, items int",
    )
    signed = labels.signed(F.col("items"), F.col("type"))
    sums = aggregate.grouped_sum(df, ["cust"], signed, "n", skip_missing=True)
    assert dict(values(sums, "cust", "n")) == {1: 3, 2: -4}


def test_fills(spark):
    df = spark.createDataFrame(
        [("q1", 1), ("q1", 1), ("q1", 2), ("q1", None), ("q2", 3), ("q2", 4), ("q2", None), (None, 9), (None, None)],
        "q string, s int",
    )
    modes = sorted(values(fills.group_mode(df, ["q"], "s"), "q", "s", "n"), key=str)
    assert modes == sorted([("q1", 1, 2), ("q2", 3, 1), ("q2", 4, 1), (None, 9, 1)], key=str)
    filled = fills.fill_by_group_mode(df, ["q"], "s")
    assert sorted(values(filled, "q", "s"), key=str) == sorted(
        [("q1", 1), ("q1", 1), ("q1", 1), ("q1", 2), ("q2", 3), ("q2", 3), ("q2", 4), (None, 9), (None, 9)],
        key=str,
    )
    assert sorted(r.s for r in fills.fill_with_max(df, "s").collect()) == [1, 1, 2, 3, 4, 9, 9, 9, 9]
    mapped = fills.fill_by_map(df, "s", "q", {"q2": 7})
    assert sorted(values(mapped.where("q = 'q2'"), "s")) == [(3,), (4,), (7,)]
    assert mapped.where("q = 'q1' and s is null").count() == 1


def test_rare_levels(spark):
    df = spark.createDataFrame([("x",)] * 3 + [("y",)] + [(None,)] * 3, "c string")
    lumped = fills.lump_rare(df, "c", "g", limit=2)
    assert sorted(values(lumped, "c", "g"), key=str) == sorted(
        [("x", "x")] * 3 + [("y", "Others")] + [(None, None)] * 3, key=str
    )


def test_ratios_of_zero_are_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 4.0)], "a double, b double")
    assert [r[0] for r in df.select(arithmetic.ratio(F.col("a"), F.col("b"))).collect()] == [None, 0.25]
    mean = arithmetic.row_mean(F.lit(1), F.lit(None).cast("int"))
    assert df.select(mean).first()[0] is None
    assert abs(sum(arithmetic.BLEND_WEIGHTS) - 1) < 1e-12


def test_null_profiles(spark):
    df = tiny(spark)
    assert dict(values(profile.null_census(df), "column", "missing")) == {"k": 1, "g": 1, "v": 2}
    assert dict(values(profile.null_patterns(df), "pattern", "n")) == {"000": 2, "001": 2, "100": 1, "010": 1}


def test_pivot_then_unpivot_is_the_input(spark):
    rows = [("a", "x", 1), ("a", "y", 2), ("b", "x", 3)]
    df = spark.createDataFrame(rows, "k string, c string, v long")
    wide = reshape.spread(df, ["k"], "c", ["x", "y"], F.sum("v"))
    long = reshape.gather(wide, ["k"], ["x", "y"], "c", "v")
    assert sorted(values(long.where("v is not null"), "k", "c", "v")) == rows
    assert long.count() == 4
    filled = reshape.spread(df, ["k"], "c", ["x", "y"], F.sum("v"), fill=0)
    assert sorted(values(filled, "k", "x", "y")) == [("a", 1, 2), ("b", 3, 0)]


def test_pivot_loses_no_label(spark):
    rows = [("a", "x", 3), ("a", "torn", 1), ("a", None, 4)]
    df = spark.createDataFrame(rows, "k string, c string, v long")
    wide = reshape.spread(df, ["k"], "c", ["x", "y"], F.sum("v"), fill=0)
    assert wide.columns == ["k", "x", "y", "NA", "torn"]
    assert [tuple(r) for r in wide.collect()] == [("a", 3, 0, 4, 1)]


def test_unlisted_return_reasons_keep_their_share(spark):
    rows = [("r", "Return", "Torn", 3), ("r", "Return", "Others", 1), ("r", "Return", None, 4)]
    df = spark.createDataFrame(rows, "region string, transaction_type string, return_group string, item_count long")
    (row,) = retail.region_reason_shares(df, ["Others", "No Return"]).collect()
    assert row.asDict() == {"region": "r", "Others": 0.125, "No Return": 0.0, "NA": 0.5, "Torn": 0.375}


def test_delimited_files_keep_texts(spark, tmp_path):
    rows = [(1, 'say "so"'), (2, "  pad "), (3, "one\ntwo"), (4, 'comma, "and" quote\\'), (5, None), (6, '"')]
    df = spark.createDataFrame(rows, "k int, t string")
    delimited.write_delimited(df, str(tmp_path / "csv"))
    back = delimited.read_delimited(spark, str(tmp_path / "csv"), df.schema)
    assert sorted(tuple(r) for r in back.collect()) == rows
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part.csv").write_text("k,t\nnot a number,x\n")
    with pytest.raises(Exception):
        delimited.read_delimited(spark, str(tmp_path / "bad"), df.schema).collect()


def test_sparse_rows_add_repeated_pairs(spark):
    df = spark.createDataFrame([(1, 7, 2.0), (1, 7, 3.0), (1, 4, -1.0), (2, 4, 8.0)], "r int, c int, v double")
    rows = {r.r: (r["columns"], r["cells"]) for r in reshape.sparse_rows(df, "r", "c", "v").collect()}
    assert rows == {1: ([4, 7], [-1.0, 5.0]), 2: ([4], [8.0])}


def test_top_n_keeps_ties(spark):
    df = spark.createDataFrame([("a", 5), ("a", 5), ("a", 4), ("b", 1), (None, 2), (None, 2)], "g string, n int")
    assert sorted(values(ranking.top_n_per_group(df, "n", ["g"]), "g", "n"), key=str) == sorted(
        [("a", 5), ("a", 5), ("b", 1), (None, 2), (None, 2)], key=str
    )
    assert sorted(r.n for r in ranking.top_n_per_group(df, "n", ["g"], 2).collect()) == [1, 2, 2, 5, 5]
    assert sorted(r.n for r in ranking.top_n(df, "n", 1).collect()) == [5, 5]
    assert ranking.top_n(df, "n", 100).count() == 6
