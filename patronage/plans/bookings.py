"""Booking features: repairs, bins, imputation, member statistics and target encodings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions import calendar, labels
from patronage.functions.missing import strict
from patronage.functions.text import shorten
from patronage.operators.aggregate import target_encoding
from patronage.operators.columns import across
from patronage.operators.fills import fill_by_map, fill_constants
from patronage.operators.joins import natural_left_join, null_safe_join
from patronage.session import durable

# The season assumed for a check-in quarter (the first quarter has none), the home state
# assumed when unknown, and the key sets of the three target encodings.
SEASON_OF_QUARTER = {2: 2, 3: 4, 4: 2}
HOME_STATE = 8
ENCODINGS = {
    "cmpr": ("cluster_code", "member_age_buckets", "pax", "room_type_booked_code"),
    "sssr": (
        "season_holidayed_code",
        "state_code_residence",
        "state_code_resort",
        "reservationstatusid_code",
    ),
    "prac": ("pax", "room_stay", "adv_booking", "checkin_d"),
}

MEMBER = ("memberid",)
MEMBER_RESORT = ("memberid", "resort_region_code", "resort_type_code")


def parse_dates(df: DataFrame) -> DataFrame:
    """Booking files carry their dates as dd/mm/yy text."""
    return across(
        df, ["booking_date", "checkin_date", "checkout_date"], calendar.parse_day_month_year
    )


def repair_lead(df: DataFrame) -> DataFrame:
    """A booking after its check-in counts as booked on that day: first the date, then the lead time."""
    booked, arrives, lead = F.col("booking_date"), F.col("checkin_date"), F.col("advance_booking")
    df = df.withColumn("advance_booking", calendar.days_between(arrives, booked))
    df = df.withColumn("booking_date", F.when(lead < 0, arrives).otherwise(booked))
    return df.withColumn("advance_booking", F.when(lead < 0, F.lit(0)).otherwise(lead))


def repair_nights(df: DataFrame) -> DataFrame:
    """Fewer than one room night is replaced by the days between check-in and check-out."""
    stay = calendar.days_between(F.col("checkout_date"), F.col("checkin_date"))
    return df.withColumn(
        "roomnights", F.when(F.col("roomnights") < 1, stay).otherwise(F.col("roomnights"))
    )


def calendar_parts(df: DataFrame) -> DataFrame:
    booked, arrives, leaves = F.col("booking_date"), F.col("checkin_date"), F.col("checkout_date")
    return df.withColumns(
        {
            "booking_month": F.month(booked),
            "booking_day": F.dayofmonth(booked),
            "checkin_month": F.month(arrives),
            "checkin_day": F.dayofmonth(arrives),
            "booking_d": calendar.day_name(booked),
            "checkin_d": calendar.day_name(arrives),
            "checkout_d": calendar.day_name(leaves),
            "checkin_quarter": F.quarter(arrives),
            "checkin_weekend": calendar.is_weekend(arrives),
        }
    )


def cut_ids(
    df: DataFrame, width: int, id_columns: Sequence[str] = ("memberid", "resort_id")
) -> DataFrame:
    """The ids cut to a length, where the columns are there."""
    present = [c for c in id_columns if c in df.columns]
    return across(df, present, lambda c: shorten(c, width))


def clean(
    df: DataFrame,
    id_width: int | None = None,
    id_columns: Sequence[str] = ("memberid", "resort_id"),
    seasons: Mapping[int, int] = SEASON_OF_QUARTER,
    home_state: int = HOME_STATE,
) -> DataFrame:
    """Repaired and binned bookings: one projection, no shuffle.

    ``id_width`` cuts the ids to that length. Cut ids of different members can be equal, and their
    statistics then describe all of them together.
    """
    if id_width is not None:
        df = cut_ids(df, id_width, id_columns)
    df = calendar_parts(repair_nights(repair_lead(df)))
    df = fill_by_map(df, "season_holidayed_code", "checkin_quarter", seasons)
    df = fill_constants(df, {"state_code_residence": home_state})
    return df.withColumns(
        {
            "pax": labels.party_size(F.col("total_pax")),
            "room_stay": labels.stay_length(F.col("roomnights")),
            "adv_booking": labels.lead_time(F.col("advance_booking")),
        }
    )


def _extreme(which: str, column: str) -> Column:
    return strict((F.max if which == "max" else F.min)(column), F.col(column))


def resort_stats(df: DataFrame) -> DataFrame:
    """Per member, region and resort type: extremes of stay and party, and visits."""
    return df.groupBy(*MEMBER_RESORT).agg(
        _extreme("max", "roomnights").alias("max_roomnight_rrc"),
        _extreme("min", "roomnights").alias("min_roomnight_rrc"),
        F.count(F.lit(1)).alias("total_visit_rrc"),
        _extreme("min", "numberofadults").alias("min_adult_rrc"),
        _extreme("max", "numberofchildren").alias("max_children_rrc"),
        _extreme("min", "numberofchildren").alias("min_children_rrc"),
    )


MEMBER_STATS = {
    "max_total_pax": ("max", "total_pax"),
    "min_total_pax": ("min", "total_pax"),
    "max_roomnight": ("max", "roomnights"),
    "min_roomnight": ("min", "roomnights"),
    "max_adult": ("max", "numberofadults"),
    "min_adult": ("min", "numberofadults"),
    "max_children": ("max", "numberofchildren"),
    "min_children": ("min", "numberofchildren"),
}


def member_stats(df: DataFrame) -> DataFrame:
    """Per member: extremes of party, stay, adults and children, and visits."""
    return df.groupBy(*MEMBER).agg(
        *[_extreme(which, column).alias(name) for name, (which, column) in MEMBER_STATS.items()],
        F.count(F.lit(1)).alias("total_visit"),
    )


STATISTICS_INPUT = (
    *MEMBER_RESORT,
    "is_train",
    *dict.fromkeys(column for _, column in MEMBER_STATS.values()),
    *dict.fromkeys(key for keys in ENCODINGS.values() for key in keys),
)


def attach_member_stats(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Both sets of member statistics on every booking, through one join. ``source`` holds the same bookings with
    at least the columns of the statistics, where those are cheaper to read.

    The bookings are aggregated once, per member and resort kind; the member's own statistics are rolled
    up from that smaller table, and the two are put together before they meet the bookings.
    """
    fine = durable(
        (source or df).groupBy(*MEMBER_RESORT).agg(
            *[_extreme(which, column).alias(name) for name, (which, column) in MEMBER_STATS.items()],
            F.count(F.lit(1)).alias("total_visit"),
        )
    )
    coarse = fine.groupBy(*MEMBER).agg(
        *[_extreme(which, name).alias(name) for name, (which, _) in MEMBER_STATS.items()],
        F.sum("total_visit").alias("total_visit"),
    )
    kept = {
        "max_roomnight": "max_roomnight_rrc",
        "min_roomnight": "min_roomnight_rrc",
        "total_visit": "total_visit_rrc",
        "min_adult": "min_adult_rrc",
        "max_children": "max_children_rrc",
        "min_children": "min_children_rrc",
    }
    fine = fine.select(*MEMBER_RESORT, *[F.col(old).alias(new) for old, new in kept.items()])
    stats = null_safe_join(fine, coarse, MEMBER)
    return null_safe_join(df, durable(stats), MEMBER_RESORT)


def encodings(cleaned: DataFrame, target: str) -> dict[str, DataFrame]:
    """The three target encodings, learnt from the training rows."""
    training = cleaned.where(F.col("is_train") == 1)
    return {
        prefix: target_encoding(training, keys, target, prefix) for prefix, keys in ENCODINGS.items()
    }


def features(bookings: DataFrame, target: str = "amount", id_width: int | None = None) -> DataFrame:
    """All features of every booking.

    The bookings are kept once as they come, with the ids cut. The member statistics meet these narrow rows, which
    are the ones that are shuffled where the statistics are too large to broadcast; what follows from a row alone is
    added after that join.
    """
    if id_width is not None:
        bookings = cut_ids(bookings, id_width)
    bookings = durable(bookings)
    cleaned = clean(bookings)
    narrow = cleaned.select(*dict.fromkeys([*STATISTICS_INPUT, target]))
    met = attach_member_stats(bookings, narrow)
    out = clean(met).select(*cleaned.columns, *[c for c in met.columns if c not in bookings.columns])
    for table in encodings(narrow, target).values():
        out = natural_left_join(out, durable(table))
    return out
