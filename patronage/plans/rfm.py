"""Recency, frequency and monetary scoring with a purchase rule."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.functions.arithmetic import row_mean
from patronage.functions.calendar import days_between, parse_stamp
from patronage.functions.labels import purchase_rule, signed
from patronage.functions.missing import strict
from patronage.functions.text import digits_code
from patronage.operators.ranking import exact_ntiles
from patronage.sources.published import publish


def recency(customers: DataFrame) -> DataFrame:
    """Days from a customer's last activity to the day after the latest one; unknown counts as worst."""
    dated = customers.select("customer_id", parse_stamp(F.col("last_accr_raw")).alias("_last"))
    ends = dated.agg(F.struct(F.min("_last").alias("first"), F.max("_last").alias("last"))).scalar()
    today = F.date_add(F.col("_ends.last"), 1)
    days = days_between(today, F.coalesce(F.col("_last"), F.col("_ends.first")))
    return dated.withColumn("_ends", ends).select("customer_id", days.alias("recency"))


def activity(transactions: DataFrame) -> DataFrame:
    """Frequency (items bought less items returned) and monetary (revenue) from one aggregation."""
    items = signed(F.col("item_count"), F.col("transaction_type"))
    revenue = F.col("revenue")
    return transactions.groupBy("customer_id").agg(
        F.coalesce(F.sum(items), F.lit(0)).alias("frequency"),
        strict(F.sum(revenue), revenue).alias("monetary"),
    )


def base(customers: DataFrame, transactions: DataFrame) -> DataFrame:
    """One row per customer; those without transactions have null frequency and monetary."""
    return recency(customers).join(activity(transactions), "customer_id", "left")


def score(rfm_base: DataFrame, tiles: int = 4) -> DataFrame:
    """Tiles R (low is recent), F and M (low is much), their code, mean and the rule's prediction.

    Ties are ordered by customer_id.
    """
    measures = {"r": ("recency", False), "f": ("frequency", True), "m": ("monetary", True)}
    scored = exact_ntiles(rfm_base, measures, "customer_id", tiles)
    marks = [F.col("r"), F.col("f"), F.col("m")]
    return scored.withColumns(
        {
            "rfm_code": digits_code(*marks),
            "agg_score": row_mean(*marks),
            "prediction": purchase_rule(*marks),
        }
    )


def submission(test_pairs: DataFrame, scored: DataFrame) -> DataFrame:
    """Every test pair with its customer's prediction, sorted."""
    return (
        test_pairs.join(scored.select("customer_id", "prediction"), "customer_id", "left")
        .select(
            "customer_id",
            F.col("store_code").try_cast("double").alias("store_code"),
            F.col("prediction").cast("double").alias("prediction"),
        )
        .orderBy("customer_id", "store_code")
    )


def run(customers: DataFrame, transactions: DataFrame, test_pairs: DataFrame, folder: str, at: dt.datetime) -> str:
    """The whole job: the submission published as ``folder/rfm_<stamp>``, whose path is returned."""
    return publish(submission(test_pairs, score(base(customers, transactions))), folder, "rfm", at)
