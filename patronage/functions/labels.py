"""Binning and relabelling expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from patronage.functions.missing import if_else

# Labels and level groups the results must carry.
RETURN_TYPE = "Return"
NO_RETURN = "No Return"
STANDALONE = "STANDALONE"
STANDALONE_STORE = "Stand Alone Store"
MALL_STORE = "Mall Store"
REGION_PREFIX = "MX - "
OTHERS = "Others"
RARE_NATIONALITY_LIMIT = 800
LONG_JOB_TITLE = "PRESIDENT/SECY/TREASURER TO CLUB/ASSOC/SOCIETY"
SHORT_JOB_TITLE = "Society Leaders"
RETURN_REASON_GROUPS = {
    "Size.Problem": ["Size Problem", "Ordered wrong size", "Fit Problem"],
    "Mfg.Defect": [
        "Mfg. Defect",
        "Adhesive",
        "Accessory/Trim",
        "Zip Defect",
        "Warranty",
        "Squins/Button Detachment",
        "Handling Defect",
        "Motif/Print Defect",
        "Material/Fabric Defect",
        "Appearance Change After wash",
    ],
    "Others": ["Gift Exchange", "Color Exchange"],
}


def party_size(people: Column) -> Column:
    """``couple`` for two, ``others`` below two and above four, else (three, four, unknown) ``family``."""
    return (
        F.when((people > 4) | (people < 2), "others").when(people == 2, "couple").otherwise("family")
    )


def stay_length(nights: Column) -> Column:
    return (
        F.when(nights <= 2, "VShort")
        .when(nights <= 4, "Normal")
        .when(nights <= 7, "Week")
        .when(nights > 7, "Long")
    )


def lead_time(days: Column) -> Column:
    return (
        F.when(days <= 2, "Sudden")
        .when(days <= 15, "Fortnite")
        .when(days <= 31, "Amonth")
        .when(days > 31, "Long Booking")
    )


def store_format(mall: Column) -> Column:
    return F.when(mall == STANDALONE, STANDALONE_STORE).otherwise(MALL_STORE)


def relabel(column: Column, old: str, new: str) -> Column:
    """One value replaced, nulls kept."""
    return if_else(column == old, F.lit(new), column)


def collapse(
    column: Column, groups: Mapping[str, Sequence[str]] = RETURN_REASON_GROUPS
) -> Column:
    """Listed levels renamed to their group; all other values kept."""
    (first, members), *rest = groups.items()
    choice = F.when(column.isin(*members), first)
    for name, values in rest:
        choice = choice.when(column.isin(*values), name)
    return choice.otherwise(column)


def return_flag(transaction_type: Column) -> Column:
    """1 for a return, 0 for anything else, null if unknown."""
    return if_else(transaction_type == RETURN_TYPE, F.lit(1), F.lit(0))


def signed(quantity: Column, transaction_type: Column) -> Column:
    """The quantity with its sign turned for returns (decided on each row by itself)."""
    return F.when(transaction_type == RETURN_TYPE, -quantity).otherwise(quantity)


def positive_flag(value: Column, tolerance: float = 0.0) -> Column:
    """1 above the tolerance, 0 otherwise, null if unknown."""
    return if_else(value > F.lit(tolerance), F.lit(1), F.lit(0))


def purchase_rule(*tiles: Column, worst_accepted: int = 3) -> Column:
    """0 if any tile is worse than accepted, else 1; a row with no known tile gives 1."""
    bad = tiles[0] > worst_accepted
    for tile in tiles[1:]:
        bad = bad | (tile > worst_accepted)
    return F.when(bad, 0).otherwise(1)
