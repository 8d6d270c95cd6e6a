"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the number of copies each of its documents should have. The whole part
is taken as it is; the fractions left are rounded so that the words taken hardly move. Two documents with open
fractions are paired and mass (words times fraction) is handed from one to the other, in either direction with
odds that keep both expectations, until one of them is at 0 or 1. The other goes on to the next pair. Chunks of
neighbouring documents are settled side by side; what each leaves open meets in chunks of the next level, a tree
whose number of levels grows with the logarithm of the number of documents.

A pair leaves the longer document open more often than not, so each source is settled in two rounds: first the
long documents, then the document they leave open is paired with all short documents as one partner, whose common
fraction takes over the mass; then the short ones. The words taken so miss the target by part of one short document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.operators.joins import null_safe_join
from patronage.operators.ranking import global_position
from patronage.session import durable

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
FAN_IN = 64
SEED = 20190
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """The number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Adds ``target`` to ``sources`` (source, source_size): shares of the total size by weight.

    Sources in code-point order (null last) have the ``weights`` in turn. A target stops at ``most`` times its
    source's size; the rest is shared by weight among the others until none is above. Each pass adds the
    sources found above, so the passes end; only sums reach the driver.
    """
    placed = durable(global_position(sources, [F.col("source").asc_nulls_last()], "_place"))
    turn = ((F.col("_place") - 1) % len(weights) + 1).cast("int")
    weighed = placed.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn)).withColumn(
        "_cap", (F.col("source_size") * most).cast("double")
    )
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    stopped, level = -1, 0.0
    while True:
        above = F.col("_weight") * level > F.col("_cap") if stopped >= 0 else F.lit(False)
        count, taken, weight = weighed.agg(
            F.count(F.when(above, 1)), F.sum(F.when(above, F.col("_cap"))), F.sum(F.when(~above, F.col("_weight")))
        ).first()
        if count == stopped or not weight:
            break
        stopped, level = count, (total - (taken or 0.0)) / weight
    target = F.least(F.col("_weight") * F.lit(level), F.col("_cap"))
    return weighed.withColumn("target", target).drop("_place", "_weight", "_cap")


def _chance(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) * F.lit(2.0**-53)


def _pivot(seed: int):
    """One step of a chunk: the open document ``s`` meets ``x``; one of them is settled, the other stays open."""

    def settled(doc, up: int) -> Column:
        return F.struct(doc["doc_id"].alias("doc_id"), doc["size"].alias("size"), F.lit(up).alias("up"))

    def state(doc, p: Column, done: Column) -> Column:
        p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
        return F.struct(
            doc["place"].alias("place"), doc["doc_id"].alias("doc_id"), doc["size"].alias("size"), p.alias("p"), done.alias("done")
        )

    def step(s, x) -> Column:
        lacks, holds = s["size"] * (1 - s["p"]), s["size"] * s["p"]
        gives, takes = x["size"] * x["p"], x["size"] * (1 - x["p"])
        up, down = F.least(lacks, gives), F.least(holds, takes)
        rises = _chance(F.lit(seed), s["place"], x["place"]) * (up + down) < down
        add = lambda *one: F.concat(s["done"], F.array(*one))
        return (
            F.when(rises & (lacks <= gives), state(x, x["p"] - up / x["size"], add(settled(s, 1))))
            .when(rises, state(s, s["p"] + up / s["size"], add(settled(x, 0))))
            .when(holds <= takes, state(x, x["p"] + down / x["size"], add(settled(s, 0))))
            .otherwise(state(s, s["p"] - down / s["size"], add(settled(x, 1))))
        )

    return step


def _settle(open_docs: DataFrame, last_place: int, fan_in: int, seed: int) -> tuple[list[DataFrame], DataFrame]:
    """The reduction tree over (source, place, doc_id, size, p): the settled documents of every level, and the one
    document that each source has left open. A chunk holds at most ``fan_in`` documents."""
    done, level = [], 0
    current = open_docs.withColumn("_chunk", F.col("place"))
    nothing = F.array().cast("array<struct<doc_id:bigint,size:bigint,up:int>>")
    while level == 0 or fan_in**level <= last_place:
        level += 1
        doc = F.struct("place", "doc_id", "size", "p")
        chunks = current.groupBy("source", F.expr(f"_chunk div {fan_in}").alias("_chunk")).agg(
            F.array_sort(F.collect_list(doc)).alias("_docs")
        )
        first = F.col("_docs")[0]
        start = F.struct(first["place"].alias("place"), first["doc_id"].alias("doc_id"), first["size"].alias("size"), first["p"].alias("p"), nothing.alias("done"))
        end = F.aggregate(F.slice("_docs", 2, fan_in), start, _pivot(seed + level))
        step = durable(chunks.select("source", "_chunk", end.alias("_end")).select("source", "_chunk", "_end.*"))
        done.append(step.select("source", F.explode("done").alias("_one")).select("source", "_one.*"))
        current = step.drop("done")
    return done, current.drop("_chunk")


def _long_from(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, _short, _short_mass): documents of fewer than 2 ** _short words are short.

    The least power of two whose short documents can take over the mass of any one document; if there is none,
    all are short. A source has one row per power of two here.
    """
    power = F.length(F.bin("size"))
    kinds = sized.where("size > 0").groupBy("source", power.alias("_power")).agg(F.sum("size").alias("_mass"), F.max("size").alias("_most"))
    upward = Window.partitionBy("source").orderBy("_power")
    summed = kinds.withColumn("_short_mass", F.sum("_mass").over(upward)).withColumn(
        "_longest", F.max("_most").over(Window.partitionBy("source"))
    )
    room = F.least(F.col("_share"), 1 - F.col("_share")) * F.col("_short_mass")
    judged = null_safe_join(summed, sources.select("source", "_share"), ["source"], "inner")
    pick = F.coalesce(F.min(F.when(room >= F.col("_longest"), F.col("_power"))), F.max("_power"))
    shorts = judged.groupBy("source").agg(pick.alias("_short"), F.collect_list(F.struct("_power", "_short_mass")).alias("_masses"))
    mass = F.filter("_masses", lambda m: m["_power"] == F.col("_short"))[0]["_short_mass"]
    return shorts.select("source", "_short", mass.alias("_short_mass"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST_COPIES,
    fan_in: int = FAN_IN,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): how many of its words the mix takes, repeats counted.

    A document is taken a whole number of times, at most ``most``. Sources are as in ``targets``; null is one.
    Texts without words, empty or null, have size 0 and are taken 0 times their size. Repeated rows are documents
    of their own. The draw depends on ``seed``, doc_id, source and size only, so reruns agree whatever the
    partitioning. Other columns are ignored; an empty table gives no rows.

    Columns: doc_id, size, source_size, target, taken, copies, source.
    """
    row = F.monotonically_increasing_id().alias("_row")
    sized = durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), row))
    sources = durable(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    copies = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    sources = targets(sources, weights, most).withColumn("_whole", F.floor(copies).cast("int"))
    sources = durable(sources.withColumn("_share", copies - F.col("_whole")))
    sources = durable(null_safe_join(sources, _long_from(sized, sources), ["source"], "left"))

    known = null_safe_join(sized, sources, ["source"], "inner")
    is_open = (F.col("size") > 0) & (F.col("_share") > 0)
    settled = [known.where(~is_open).select("source", "doc_id", "size", F.lit(0).alias("up"))]
    order = [F.col("source").asc_nulls_last(), F.col("size").desc(), F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id"), F.col("_row")]
    placed = durable(global_position(known.where(is_open).select("source", "doc_id", "size", "_row", "_share", "_short"), order, "place"))
    last_place = placed.agg(F.max("place")).first()[0] or 0

    is_long = F.col("size") >= F.pow(F.lit(2.0), F.col("_short"))
    pair = ["source", "place", "doc_id", "size"]
    done, left = _settle(placed.where(is_long).select(*pair, F.col("_share").alias("p")), last_place, fan_in, seed)
    up = F.when(_chance(F.lit(seed), "place") < F.col("p"), 1).otherwise(0)
    left = durable(left.withColumn("up", up))
    settled += [*done, left.select("source", "doc_id", "size", "up")]

    moved = left.select("source", ((F.col("p") - F.col("up")) * F.col("size")).alias("_moved"))
    shares = null_safe_join(sources.select("source", "_share", "_short_mass"), moved, ["source"], "left")
    part = F.col("_share") + F.coalesce(F.col("_moved") / F.col("_short_mass"), F.lit(0.0))
    shares = durable(shares.select("source", F.greatest(F.lit(0.0), F.least(F.lit(1.0), part)).alias("p")))
    short = null_safe_join(placed.where(~is_long).select(*pair), shares, ["source"], "inner").select(*pair, "p")
    done, left = _settle(short, last_place, fan_in, seed + 1000)
    settled += [*done, left.select("source", "doc_id", "size", up.alias("up"))]

    rows = settled[0]
    for more in settled[1:]:
        rows = rows.unionByName(more)
    rows = null_safe_join(rows, sources.select("source", "source_size", "target", "_whole"), ["source"], "inner")
    taken = (F.col("_whole") + F.col("up")).cast("long")
    return rows.select(
        "doc_id", "size", "source_size", "target", (taken * F.col("size")).alias("taken"), taken.alias("copies"), "source"
    )
