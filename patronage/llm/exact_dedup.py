"""Exact deduplication by naming blocks of text.

A normalised text is cut into blocks of a fixed size. Distinct blocks are sorted and numbered; then each pair of
neighbouring names is numbered in the same way, level by level, until one name is left per document. Two
documents get the same name exactly if their normalised texts are identical, because a name stands for one
content at every level.

The blocks are sorted by a 64-bit fingerprint and their length, and the contents behind each fingerprint are
compared: those that share one are named by their contents. Contents thus travel through one shuffle, after equal
blocks have met in their map task, and in all others only numbers and the few contents that share a fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.session import durable

BLOCK_CHARS = 4096
_NO_RIGHT = -1
_BLOCK = ["_hash", "_chars", "_twin"]


def normalised(text: Column) -> Column:
    """The text without any ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def blocks(text: Column, size: int) -> Column:
    """The text in blocks of ``size`` code points, the last one shorter; an empty text is one empty block."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(cut)


def _numbered(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows with their integer names; stored, so that a name never changes."""
    return durable(distinct.sortWithinPartitions(*keys).withColumn("_name", F.monotonically_increasing_id()))


def _fingerprint(block: Column) -> Column:
    return F.xxhash64(block)


def _block_names(docs: DataFrame, size: int) -> DataFrame:
    """(_hash, _chars, _twin) -> _name over all blocks; _twin is the content where several share a fingerprint, or empty."""
    one = docs.select(F.explode(blocks(normalised(F.col("text")), size)).alias("_block"))
    kinds = one.groupBy(_fingerprint(F.col("_block")).alias("_hash"), F.length("_block").alias("_chars")).agg(
        F.collect_set("_block").alias("_contents")
    )
    # Blocks of one length differ only if they have code points, so an empty block is never a twin.
    twins = F.when(F.size("_contents") > 1, F.col("_contents")).otherwise(F.array(F.lit("")))
    return _numbered(kinds.select("_hash", "_chars", F.explode(twins).alias("_twin")), _BLOCK)


def _placed_blocks(docs: DataFrame, names: DataFrame, size: int) -> DataFrame:
    """One row per block (``_row``, ``_count``, ``_place``, its fingerprint); the first of a text has the row's columns."""
    text = normalised(F.col("text"))
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        "doc_id",
        F.coalesce(F.length("text"), F.lit(0)).alias("_length"),
        F.sha2(text, 256).alias("text_sha256"),
        blocks(text, size).alias("_blocks"),
    )
    own = [F.when(F.col("_place") == 0, F.col(c)).alias(c) for c in ("doc_id", "_length", "text_sha256")]
    placed = rows.select("*", F.size("_blocks").alias("_count"), F.posexplode("_blocks").alias("_place", "_block")).select(
        "_row", "_count", "_place", *own, _fingerprint(F.col("_block")).alias("_hash"), F.length("_block").alias("_chars"), "_block"
    )
    twins = durable(names.where("_twin <> ''").select("_hash", "_chars").distinct().withColumn("_shared", F.lit(True)))
    if twins.isEmpty():
        return durable(placed.withColumn("_twin", F.lit("")).drop("_block"))
    twin = F.when(F.col("_shared"), F.col("_block")).otherwise("").alias("_twin")
    return durable(placed.join(twins, ["_hash", "_chars"], "left").select(*placed.columns, twin).drop("_block"))


def _named_documents(docs: DataFrame, size: int) -> DataFrame:
    """Every row as ``_row``, doc_id, ``_length``, text_sha256 and its identity (``_level``, ``_name``)."""
    names = _block_names(docs, size)
    placed = _placed_blocks(docs, names, size)
    most = placed.agg(F.max("_count")).first()[0] or 1
    levels = (most - 1).bit_length()

    current = durable(placed.join(names, _BLOCK).select("_row", "_count", "_place", "_name"))
    done = [current.where("_count = 1").select("_row", F.lit(0).alias("_level"), "_name")]
    for level in range(1, levels + 1):
        open_rows = current.where("_count > 1")
        left, right = F.col("_place") % 2 == 0, F.col("_place") % 2 == 1
        pairs = open_rows.groupBy("_row", "_count", F.expr("_place div 2").cast("int").alias("_place")).agg(
            F.max(F.when(left, F.col("_name"))).alias("_left"),
            F.coalesce(F.max(F.when(right, F.col("_name"))), F.lit(_NO_RIGHT)).alias("_right"),
        )
        pairs = durable(pairs)
        pair_names = _numbered(pairs.select("_left", "_right").distinct(), ["_left", "_right"])
        current = durable(
            pairs.join(pair_names, ["_left", "_right"]).select(
                "_row", F.ceil(F.col("_count") / 2).cast("int").alias("_count"), "_place", "_name"
            )
        )
        done.append(current.where("_count = 1").select("_row", F.lit(level).alias("_level"), "_name"))
    identities = done[0]
    for more in done[1:]:
        identities = identities.unionByName(more)
    return placed.where("_place = 0").select("_row", "doc_id", "_length", "text_sha256").join(identities, "_row")


def exact_dedup(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): which row of its class of identical texts stays.

    Texts are identical if they are after all ASCII white space is deleted. Of a class, the row with the
    longest original text stays, then the smallest doc_id (a null one last); of rows repeated with the same
    doc_id and length, one stays. Null and empty texts form one class. Other columns of ``docs`` are ignored;
    an empty table gives no rows. ``text_sha256`` is for the reader and decides nothing.

    Columns: doc_id, keep_id, group_size, kept, text_sha256.
    """
    named = durable(_named_documents(docs.select("doc_id", "text"), block_chars))
    best = F.min(
        F.struct((-F.col("_length")).alias("l"), F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col("_row"))
    )
    classes = durable(named.groupBy("_level", "_name").agg(F.count(F.lit(1)).alias("group_size"), best.alias("_keep")))
    return named.join(classes, ["_level", "_name"]).select(
        "doc_id",
        F.col("_keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_keep._row")).alias("kept"),
        "text_sha256",
    )
