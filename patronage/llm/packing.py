"""Best-fit packing of tokenised documents into sequences of a fixed length, by minimum bin slack.

Only the number of pieces of each length matters for a packing, and there are at most as many lengths as a
sequence has tokens. The plan is therefore made from that bounded histogram: the longest piece left opens a
sequence, a bitset subset-sum over the lengths left finds the combination that fills it best, and the same
combination is taken as often as the pieces last. The pieces then find their places in parallel, by their rank
within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patronage.llm.tokens import WORD_BPE, encoder
from patronage.session import durable, small_batches

SEQUENCE_TOKENS = 4096
END_ID = 1

_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, _part int, _rank long"


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many pieces of each length fill ``room`` as far as possible; longer pieces are preferred.

    Bit s of a reach set says that some choice among the lengths seen so far sums to s. A length with c
    pieces is added in parts of 1, 2, 4, ... pieces.
    """
    mask = (1 << (room + 1)) - 1
    reach = 1
    steps: list[tuple[int, int, int]] = []  # (length, pieces, reach before)
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        left = min(counts[length], room // length)
        part = 1
        while left:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (take * length)) & mask
            left -= take
            part *= 2
        if reach >> room:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= take * length
    return chosen


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, combination) until no piece is left; at most one entry per length and exhausted combination."""
    left = {length: n for length, n in counts.items() if n}
    out = []
    while left:
        first = max(left)
        left[first] -= 1
        rest = best_fill({k: n for k, n in left.items() if n}, capacity - first)
        left[first] += 1
        combination = dict(rest)
        combination[first] = combination.get(first, 0) + 1
        times = min(left[length] // n for length, n in combination.items())
        for length, n in combination.items():
            left[length] -= times * n
            if not left[length]:
                del left[length]
        out.append((times, combination))
    return out


def _pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Every piece with its length, checksum and rank among those of its length in the same task."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoded = encoder(tokenizer, spaces_kept=False).encode_many
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            rows = []
            for doc_id, own_ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1))):
                ids = own_ids + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    length = len(own) // 4
                    rows.append((doc_id, piece, at // 4, length, zlib.crc32(own), part, int(seen[length])))
                    seen[length] += 1
            columns = list(zip(*rows)) or [()] * 7
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_rank"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, _PIECES)


def _runs(combinations: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length, the runs of ranks that go to one combination: first rank, pieces, sequence and offset."""
    taken: dict[int, int] = {}
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for times, combination in combinations:
        offset = 0
        for length in sorted(combination, reverse=True):
            n = combination[length]
            first = taken.get(length, 0)
            runs.setdefault(length, []).append((first, n, sequence, offset))
            taken[length] = first + times * n
            offset += n * length
        sequence += times
    return {length: tuple(np.array(c, dtype=np.int64) for c in zip(*own)) for length, own in runs.items()}


def pack(
    docs: DataFrame,
    tokenizer: str = WORD_BPE,
    end_id: int = END_ID,
    capacity: int = SEQUENCE_TOKENS,
) -> DataFrame:
    """One row per piece of every document of ``docs`` (doc_id, text), with its place in a sequence.

    A document is its token ids and ``end_id``; only one longer than ``capacity`` is cut. A null text counts as
    empty and is a piece of one token. Rows repeated or with a null doc_id are documents of their own. Other
    columns are ignored; an empty table gives no rows.

    The driver holds one number per length and the plan made from them, both bounded by ``capacity``: each
    entry of the plan uses up at least one length or takes a combination that can't be repeated, and an entry
    has at most ``capacity`` pieces. The same plan is what tasks get to place their pieces.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        pieces = durable(_pieces(docs, tokenizer, end_id, capacity))
    per_task = durable(pieces.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_task.select(
        "length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")
    )
    histogram = {r[0]: r[1] for r in per_task.groupBy("length").agg(F.sum("_n")).collect()}
    runs = spark.sparkContext.broadcast(_runs(plan(histogram, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_at").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order])) + 1
            for own in np.split(order, edges) if len(order) else []:
                size = int(length[own[0]])
                first, n, start, base = table[size]
                run = np.searchsorted(first, rank[own], side="right") - 1
                inside = rank[own] - first[run]
                sequence[own] = start[run] + inside // n[run]
                offset[own] = base[run] + inside % n[run] * size
            kept = [batch.column(c) for c in ("doc_id", "piece", "start")]
            kept += [batch.column("length").cast(pa.int64()), batch.column("ids_crc32")]
            kept += [pa.array(sequence), pa.array(offset)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays(kept, names)

    ranked = pieces.join(starts, ["length", "_part"]).withColumn("_at", F.col("_rank") + F.col("_first"))
    return ranked.mapInArrow(
        place,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
