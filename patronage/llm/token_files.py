"""Token-id files: the ids of whole documents, range coded in blocks, in ascending order of doc_id.

A file is a Parquet table of segments, so that Spark's own commit makes a rewritten or failed task harmless. A
segment holds whole documents and is made of: a fixed head, the documents' ids and lengths, a directory of
blocks, and the coded blocks. Each block is coded and checked on its own; the parts before them have a checksum,
too. A reader can take any segment alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patronage.llm import range_coder
from patronage.llm.tokens import BYTE_BPE, encoder
from patronage.session import fresh_folder

END_ID = 2
BLOCK_IDS = 1 << 22  # a block has at least as many, unless its segment is shorter, and less than twice as many
SEGMENT_IDS = BLOCK_IDS  # a segment closes with the document that reaches it

_MAGIC = b"TIDS"
_HEAD = struct.Struct("<4sHHIQ")  # magic, version, groups of four bits, documents, ids
_BLOCK = np.dtype([("ids", "<u4"), ("size", "<u4"), ("crc32", "<u4")])
_VERSION = 2


class _Segment:
    """A segment while its documents are gathered."""

    def __init__(self, first: int):
        self.first = first  # ids of this task before the segment
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.parts: list[bytes] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.parts.append(ids)
        self.size += len(ids) // 4

    def blocks(self) -> list[np.ndarray]:
        return np.array_split(np.frombuffer(b"".join(self.parts), dtype="<u4"), max(1, self.size // BLOCK_IDS))


def _segment_bytes(segment: _Segment, groups: int) -> bytes:
    blocks = segment.blocks()
    coded = range_coder.encode(blocks, groups)
    directory = np.array(
        [(len(b), len(c), range_coder.checksum(b)) for b, c in zip(blocks, coded)], dtype=_BLOCK
    )
    known = np.array([d is not None for d in segment.doc_ids], dtype=np.uint8)
    before = b"".join(
        [
            _HEAD.pack(_MAGIC, _VERSION, groups, len(segment.doc_ids), segment.size),
            known.tobytes(),
            np.array([d or 0 for d in segment.doc_ids], dtype="<i8").tobytes(),
            np.array(segment.lengths, dtype="<u8").tobytes(),
            struct.pack("<I", len(blocks)),
            directory.tobytes(),
        ]
    )
    return b"".join([before, struct.pack("<I", zlib.crc32(before)), *coded])


def read_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, list[bytes], int]:
    """doc_ids, lengths, block directory, coded blocks and groups of a segment; raises on any damage to them."""
    magic, version, groups, documents, _ = _HEAD.unpack_from(data)
    if magic != _MAGIC or version != _VERSION:
        raise ValueError("not a segment of token ids")
    at = _HEAD.size
    known = np.frombuffer(data, np.uint8, documents, at)
    at += documents
    doc_ids = np.frombuffer(data, "<i8", documents, at).tolist()
    at += 8 * documents
    lengths = np.frombuffer(data, "<u8", documents, at).astype(np.int64)
    at += 8 * documents
    (count,) = struct.unpack_from("<I", data, at)
    directory = np.frombuffer(data, _BLOCK, count, at + 4)
    at += 4 + _BLOCK.itemsize * count
    if struct.unpack_from("<I", data, at)[0] != zlib.crc32(data[:at]):
        raise ValueError("damaged head of a segment")
    ends = at + 4 + np.cumsum(directory["size"].astype(np.int64))
    coded = [data[end - size : end] for end, size in zip(ends.tolist(), directory["size"].tolist())]
    return [d if k else None for d, k in zip(doc_ids, known)], lengths, directory, coded, groups


def write(docs: DataFrame, path: str, tokenizer: str = BYTE_BPE, end_id: int = END_ID) -> None:
    """Writes the ids of every whole text of ``docs`` (doc_id, text), each document closed by ``end_id``.

    Documents are in ascending order of doc_id through all parts; null doc_ids come first, and rows repeated
    with one doc_id are documents of their own. Null texts count as empty. No documents give an empty file.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = encoder(tokenizer, spaces_kept=True)
        groups = (encode.largest_id.bit_length() + 3) // 4

        def row(segment: _Segment) -> pa.RecordBatch:
            values = [part, segment.first, segment.size, _segment_bytes(segment, groups)]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            names = ["part", "first", "n_ids", "data"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

        segment = _Segment(0)
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode.encode_pieces(batch.column(1))):
                segment.add(doc_id, ids + end)
                if segment.size >= SEGMENT_IDS:
                    yield row(segment)
                    segment = _Segment(segment.first + segment.size)
        if segment.size:
            yield row(segment)

    same = F.xxhash64("text")
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id", same)
    ordered = ordered.sortWithinPartitions("doc_id", same)
    ordered.mapInArrow(run, "part int, first long, n_ids long, data binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a file: doc_id, start, n_tokens, ids_crc32. Every block is decoded and checked.

    ``start`` counts the ids of all documents before it; a file knows them per task, so only one number per
    writing task is summed up here and sent to the readers.
    """
    files = spark.read.schema("part int, first long, n_ids long, data binary").parquet(path)
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = {r[0]: r[1] for r in sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0))).collect()}
    start_of = spark.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def decoded(start: int, data: bytes) -> pa.RecordBatch:
            doc_ids, lengths, directory, coded, groups = read_segment(data)
            found = range_coder.decode(coded, directory["ids"], groups)
            if any(range_coder.checksum(i) != crc32 for i, crc32 in zip(found, directory["crc32"].tolist())):
                raise ValueError("damaged block of token ids")
            ids, ends = np.concatenate(found), np.cumsum(lengths)
            checks = [range_coder.checksum(ids[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist())]
            columns = [doc_ids, start + ends - lengths, lengths, checks]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for batch in batches:
            for part, first, data in zip(*(batch.column(k) for k in (0, 1, 3))):
                yield decoded(start_of.value[part.as_py()] + first.as_py(), data.as_py())

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, tokenizer: str = BYTE_BPE, end_id: int = END_ID) -> DataFrame:
    """Writes the file of ``docs`` below the shared checkpoint folder and reads it back."""
    path = fresh_folder(docs.sparkSession, "token-ids")
    write(docs, path, tokenizer, end_id)
    return read(docs.sparkSession, path)
