"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

One Aho-Corasick pass over a word finds the longest token that starts at each place. From left to right the
longest match is taken if it may follow the token before it; if not, its next shorter prefix token is tried, and
if there is none, the token before it is taken back. Two tokens may stand side by side if merging by rank could
have left the border between them alone; that table of pairs is filled as pairs are met. A place that turned out
to be a dead end is never tried again, so each word takes linear time.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.tokens import BYTE_BPE, ChunkEncoder, tokenizer_path

# Fixed value: the published pattern of this tokenizer family, with white space spelled out.
WORD_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
CACHED_PAIRS = 1_000_000
_MODELS: dict[str, "BacktrackingBpe"] = {}


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, mapped back to the byte.

    Printable Latin-1 characters stand for themselves, the others for the characters from 256 on, in order.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class BacktrackingBpe(ChunkEncoder):
    """A byte-level vocabulary file in the forms that encoding and decoding need."""

    def __init__(self, name: str):
        import ahocorasick
        import regex

        with open(name if "/" in name else tokenizer_path(name), encoding="utf-8") as file:
            described = json.load(file)
        symbols = byte_symbols()
        vocabulary: dict[str, int] = described["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        super().__init__(True, self.special)
        size = max([*vocabulary.values(), *self.special.values()]) + 1
        content = [b""] * size
        for token, number in vocabulary.items():
            if token not in self.special:
                content[number] = bytes(symbols[c] for c in token)
        by_content = {c: i for i, c in enumerate(content) if c}
        for token, number in self.special.items():
            content[number] = token.encode()
        self.length = [len(c) for c in content]
        self.offset = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        self.joined = np.frombuffer(b"".join(content), dtype=np.uint8)

        # A token's age is its place among the merges; single bytes come before all of them.
        self._age = [-1] * size
        self._halves: list[tuple[int, int] | None] = [None] * size
        self._merged: dict[tuple[int, int], int] = {}
        for age, pair in enumerate(described["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            halves, made = (vocabulary[left], vocabulary[right]), vocabulary[left + right]
            self._merged.setdefault(halves, age)
            if self._halves[made] is None:
                self._age[made], self._halves[made] = age, halves

        automaton = ahocorasick.Automaton()
        self._shorter = [-1] * size
        for token, number in by_content.items():
            automaton.add_word(token.decode("latin-1"), (len(token), number))
            for end in range(len(token) - 1, 0, -1):
                if (prefix := by_content.get(token[:end])) is not None:
                    self._shorter[number] = prefix
                    break
        automaton.make_automaton()
        self._matches = automaton.iter
        self._words = regex.compile(WORD_PATTERN).findall
        self._cut = regex.compile("|".join(map(regex.escape, self.special))).split if self.special else None
        self._special_of = regex.compile("|".join(map(regex.escape, self.special))).findall if self.special else None
        self._pairs: dict[tuple[int, int], bool] = {}

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves the border between two tokens alone.

        The merges inside both tokens are undone from the latest back; the border would have been merged if,
        at some stage, the two parts at it form a pair that is merged before the undone step.
        """
        found = self._pairs.get((left, right))
        if found is not None:
            return found
        key, good = (left, right), True
        until: tuple[int, int] = (len(self._age), 0)
        while True:
            age = self._merged.get((left, right))
            if age is not None and (age, 0) < until:
                good = False
                break
            if self._age[left] < 0 and self._age[right] < 0:
                break
            # Of two steps of equal age the left one came first, so the right one is undone first.
            if self._age[right] >= self._age[left]:
                until = (self._age[right], 1)
                right = self._halves[right][0]
            else:
                until = (self._age[left], 0)
                left = self._halves[left][1]
        if len(self._pairs) >= CACHED_PAIRS:
            self._pairs.clear()
        self._pairs[key] = good
        return good

    def _word(self, word: str) -> list[int]:
        raw = word.encode("utf-8").decode("latin-1")
        n = len(raw)
        longest = [(0, -1)] * n
        for end, (length, token) in self._matches(raw):
            start = end - length + 1
            if length > longest[start][0]:
                longest[start] = (length, token)
        if longest[0][0] == n:
            return [longest[0][1]]
        length_of, shorter, may_follow = self.length, self._shorter, self._may_follow
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0][1]
        while at < n:
            while token >= 0:
                end = at + length_of[token]
                if not dead[end] and (not out or may_follow(out[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at][1] if at < n else -1
            else:
                dead[at] = 1
                last = out.pop()
                at -= length_of[last]
                token = shorter[last]
        return out

    def _plain(self, text: str) -> bytes:
        ids: list[int] = []
        for word in self._words(text):
            ids += self._word(word)
        return array("I", ids).tobytes()

    def whole(self, text: str) -> bytes:
        """The strings of special tokens become those tokens."""
        if self._cut is None or not any(token in text for token in self.special):
            return self._plain(text)
        between = [self._plain(part) for part in self._cut(text)]
        marks = [array("I", [self.special[t]]).tobytes() for t in self._special_of(text)]
        return b"".join(part for pair in zip(between, [*marks, b""]) for part in pair)

    def chunks(self, new: list[str]) -> dict[str, bytes]:
        return {chunk: self._plain(" " + chunk) for chunk in new}

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a run of ids, gathered through the offset table."""
        if not len(ids):
            return b""
        start, length = self.offset[ids], self.offset[ids + 1] - self.offset[ids]
        end = np.cumsum(length)
        return self.joined[np.repeat(start - (end - length), length) + np.arange(end[-1])].tobytes()


def model(name: str) -> BacktrackingBpe:
    """This worker's tables for a vocabulary file, built once."""
    if name not in _MODELS:
        _MODELS[name] = BacktrackingBpe(name)
    return _MODELS[name]


def encode(docs: DataFrame, vocabulary: str = BYTE_BPE) -> DataFrame:
    """(doc_id, ids array<long>) of every whole text of ``docs`` (doc_id, text); null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(vocabulary)
        for batch in batches:
            ids = [np.frombuffer(bpe.encode(t or ""), "<u4").astype(np.int64) for t in batch.column(1).to_pylist()]
            arrays = [batch.column(0), pa.array(ids, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<long>")


def decode(encoded: DataFrame, vocabulary: str = BYTE_BPE) -> DataFrame:
    """(doc_id, text) of every row of ``encoded`` (doc_id, ids); bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(vocabulary)
        for batch in batches:
            texts = [
                bpe.decode(np.array(ids or [], dtype=np.int64)).decode("utf-8", "replace")
                for ids in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str = BYTE_BPE) -> DataFrame:
    """Digests of the ids and of the decoded text of every row of ``docs`` (doc_id, text).

    Null and empty texts have no ids. Repeated rows and null doc_ids are rows of their own; other columns are
    ignored; an empty table gives no rows. Ids and text stay inside the task, so nothing is shuffled.

    Columns: doc_id, n_tokens, ids_sha256, decoded_sha256.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(vocabulary)
        sha = hashlib.sha256
        for batch in batches:
            counts, of_ids, of_texts = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                back = bpe.decode(np.frombuffer(ids, "<u4").astype(np.int64)).decode("utf-8", "replace")
                counts.append(len(ids) // 4)
                of_ids.append(sha(ids).hexdigest())
                of_texts.append(sha(back.encode("utf-8")).hexdigest())
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string())]
            arrays.append(pa.array(of_texts, pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
