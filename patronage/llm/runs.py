"""Periodic runs of words: stretches that repeat with a smallest period, found in n log n steps.

A suffix automaton takes a document's words one by one. Each of its states keeps the end of the last occurrence of
its strings; the states whose strings end at the new word are the path from the new state to the root of the suffix
links, and all of them get the new end. A link-cut tree holds the states in paths of equal last end, so that the
change walks over segments of the path and not over states (the access of the tree, amortised logarithmic). A
segment of strings up to length l whose last end lies p words back, with p among the segment's lengths, is a square
of period p that ends here, and p is the smallest period of it, because a shorter one would have left a more recent
end. Such squares at consecutive words are one run.

A word of a run occurs again one period away. So before, a document is cut at words that occur once in their piece,
again and again until none is left; pieces too short for a run go. The runs lie in what remains.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 12
SLICE_BYTES = 16_000_000  # texts are taken in slices of about this size, at least one text each


def squares(words: list[int]) -> Iterator[tuple[int, int, int]]:
    """(end, period, length) of every square with a smallest period, in order of its end; ``length`` is how many
    words up to ``end`` have the period, less the period itself."""
    size = 2 * len(words) + 1
    length, link = [0] * size, [-1] * size
    follow: list[dict[int, int] | None] = [None] * size
    follow[0] = {}
    # the link-cut tree: parent, left (shallower) and right (deeper); seen holds a path's last end at its splay root
    up, left, right, seen = [-1] * size, [-1] * size, [-1] * size, [-1] * size

    def splay(x: int) -> None:
        p = up[x]
        while p >= 0 and (left[p] == x or right[p] == x):
            g = up[p]
            inner = g >= 0 and (left[g] == p or right[g] == p)
            if not inner:
                seen[x] = seen[p]
                _rotate(x, p)
            elif (left[g] == p) == (left[p] == x):
                root = up[g]
                if not (root >= 0 and (left[root] == g or right[root] == g)):
                    seen[x] = seen[g]
                _rotate(p, g)
                _rotate(x, p)
            else:
                root = up[g]
                if not (root >= 0 and (left[root] == g or right[root] == g)):
                    seen[x] = seen[g]
                _rotate(x, p)
                _rotate(x, g)
            p = up[x]

    def _rotate(x: int, p: int) -> None:
        g = up[p]
        if left[p] == x:
            inside = right[x]
            left[p], right[x] = inside, p
        else:
            inside = left[x]
            right[p], left[x] = inside, p
        if inside >= 0:
            up[inside] = p
        up[p], up[x] = x, g
        if g >= 0:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    last, states = 0, 1
    for i, word in enumerate(words):
        new, states = states, states + 1
        length[new], follow[new] = i + 1, {}
        p = last
        while p >= 0 and word not in follow[p]:
            follow[p][word] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = follow[p][word]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone, states = states, states + 1
                length[clone], follow[clone], link[clone] = length[p] + 1, dict(follow[q]), link[q]
                while p >= 0 and follow[p].get(word) == q:
                    follow[p][word] = clone
                    p = link[p]
                link[q] = link[new] = clone
                # the clone joins the path of q, just above q
                splay(q)
                above = left[q]
                left[clone], left[q], up[clone] = above, clone, q
                if above >= 0:
                    up[above] = clone
        last = new
        below, x = new, link[new]
        up[new] = x
        segment = -1  # the deepest state of the segment below, whose shortest string is known only now
        while x >= 0:
            splay(x)
            if segment >= 0:
                period, most = i - seen_below, length[segment]
                if length[x] < period <= most:
                    yield i, period, most
            segment, seen_below = (x, seen[x]) if length[x] else (-1, -1)
            deeper = right[x]
            if deeper >= 0:
                seen[deeper] = seen[x]
            right[x], below = below, x
            x = up[x]
        if segment >= 0:
            period, most = i - seen_below, length[segment]
            if period <= most:
                yield i, period, most
        splay(new)
        seen[new] = i


def find_runs(words: list[int], least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least two periods and ``least`` words, by start, then period."""
    found: list[tuple[int, int, int]] = []
    growing: dict[int, list[int]] = {}

    def close(period: int, start: int, end: int) -> None:
        if end - start + 1 >= least:
            found.append((start, end - start + 1, period))

    for end, period, most in squares(words):
        run = growing.get(period)
        if run is not None and run[1] == end - 1:
            run[1] = end
            continue
        if run is not None:
            close(period, *run)
        growing[period] = [end - period - most + 1, end]
    for period, run in growing.items():
        close(period, *run)
    return sorted(found, key=lambda r: (r[0], r[2]))


def pieces(ids: np.ndarray, owner: np.ndarray, least: int = LEAST_WORDS) -> Iterator[tuple[int, int]]:
    """(begin, end) of the stretches that can hold runs: within one owner, ``least`` words or more, and every word
    at least twice in its stretch. ``owner`` rises."""
    place = np.arange(len(ids))
    piece = owner.astype(np.int64)
    while len(place):
        key = piece * (int(ids.max()) + 1) + ids[place]
        order = np.argsort(key)
        ordered = key[order]
        new = np.ones(len(ordered) + 1, dtype=bool)
        new[1:-1] = ordered[1:] != ordered[:-1]
        once = np.zeros(len(place), dtype=bool)
        once[order[new[1:] & new[:-1]]] = True
        kept, piece = place[~once], piece[~once]
        if not len(kept):
            return
        starts = np.ones(len(kept), dtype=bool)
        starts[1:] = (kept[1:] != kept[:-1] + 1) | (piece[1:] != piece[:-1])
        piece = np.cumsum(starts) - 1
        sizes = np.bincount(piece)
        large = sizes[piece] >= least
        stable = not once.any() and large.all()
        place, piece = kept[large], piece[large]
        if stable:
            edges = [*np.flatnonzero(starts).tolist(), len(place)]
            for a, b in zip(edges, edges[1:]):
                yield int(place[a]), int(place[b - 1]) + 1
            return


def planted(words: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The words with the repetition that a tenth of all ids asks for; a null id asks for none."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    out = words.copy()
    out[a:] = words[a + np.arange(n - a) % period]
    return out


def _digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


_COLUMNS = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    for batch in batches:
        ids, texts = batch.column(0), pc.fill_null(batch.column(1), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < len(texts):
            before = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, side="right")))
            yield ids[begin:end], texts[begin:end]
            begin = end


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of all texts as numbers, the bounds of the texts among them, and the words behind the numbers."""
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    filled = pc.greater(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(filled)])
    coded = values.filter(pa.array(filled)).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), before[offsets - offsets[0]], coded.dictionary


def _judge(ids: pa.Array, texts: pa.Array, plant: bool, least: int) -> pa.RecordBatch:
    numbers, bounds, dictionary = _words(texts)
    doc_ids = ids.to_pylist()
    if plant:
        for doc, doc_id in enumerate(doc_ids):
            own = slice(bounds[doc], bounds[doc + 1])
            numbers[own] = planted(numbers[own], doc_id)
    owner = np.repeat(np.arange(len(doc_ids)), np.diff(bounds))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in doc_ids]
    keep = np.ones(len(numbers), dtype=bool)
    for begin, end in pieces(numbers, owner, least):
        doc = int(owner[begin])
        for start, length, period in find_runs(numbers[begin:end].tolist(), least):
            runs[doc].append((begin - int(bounds[doc]) + start, length, period))
            keep[begin + start + period : begin + start + length] = False
    kept = np.concatenate([[0], np.cumsum(keep)])[bounds]
    words = dictionary.cast(pa.binary()).take(pa.array(numbers[keep]))
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words), b" ")
    rows = []
    for own in runs:
        own.sort(key=lambda r: (r[0], r[2]))
        best = min(own, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{start},{length},{period}\n" for start, length, period in own)
        longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        rows.append((len(own), *longest, _digest(lines.encode())))
    numbers_of = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
    columns = [
        ids.cast(pa.int64()),
        *numbers_of,
        pa.array([r[5] for r in rows], pa.string()),
        pa.array([_digest(text.as_py()) for text in collapsed], pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _COLUMNS.split(", ")])


def detect_runs(docs: DataFrame, plant: bool = False, least: int = LEAST_WORDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its periodic runs of words and what is left without the repeats.

    Words are parted by ASCII white space; a run has at least two of its smallest periods and ``least`` words, and
    no neighbouring word extends it. ``start``, ``length`` and ``period`` are those of the longest run (then the
    first, then the smallest period) and null without runs; ``exponent_milli`` is 1000 length / period. The digests
    are of all runs as lines ``start,length,period`` and of the words outside the repeats, joined by one space.
    ``plant`` writes a repetition into a tenth of the documents first, by their id, so that there are runs to find.

    A null or empty text has no words and no runs. Repeated rows and rows without doc_id count for themselves (the
    latter get no repetition); other columns are ignored; an empty table gives no rows.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _slices(batches):
            yield _judge(ids, texts, plant, least)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judge, _COLUMNS)
