"""License scan: winnowed fingerprints pick candidates, banded alignment confirms and measures them.

The templates' fingerprints, the least hash of every few consecutive word k-grams, form an inverted index from
hash to (template, place). A text's own k-grams are winnowed in the same way and looked up; hits of one template on
nearby diagonals are a candidate. Around a candidate the template is aligned with the text inside a band, which
allows for inserted, left-out and changed words. Candidates of one template that fail alone are chained, so that a long
insertion or gap does not hide it. A match needs the words by which its template differs from others; of overlapping
matches the one with most words stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.license_texts import DISTINCT, QUALIFIERS, TEMPLATES

GRAM = 3
WINDOW = 3
BAND = 12  # at most; a short template has a band of a quarter of its words
COVERAGE = 0.75
CHAIN_WORDS = 100  # a chain's insertions have at most so many words each, or as many as the template
HIT_WORDS = 40  # a match of a whole text has a hit for so many of its words, on average
NOTICE_WORDS = 120  # a longer template names other licenses in passing, so foreign qualifiers say nothing there

_WORDS = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)

_RESULT = "doc_id long, license string, coverage double, n_matched int, start long, end long"


def _hashes(numbers: np.ndarray) -> np.ndarray:
    """One hash per k-gram of word numbers."""
    n = len(numbers) - GRAM + 1
    total = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(GRAM if n > 0 else 0):
        total = total * _BASE + numbers[k : k + n].astype(np.uint64) + np.uint64(2)
        total ^= total >> np.uint64(29)
    return total


def winnow(hashes: np.ndarray) -> np.ndarray:
    """Places of the least hash, the last one if several, in every window of ``WINDOW`` hashes."""
    if len(hashes) <= WINDOW:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))] if len(hashes) else [], dtype=np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)
    return np.unique(np.arange(len(windows)) + WINDOW - 1 - np.argmin(windows[:, ::-1], axis=1))


class Candidate(NamedTuple):
    """Where in the text a template would begin, its first and last k-gram that hit there, and how many hit."""

    begin: int
    low: int
    high: int
    hits: int


class Index:
    """The templates' words, and the inverted index of their fingerprints. Its size is that of the templates."""

    def __init__(self, templates: Mapping[str, str]):
        self.number: dict[str, int] = {}
        self.names = sorted(templates)
        self.words: list[np.ndarray] = []
        self.bits: list[dict[int, int]] = []
        self.counts: list[tuple[np.ndarray, np.ndarray]] = []
        self.foreign: list[np.ndarray] = []
        self.places: dict[int, list[tuple[int, int]]] = {}
        qualifiers = {w: self.number.setdefault(w, len(self.number)) for w in sorted(QUALIFIERS)}
        for t, name in enumerate(self.names):
            words = _WORDS.findall(templates[name].lower())
            own = np.array([self.number.setdefault(w, len(self.number)) for w in words], dtype=np.int64)
            self.words.append(own)
            asked = DISTINCT.get(name, "").split() if templates[name] == TEMPLATES.get(name) else []
            self.bits.append({words.index(w): 1 << k for k, w in enumerate(asked)})
            self.counts.append(np.unique(own, return_counts=True))
            strange = qualifiers.values() if len(own) <= NOTICE_WORDS else ()
            self.foreign.append(np.array(sorted(set(strange) - set(own.tolist())), dtype=np.int64))
            hashes = _hashes(own)
            # A short template's few k-grams are all kept, so that a text's choice can't miss them.
            chosen = winnow(hashes) if len(hashes) > 4 * WINDOW else range(len(hashes))
            for at in chosen:
                self.places.setdefault(int(hashes[at]), []).append((t, int(at)))

    def candidates(self, numbers: np.ndarray) -> dict[int, list[Candidate]]:
        """The candidates of each template, one per stretch of text."""
        hits: dict[int, list[tuple[int, int]]] = {}
        known = numbers >= 0
        grams = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(known, GRAM).all(axis=1))
        if not len(grams):
            return {}
        hashes = _hashes(numbers)
        # Winnowed within each stretch of known words; no k-gram outside them is in the index.
        for stretch in np.split(grams, np.flatnonzero(np.diff(grams) > 1) + 1):
            for at in stretch[winnow(hashes[stretch])].tolist():
                for t, place in self.places.get(int(hashes[at]), ()):
                    hits.setdefault(t, []).append((at - place, place))
        out: dict[int, list[Candidate]] = {}
        for t, begins in hits.items():
            begins.sort()
            own = out.setdefault(t, [])
            for begin, place in begins:
                if not own or begin - own[-1].begin > band(self.words[t]):
                    own.append(Candidate(begin, place, place, 0))
                last = own[-1]
                own[-1] = Candidate(last.begin, min(last.low, place), max(last.high, place), last.hits + 1)
        return out


def band(template: np.ndarray) -> int:
    return min(BAND, max(2, len(template) // 4))


def align(template: np.ndarray, text: np.ndarray, begin: int) -> tuple[int, int, int]:
    """Most words of ``template`` matched in order near the diagonal from ``begin``: (matched, first, last + 1).

    Cell d of row i stands for text word begin + i + d - band; words outside the text match nothing.
    """
    return _align(template, text, begin, band(template), {})[:3]


def _align(
    template: np.ndarray, text: np.ndarray, begin: int, half: int, bits: Mapping[int, int]
) -> tuple[int, int, int, int]:
    """As ``align``, with the bits of the matched template words."""
    width = 2 * half + 1
    score = np.zeros(width, dtype=np.int64)
    first = np.full(width, -1, dtype=np.int64)
    last = np.full(width, -1, dtype=np.int64)
    mask = np.zeros(width, dtype=np.int64)
    for i, word in enumerate(template.tolist()):
        at = begin + i - half
        places = np.arange(at, at + width)
        inside = (places >= 0) & (places < len(text))
        equal = np.zeros(width, dtype=bool)
        equal[inside] = text[places[inside]] == word
        hit = score + 1
        # Left-out template word: the cell to the right in the row before.
        skip = np.append(score[1:], -1)
        better = ~equal & (skip > score)
        take = np.where(better, np.minimum(np.arange(width) + 1, width - 1), np.arange(width))
        first, last, mask = first[take], last[take], mask[take]
        now = np.where(equal, hit, np.where(better, skip, score))
        first = np.where(equal & (first < 0), places, first)
        last = np.where(equal, places, last)
        if i in bits:
            mask = np.where(equal, mask | bits[i], mask)
        # Inserted text words: cells to the left in this row.
        best = np.maximum.accumulate(now)
        source = np.maximum.accumulate(np.where(now == best, np.arange(width), 0))
        score, first, last, mask = now[source], first[source], last[source], mask[source]
    end = int(np.argmax(score))
    return int(score[end]), int(first[end]), int(last[end]) + 1, int(mask[end])


def chain(candidates: list[Candidate], most: int) -> list[int]:
    """The candidates, rising in text and template with at most ``most`` words inserted between, that have most hits."""
    order = sorted(range(len(candidates)), key=lambda k: candidates[k].begin + candidates[k].low)
    best: list[tuple[int, int]] = []
    for j, own in enumerate(order):
        now, found = candidates[own], (candidates[own].hits, -1)
        for i in range(j):
            before = candidates[order[i]]
            inserted = now.begin + now.low - before.begin - before.high - GRAM
            if before.high < now.low and 0 <= inserted <= most + now.low - before.high:
                found = max(found, (best[i][0] + now.hits, i))
        best.append(found)
    at = max(range(len(best)), key=lambda k: best[k][0], default=-1)
    out = []
    while at >= 0:
        out.append(order[at])
        at = best[at][1]
    return out[::-1]


def _prefixes(template: np.ndarray, text: np.ndarray, begin: int, half: int) -> np.ndarray:
    """Most words matched near the diagonal of each prefix of ``template``, from the empty one on."""
    score = np.zeros(2 * half + 1, dtype=np.int64)
    out = [0]
    for i, word in enumerate(template.tolist()):
        places = np.arange(begin + i - half, begin + i + half + 1)
        inside = (places >= 0) & (places < len(text))
        equal = inside.copy()
        equal[inside] = text[places[inside]] == word
        score = np.maximum.accumulate(np.where(equal, score + 1, np.maximum(score, np.append(score[1:], 0))))
        out.append(int(score[-1]))
    return np.array(out)


def align_chain(
    template: np.ndarray, text: np.ndarray, pieces: list[Candidate], bits: Mapping[int, int]
) -> tuple[int, int, int, int]:
    """As ``_align``, each part of the template near its own piece's diagonal, cut where most words match."""
    half = band(template)
    cuts = [0]
    for one, two in zip(pieces, pieces[1:]):
        part = template[one.high : two.low]
        before = _prefixes(part, text, one.begin + one.high, half)
        after = _prefixes(part[::-1], text[::-1], len(text) - two.begin - two.low, half)[::-1]
        cuts.append(one.high + int(np.argmax(before + after)))
    cuts.append(len(template))
    total, mask, first, last = 0, 0, -1, 0
    for k, piece in enumerate(pieces):
        a, b = cuts[k], cuts[k + 1]
        # No text word counts in two parts.
        until = pieces[k + 1].begin + pieces[k + 1].low if k + 1 < len(pieces) else len(text)
        own = {i - a: bit for i, bit in bits.items() if a <= i < b}
        found = _align(template[a:b], text[last:until], piece.begin + a - last, half, own)
        if found[0]:
            first = first if total else found[1] + last
            total, mask, last = total + found[0], mask | found[3], found[2] + last
    return total, first, last, mask


def _matches(numbers: np.ndarray, index: Index, coverage: float) -> Iterator[tuple[int, int, int, int]]:
    """(template, first and last + 1 word, matched words) of all matches, alone or chained; they may overlap."""
    there = None
    for t, candidates in index.candidates(numbers).items():
        template, bits = index.words[t], index.bits[t]
        if there is None:
            there = np.bincount(numbers[numbers >= 0], minlength=len(index.number))
        # No alignment can match more words than the two have in common.
        word, count = index.counts[t]
        if np.minimum(there[word], count).sum() < coverage * len(template):
            continue

        def passes(found: tuple[int, int, int, int]) -> bool:
            matched, first, last, mask = found
            if matched == 0 or matched < coverage * len(template) or mask != (1 << len(bits)) - 1:
                return False
            return not np.isin(numbers[first:last], index.foreign[t]).any()

        # Whole texts share single k-grams with any prose; a match has far more hits than that.
        least = len(template) // HIT_WORDS if len(template) > NOTICE_WORDS else 1
        left, spans = [], []
        for candidate in sorted(candidates, key=lambda c: -c.hits):
            at = candidate.begin + candidate.low
            if any(a <= at < b for a, b in spans):
                continue
            if candidate.hits >= least:
                found = _align(template, numbers, candidate.begin, band(template), bits)
                if passes(found):
                    spans.append(found[1:3])
                    yield t, found[1], found[2], found[0]
                    continue
            left.append(candidate)
        most = max(CHAIN_WORDS, len(template))
        while len(pieces := chain(left, most)) > 1 and sum(left[k].hits for k in pieces) >= least:
            found = align_chain(template, numbers, [left[k] for k in pieces], bits)
            if passes(found):
                yield t, found[1], found[2], found[0]
            left = [c for k, c in enumerate(left) if k not in pieces]


def scan_text(text: str, index: Index, coverage: float) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, matched words, first and last + 1 character) of each match, in order of place."""
    lowered = text.lower()
    words = _WORDS.findall(lowered)
    if len(words) < GRAM:
        return []
    get = index.number.get
    numbers = np.array([get(w, -1) for w in words], dtype=np.int64)
    found = []
    spans = None
    for t, first, last, matched in _matches(numbers, index, coverage):
        template = index.words[t]
        if spans is None:
            # Lower case may change the length of a text; spans count characters of the text itself.
            same = len(lowered) == len(text)
            spans = [m.span() for m in _WORDS.finditer(lowered if same else text)]
            if len(spans) != len(words):
                spans = [m.span() for m in _WORDS.finditer(lowered)]
        found.append((matched / len(template), matched, t, spans[first][0], spans[last - 1][1]))
    found.sort(key=lambda f: (-f[1], -f[0], f[4] - f[3], f[2], f[3]))
    kept: list[tuple] = []
    for one in found:
        if not any(2 * (min(one[4], k[4]) - max(one[3], k[3])) > min(one[4] - one[3], k[4] - k[3]) for k in kept):
            kept.append(one)
    kept.sort(key=lambda f: (f[3], f[4], f[2]))
    return [(index.names[t], share, matched, start, end) for share, matched, t, start, end in kept]


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row per match of a template in ``docs`` (doc_id, text): how much of it is there, and where.

    A match has at least ``coverage`` of the template's words in order, near one diagonal or a chain of them, and
    the words that tell it from other licenses. A text without matches, a null or an empty one gives no rows; a text
    with several gives several, also of one template in different places; of matches that overlap by more than half of
    the shorter, only the one with most words is given. Templates shorter than three words are never found. Repeated rows give repeated rows,
    other columns are ignored.

    Columns: doc_id, license, coverage, n_matched, start, end (characters, end exclusive).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        types = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
        names = ["doc_id", "license", "coverage", "n_matched", "start", "end"]
        for batch in batches:
            rows = [
                (doc_id, *match)
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1))
                for match in scan_text(text.as_py() or "", index, coverage)
            ]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _RESULT)
