"""Main text of web pages: what the mark-up says, and for all else a suffix array per host.

A page's blocks are of three kinds. Content lies in an ``article`` or ``main`` element; furniture lies in elements
that name another role (menus, footers, forms, adverts, comments, ...); all else is open. The text of a page with
content is taken from its content, that of other pages from the open blocks.

Both are judged by repetition. The blocks of a host's pages are one stream of tokens, the content of a page apart from
the rest; its suffixes, sorted by prefix doubling, show how many pages have each window of ``RUN_TOKENS`` tokens.

Open tokens in windows that several pages have outside their content are boilerplate, the unique runs between them
stay. A page that would lose everything is a copy of another page, not boilerplate, and keeps its open blocks.

Content is kept with more care, as articles quote and copy each other: only windows that ``CONTENT_PAGES`` pages or more
have count there, and only where all tokens in them are at most ``CONTENT_SHARE`` of the page's content. So a share line
or a notice goes, while an article that many pages copy, with changes or without, stays whole.

A host of more than ``GROUP_CHARS`` is dealt over several suffix arrays. A page lies in one array only, so the numbers of
pages summed over the arrays are those of the whole host, and the texts do not depend on how it was dealt. Only windows
that several arrays have and several pages have outside their content need such sums. They are found in two rounds: every
array hands on the leading bits of all its windows' hashes, about two bytes a window, and learns which of them may be
such windows; of these alone it hands on the 64-bit hashes with their numbers of pages. The parsed pages are dealt once,
their texts compressed, and read by both rounds and the judgement.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.reputation import url_host
from patronage.session import durable

CONTENT, OPEN, FURNITURE = 0, 1, 2
RUN_TOKENS = 8
CONTENT_PAGES = 10
CONTENT_SHARE = 0.25
GROUP_CHARS = 1_000_000  # of mark-up in one suffix array, about; a larger host is dealt over several
BUCKET_CHARS = 16_000_000  # of mark-up whose window hashes are compared in one group, about, at most
LEAST_BUCKETS = 16
SPARE_BITS = 3  # of the hashes' leading bits, beyond those that number a host's characters
_ZSTD = pa.Codec("zstd", compression_level=3)

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|template|noscript|textarea|select|iframe|canvas|title|annotation-xml|annotation|desc|metadata)\b"
    r"(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</?[a-z][^>]*(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
_HOLDERS = _BLOCK - frozenset("p h1 h2 h3 h4 h5 h6 hr".split())
_CONTENT = frozenset(("article", "main"))
_FURNITURE = frozenset("aside button dialog fieldset footer form head menu nav search".split())
_HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|login"
    r"|menu|nav|navbar|navigation|newsletter|notice|pagination|popup|promo|related|replies|share|sharing|sidebar"
    r"|social|sponsor(?:ed)?|subscribe|toolbar|widget|complementary|contentinfo|search|dialog|alert)(?=$|[\s_-])",
    re.IGNORECASE,
)
# In content, only containers are judged by names that consist of these words.
_CONTAINERS = frozenset("article aside details div dl ol section table ul".split())
_ROLES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer login menu nav navbar navigation newsletter notice pagination popup promo related replies share sharing "
    "sidebar social sponsor sponsored subscribe toolbar widget complementary contentinfo search dialog alert".split()
)
# Of ids, and of the classes of paragraphs, figures and spans in content, only these count: other names of furniture
# are also what headings and captions are called.
_CLEAR = frozenset(
    "ad ads advert adverts advertisement breadcrumb breadcrumbs comment comments consent cookie cookies disqus newsletter "
    "notice pagination popup promo replies sidebar sponsor sponsored subscribe".split()
)
_PLAIN = frozenset(
    "area articles bar block body box button buttons container content form group holder icons inner items link links "
    "list outer panel post posts reader readers section signup text thread user users wrap wrapper".split()
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_OWN_NAMES = re.compile(r"(?<![\w-])(?:class|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_OWN_IDS = re.compile(r"(?<![\w-])id\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_MAIN = re.compile(r"\brole\s*=\s*[\"']?main\b|\bitemprop\s*=\s*[\"']?articleBody\b", re.IGNORECASE)
_HIDDEN = re.compile(r"\shidden(?:[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)


def _names_a_role(name: str, roles: frozenset[str] = _ROLES) -> bool:
    """Whether a class or role as a whole names furniture: ``share`` and ``share-buttons``, not ``share-price``."""
    words = [w for w in re.split(r"[_-]+", name.lower()) if w]
    return any(w in roles for w in words) and all(w in _ROLES or w in _PLAIN for w in words)


def _has_name(names: re.Pattern, rest: str, roles: frozenset[str]) -> bool:
    return any(_names_a_role(n, roles) for found in names.findall(rest) for name in found for n in name.split())


def _is_hinted(tag: str, rest: str, inside: int) -> bool:
    if inside == CONTENT or tag in _CONTENT:
        if tag in _CONTAINERS:
            return _has_name(_OWN_NAMES, rest, _ROLES) or _has_name(_OWN_IDS, rest, _CLEAR)
        return tag in ("p", "figure", "span") and _has_name(_OWN_NAMES, rest, _CLEAR)
    return tag not in ("html", "body") and any(
        _HINT.search(name) for found in _NAMES.findall(rest) for name in found if name
    )


def _zone(tag: str, rest: str, inside: int, in_content: bool) -> int:
    if inside == FURNITURE:
        return FURNITURE
    if tag in _FURNITURE or tag == "header" and not in_content:
        return FURNITURE
    if "=" in rest or "hidden" in rest:
        if _HIDDEN.search(rest):
            return FURNITURE
        if _is_hinted(tag, rest, inside):
            return FURNITURE
        if _MAIN.search(rest):
            return CONTENT
    return CONTENT if tag in _CONTENT else inside


def parse(source: str | None) -> list[tuple[int, str]]:
    """The blocks of a page in order, as (kind, text); text is decoded, its white space single and trimmed."""
    blocks: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()  # the tags on the stack, so that looking for one that is not there costs nothing
    in_content = 0
    zone = OPEN

    def close_block() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                blocks.append((zone, text))

    def pop_to(index: int) -> None:
        nonlocal zone, in_content
        before = stack[index - 1][1] if index else OPEN
        if before != zone:
            close_block()
        for name, own in stack[index:]:
            opened[name] -= 1
            in_content -= own == CONTENT
        del stack[index:]
        zone = before

    at = 0
    source = source or ""
    for found in _MARKUP.finditer(source):
        if found.start() > at:
            parts.append(source[at : found.start()])
        at = found.end()
        if found["raw"]:
            if found["raw"].lower() == "title" and not opened["svg"]:
                close_block()
            continue
        if not found["tag"]:
            continue
        tag = found["tag"].lower()
        if tag in _BLOCK:
            close_block()
        elif tag in ("br", "wbr") and not found["end"]:
            parts.append("\n" if tag == "br" else "")
        if tag in _VOID:
            continue
        if found["end"]:
            if not opened[tag]:
                continue
            for index in range(len(stack) - 1, -1, -1):
                if stack[index][0] == tag:
                    pop_to(index)
                    break
                if stack[index][0] in _HOLDERS and tag not in _HOLDERS:
                    break
            continue
        if tag in _BLOCK:
            # A block closes an open paragraph, and an item an open item.
            for index in range(len(stack) - 1, -1, -1):
                name = stack[index][0]
                if name == "p" or name == tag and tag in ("li", "dt", "dd", "td", "th", "tr", "option"):
                    pop_to(index)
                    break
                if name in _HOLDERS:
                    break
        rest = found["rest"]
        new = _zone(tag, rest, zone, in_content > 0)
        if new != zone:
            close_block()
        if not rest.endswith("/") or tag in _BLOCK:
            stack.append((tag, new))
            opened[tag] += 1
            in_content += new == CONTENT
            zone = new
    if at < len(source):
        parts.append(source[at:])
    close_block()
    return blocks


def windows(tokens: np.ndarray, segment: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows of ``length`` tokens begin that lie in one segment, and a number from 0 for what each reads.

    ``tokens`` are the segments' tokens one after the other, ``segment`` the segment of each. Ranks of suffixes by their
    first 1, 2, 4, ... tokens come from sorting pairs of ranks. The windows are sorted by number, then by place.
    """
    n = len(tokens)
    if n < length:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    last = np.append(np.flatnonzero(segment[1:] != segment[:-1]), n - 1)
    end = np.repeat(last + 1, np.diff(np.append(-1, last)))
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    span = 1
    while span < length:
        step = min(span, length - span)
        after = np.zeros(n, dtype=np.int64)
        after[: n - step] = rank[step:]
        after[np.arange(n) + step >= end] = 0
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        span += step
    whole = np.flatnonzero(np.arange(n) + length <= end)
    order = whole[np.argsort(rank[whole], kind="stable")]
    return order, np.cumsum(np.append(0, rank[order][1:] != rank[order][:-1]))[: len(order)]


def pages_of(group: np.ndarray, page: np.ndarray, n: int) -> np.ndarray:
    """How many pages each of ``n`` groups has; ``group`` and the pages in a group rise."""
    if not len(group):
        return np.zeros(n, dtype=np.int64)
    new = np.append(True, (group[1:] != group[:-1]) | (page[1:] != page[:-1]))
    return np.bincount(group[new], minlength=n)


def covered(places: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of ``n`` tokens lie in the windows that begin at ``places``."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + length, -1)
    return np.cumsum(edge)[:n] > 0


def repeated(tokens: np.ndarray, page: np.ndarray, length: int) -> np.ndarray:
    """Which tokens lie in a run of ``length`` tokens or more that occurs on several pages."""
    places, group = windows(tokens, page, length)
    several = pages_of(group, page[places], len(places)) > 1
    return covered(places[several[group]], length, len(tokens))


class Stream:
    """The tokens of a host's pages, each page's content after its other blocks, and how many pages have each window."""

    def __init__(self, pages: Iterable[list[tuple[int, str]]], length: int = RUN_TOKENS):
        self.length = length
        self.words: list[str] = []
        self.spans: list[list[tuple[int, int, int]]] = []
        lengths: list[int] = []
        for blocks in pages:
            own = []
            for content in (False, True):
                before = len(self.words)
                for kind, text in blocks:
                    if (kind == CONTENT) == content:
                        parts = text.split(" ")
                        own.append((kind, len(self.words), len(self.words) + len(parts)))
                        self.words += parts
                lengths.append(len(self.words) - before)
            self.spans.append(own)
        self.lengths = np.array(lengths, dtype=np.int64)
        self.segment = np.repeat(np.arange(len(lengths)), lengths)
        self.tokens, self.names = pd.factorize(np.array(self.words, dtype=object))

    def counted(self) -> Stream:
        """The stream with the windows of its suffix array and their numbers of pages."""
        self.places, self.group = windows(self.tokens, self.segment, self.length)
        self.content = self.segment[self.places] % 2 == 1
        page = self.segment[self.places] // 2
        n = int(self.group[-1]) + 1 if len(self.group) else 0
        self.n_all = pages_of(self.group, page, n)
        self.n_open = pages_of(self.group[~self.content], page[~self.content], n)
        return self

    def _hashes_at(self, places: np.ndarray) -> np.ndarray:
        word = pd.util.hash_array(np.asarray(self.names, dtype=object), categorize=False) if len(self.names) else None
        total = np.zeros(len(places), dtype=np.uint64)
        for k in range(self.length if len(places) else 0):
            total = (total ^ word[self.tokens[places + k]]) * _MIX
            total ^= total >> np.uint64(32)
        return total

    def hashes(self) -> np.ndarray:
        """A hash of the words of each window, the same in every stream."""
        return self._hashes_at(self.places[np.flatnonzero(np.append(True, self.group[1:] != self.group[:-1])[: len(self.group)])])

    def leading(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct leading bits of all windows' hashes, rising, and how many pages have them outside their content.

        This takes no suffix array: what windows have in common but their leading bits does not matter here.
        """
        end = np.repeat(np.cumsum(self.lengths), self.lengths)
        places = np.flatnonzero(np.arange(len(end)) + self.length <= end)
        found = self._hashes_at(places) >> np.uint64(64 - bits)
        order = np.argsort(found, kind="stable")
        found, segment = found[order], self.segment[places[order]]
        new = np.append(True, found[1:] != found[:-1])[: len(found)]
        group, is_open = np.cumsum(new) - 1, segment % 2 == 0
        return found[new], pages_of(group[is_open], segment[is_open] // 2, int(new.sum()))

    def learn(self, known: np.ndarray, n_all: np.ndarray, n_open: np.ndarray) -> None:
        """Takes the host's numbers of pages for the windows whose hashes are ``known``, which are sorted."""
        own = self.hashes()
        at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
        same = known[at] == own if len(known) else np.zeros(len(own), dtype=bool)
        self.n_all[same], self.n_open[same] = n_all[at[same]], n_open[at[same]]

    def texts(self) -> list[str]:
        """The main text of each page."""
        several = self.n_open[self.group] > 1
        goes = np.where(self.content, several & (self.n_all[self.group] >= CONTENT_PAGES), several)
        gone = covered(self.places[goes], self.length, len(self.words))
        out = []
        for own in self.spans:
            wanted = CONTENT if any(kind == CONTENT for kind, _, _ in own) else OPEN
            own = [(a, b) for kind, a, b in own if kind == wanted]
            if wanted == CONTENT:
                for a, b in own:
                    gone[a:b] = gone[a:b].all()  # of an article whole blocks only
            whole = "\n\n".join(" ".join(self.words[a:b]) for a, b in own)
            lost = sum(int(gone[a:b].sum()) for a, b in own)
            if not lost or wanted == CONTENT and lost > CONTENT_SHARE * sum(b - a for a, b in own):
                out.append(whole)
                continue
            left = [" ".join(w for w, g in zip(self.words[a:b], gone[a:b]) if not g) for a, b in own]
            out.append("\n\n".join(filter(None, left)) or whole)
        return out


def _pages(frame: pd.DataFrame) -> Iterator[list[tuple[int, str]]]:
    for kinds, size, packed in zip(frame["kinds"], frame["size"], frame["texts"]):
        texts = _ZSTD.decompress(packed, decompressed_size=size, asbytes=True).decode() if size else ""
        yield list(zip(map(int, kinds), texts.split("\n")))


def _zipped(blocks: list[tuple[int, str]]) -> tuple[str, int, bytes]:
    """The kinds of a page's blocks, and the size and the compressed bytes of their texts."""
    texts = "\n".join(text for _, text in blocks).encode()
    return "".join(str(kind) for kind, _ in blocks), len(texts), _ZSTD.compress(texts, asbytes=True) if texts else b""


def _gaps(rising: np.ndarray) -> bytes:
    """Rising numbers by their differences: all lowest bytes, then all second ones, as far as there are any."""
    planes = np.diff(rising, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    used = int(planes.any(axis=1).nonzero()[0].max(initial=0)) + 1
    return bytes([used]) + planes[:used].tobytes()


def _from_gaps(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8, offset=1).reshape(packed[0], -1)
    wide = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    wide[:, : packed[0]] = planes.T
    return np.cumsum(wide.view("<u8")[:, 0], dtype=np.uint64)


def _edges(rising: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each of so many equal ranges of numbers of so many bits begins among rising ones, and the end."""
    ends = [np.uint64(-(-(b << bits) // buckets)) for b in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(rising, np.array(ends, dtype=np.uint64)), [len(rising)]]).astype(np.int64)


def suspects(frame: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """(part, flags) for the parts with any flag: the leading bits that several parts and several open pages have.

    ``frame`` has one row per part: its leading bits, and which of them one or two of its pages have outside content.
    """
    found = [_from_gaps(packed) for packed in frame["leading"]]
    number, parts = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)[1:]
    n_open = np.zeros(len(parts), dtype=np.int64)
    begin = 0
    for own, one, two in zip(found, frame["one"], frame["two"]):
        for packed in (one, two):
            n_open[number[begin : begin + len(own)]] += np.unpackbits(np.frombuffer(packed, np.uint8), count=len(own))
        begin += len(own)
    wanted = ((parts > 1) & (n_open > 1))[number]
    begin = 0
    for part, own in zip(frame["part"], found):
        flags = wanted[begin : begin + len(own)]
        begin += len(own)
        if flags.any():
            yield part, flags


_COUNTED = ("hashes", "n_all", "n_open")
_TYPES = (np.uint64, np.uint32, np.uint32)


def _packed(*columns: np.ndarray) -> tuple[bytes, ...]:
    return tuple(c.astype(t).tobytes() for c, t in zip(columns, _TYPES))


def _unpacked(frame: pd.DataFrame) -> list[np.ndarray]:
    """The columns of all rows, one after the other."""
    return [np.frombuffer(b"".join(frame[c]), dtype=t) for c, t in zip(_COUNTED, _TYPES)]


def shared_windows(frame: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, hashes, n_all, n_open) of the windows that several parts have, the numbers summed over the parts.

    ``frame`` has one row per part, with each window once.
    """
    hashes, n_all, n_open = _unpacked(frame)
    known, number, parts = np.unique(hashes, return_inverse=True, return_counts=True)
    total_all = np.bincount(number, n_all, len(known)).astype(np.int64)
    total_open = np.bincount(number, n_open, len(known)).astype(np.int64)
    begin = 0
    for part, packed in zip(frame["part"], frame["hashes"]):
        own = number[begin : begin + len(packed) // 8]
        begin += len(own)
        own = own[parts[own] > 1]
        if len(own):
            yield part, known[own], total_all[own], total_open[own]


def extract(pages: DataFrame, run_tokens: int = RUN_TOKENS) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html) with its main text.

    Blocks are joined by an empty line, in page order; a null or empty page, or one without main text, gives an
    empty text. Cut-off mark-up at the end of a page is left out. Repeated rows and rows without page_id are pages
    of their own; pages without a host share the empty one; other columns are ignored; an empty table gives no
    rows.

    Columns: page_id, url, text, n_chars.
    """
    host = F.coalesce(url_host(F.col("url")), F.lit("")).alias("host")
    own = pages.select(F.col("page_id").cast("long"), "url", "html", host)

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(zip(*(_zipped(parse(source.as_py())) for source in batch.column(6)))) or [(), (), ()]
            columns = [pa.array(c, t) for c, t in zip(made, (pa.string(), pa.int64(), pa.binary()))]
            names = ["host", "part", "buckets", "bits", "page_id", "url", "kinds", "size", "texts"]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(6)] + columns, names)

    def lead(group: pd.DataFrame) -> pd.DataFrame:
        buckets, bits = int(group["buckets"].iloc[0]), int(group["bits"].iloc[0])
        rows = []
        if buckets:
            found, n_open = Stream(_pages(group), run_tokens).leading(bits)
            edges = _edges(found, buckets, bits)
            host, part = group["host"].iloc[0], group["part"].iloc[0]
            for b, (i, k) in enumerate(zip(edges, edges[1:])):
                if k > i:
                    flags = (np.packbits(n_open[i:k] >= n).tobytes() for n in (1, 2))
                    rows.append((host, b, part, _gaps(found[i:k]), *flags))
        return pd.DataFrame(rows, columns=["host", "bucket", "part", "leading", "one", "two"])

    def suspect(group: pd.DataFrame) -> pd.DataFrame:
        host, bucket = group["host"].iloc[0], group["bucket"].iloc[0]
        rows = [(host, part, bucket, np.packbits(flags).tobytes()) for part, flags in suspects(group)]
        return pd.DataFrame(rows, columns=["host", "part", "bucket", "flags"])

    def count(group: pd.DataFrame, suspected: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(suspected):
            buckets, bits = int(group["buckets"].iloc[0]), int(group["bits"].iloc[0])
            stream = Stream(_pages(group), run_tokens).counted()
            hashes = stream.hashes()
            order = np.argsort(hashes)
            lead, number = np.unique(hashes[order] >> np.uint64(64 - bits), return_inverse=True)
            edges, wanted = _edges(lead, buckets, bits), np.zeros(len(lead), dtype=bool)
            for b, flags in zip(suspected["bucket"], suspected["flags"]):
                wanted[edges[b] : edges[b + 1]] = np.unpackbits(np.frombuffer(flags, np.uint8), count=edges[b + 1] - edges[b])
            order = order[wanted[number]]
            begins = _edges(hashes[order] >> np.uint64(64 - bits), buckets, bits)
            host, part = group["host"].iloc[0], group["part"].iloc[0]
            rows = [
                (host, b, part, *_packed(hashes[own], stream.n_all[own], stream.n_open[own]))
                for b, (i, k) in enumerate(zip(begins, begins[1:]))
                if len(own := order[i:k])
            ]
        return pd.DataFrame(rows, columns=["host", "bucket", "part", *_COUNTED])

    def share(group: pd.DataFrame) -> pd.DataFrame:
        host = group["host"].iloc[0]
        rows = [(host, part, *_packed(*columns)) for part, *columns in shared_windows(group)]
        return pd.DataFrame(rows, columns=["host", "part", *_COUNTED])

    def judge(group: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        stream = Stream(_pages(group), run_tokens).counted()
        if len(shared):
            columns = _unpacked(shared)
            order = np.argsort(columns[0])
            stream.learn(*(c[order] for c in columns))
        group = group.assign(text=stream.texts())
        return group.assign(n_chars=group["text"].str.len())[["page_id", "url", "text", "n_chars"]]

    chars = own.groupBy("host").agg(F.sum(F.length("html")).alias("chars")).where(F.col("chars") > GROUP_CHARS)
    large = durable(
        chars.select(
            "host",
            F.ceil(F.col("chars") / GROUP_CHARS).cast("int").alias("parts"),
            (F.ceil(F.col("chars") / BUCKET_CHARS) + LEAST_BUCKETS).cast("int").alias("buckets"),
            F.least(F.ceil(F.log2("chars")) + SPARE_BITS, F.lit(60)).cast("int").alias("bits"),
        )
    )
    part = F.coalesce(F.pmod(F.xxhash64("url", "page_id", "html"), F.col("parts")), F.lit(0)).cast("int").alias("part")
    known = [F.coalesce(c, F.lit(0)).alias(c) for c in ("buckets", "bits")]
    kept = "host string, part int, buckets int, bits int, page_id long, url string, kinds string, size long, texts binary"
    rows = own.join(large, "host", "left").select("host", part, *known, "page_id", "url", "html").mapInArrow(streams, kept)

    # All three readers take whole rows by the same keys, so that Spark deals the pages once and reuses that exchange.
    dealt = rows.groupBy("host", "part")
    leading = dealt.applyInPandas(lead, "host string, bucket int, part int, leading binary, one binary, two binary")
    suspected = leading.groupBy("host", "bucket").applyInPandas(suspect, "host string, part int, bucket int, flags binary")
    counted = f"part int, {_COUNTED[0]} binary, {_COUNTED[1]} binary, {_COUNTED[2]} binary"
    windowed = dealt.cogroup(suspected.groupBy("host", "part")).applyInPandas(count, f"host string, bucket int, {counted}")
    shared = windowed.groupBy("host", "bucket").applyInPandas(share, f"host string, {counted}")
    result = "page_id long, url string, text string, n_chars long"
    return dealt.cogroup(shared.groupBy("host", "part")).applyInPandas(judge, result)
