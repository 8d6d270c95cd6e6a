"""URL reputation, main text, license scan, top-k search, token files, Jaccard join and toxicity."""

import math
import random
import time
import zlib
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from patronage.llm import (
    components,
    jaccard_join,
    licenses,
    main_text,
    range_coder,
    reputation,
    token_files,
    tokens,
    topk,
    toxicity,
    trie_join,
)
from patronage.llm.license_texts import TEMPLATES
from patronage.llm.tokens import BYTE_BPE, LibraryEncoder, _load

# --- URL reputation ---

URLS = [
    (1, "http://a.bad.com/x"), (2, "http://A.BAD.com/y?q#f"), (3, "https://b.bad.com"), (4, "ftp://good.org/p"),
    (5, None), (6, "no scheme"), (7, "http://www.rule.net/en/1"), (8, "http://rule.net/fr"), (None, "http://good.org/"),
    (1, "http://a.bad.com/x"), (9, "http://"), (10, "http://x.co.uk/a://b"),
]


@pytest.fixture(scope="module")
def urls(spark):
    many = [(100 + i, f"http://a.bad.com/{i}") for i in range(60)] + [(200 + i, f"http://good.org/{i}") for i in range(60)]
    return spark.createDataFrame([(*u, "x", 1.0) for u in URLS + many], "page_id long, url string, rate string, n double")


@pytest.fixture(scope="module")
def outcomes(spark):
    rows = [(100 + i, i % 20 != 0) for i in range(60)] + [(200 + i, i % 20 == 0) for i in range(60)]
    return spark.createDataFrame(rows + [(None, True), (1, None)], "page_id long, bad boolean")


def test_url_verdicts(urls, outcomes):
    rules = [("block", "rule.net/"), ("allow", "rule.net/en/")]
    rows = reputation.filter_urls(urls, outcomes, rules).collect()
    assert len(rows) == len(URLS) + 120
    by_id = {r.page_id: r for r in rows}
    assert (by_id[2].host, by_id[2].path) == ("a.bad.com", "/y")
    assert (by_id[3].host, by_id[3].path) == ("b.bad.com", "")
    assert (by_id[10].host, by_id[10].path) == ("x.co.uk", "/a://b")
    assert all((by_id[k].host, by_id[k].path) == ("", "") for k in (5, 6, 9))
    assert (by_id[7].rule, by_id[7].verdict) == ("rule.net/en/", "allow")
    assert (by_id[8].rule, by_id[8].verdict) == ("rule.net/", "block")
    assert by_id[1].verdict == "block" and by_id[4].verdict == "allow" and by_id[4].rule is None
    # A host without labelled pages leans towards its domain, and more surely bad hosts have higher bounds.
    assert 0.5 < by_id[3].bad_rate < by_id[1].bad_rate
    assert all(r.bad_bound < r.bad_rate for r in rows)


def test_urls_without_outcomes_or_rows(urls, outcomes):
    assert {r.verdict for r in reputation.filter_urls(urls, outcomes.limit(0)).collect()} == {"allow"}
    assert reputation.filter_urls(urls.limit(0), outcomes).count() == 0


# --- Main text ---


def test_blocks_of_a_page():
    page = (
        '<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li>x</ul></nav>'
        '<!-- ad <p> --><div class="ad">Buy <b>now</b></div><article><h1>A&amp;b\n &lt;c</h1><p><b>one<br><p>two &quot;x'
        '<div class="comments">no<div>nor this</div></div><p title="a>b">three</article><aside>s</aside>'
        "<form>f</form><footer>&copy;</footer></body></html>"
    )
    assert [t for k, t in main_text.parse(page) if k == main_text.CONTENT] == ["A&b <c", "one", 'two "x', "three"]
    assert main_text.parse(None) == [] and main_text.parse("") == []
    assert main_text.parse("<article><p>a &am") == [(0, "a &am")]
    assert main_text.parse("<article><p>a <di") == [(0, "a")]
    assert main_text.parse("1 < 2<script>x") == [(1, "1 < 2")]


@pytest.mark.parametrize("inside, kept", [
    ('<h2 id="related-work">t</h2>', "t"), ('<h2 id="search-algorithms">t</h2>', "t"),
    ('<section id="social-history">t</section>', "t"), ('<p class="share-price">t</p>', "t"),
    ('<figure class="banner">t</figure>', "t"), ('<div class="share-price">t</div>', "t"),
    ("<math><mi>t</mi><annotation>u</annotation></math>", "t"), ("<svg><title>u</title><text>t</text></svg>", "t"),
    ("<object>t</object>", "t"), ('<div class="x share">t</div>', ""), ('<ul class="share-buttons">t</ul>', ""),
    ('<section id="comments">t</section>', ""), ('<div id="comments">t</div>', ""), ('<div class="user-comments">t</div>', ""),
    ('<p class="advert">t</p>', ""), ('<figure class="advert">t</figure>', ""), ('<span class="advert">t</span>', ""),
    ('<p class="notice">t</p>', ""), ('<section id="search">t</section>', "t"), ('<span class="share">t</span>', "t"),
    ("<p title=it's>t</p>", "t"), ('<div class="ad">t</div>', ""), ('<section role="search">t</section>', ""), ("<nav>t</nav>", ""),
])
def test_names_inside_an_article(inside, kept):
    blocks = main_text.parse(f'<article id="search-engines"><p>a</p>{inside}<p>b</p></article>')
    assert [t for k, t in blocks if k == main_text.CONTENT] == [t for t in ("a", kept, "b") if t]


def test_apostrophes_and_many_open_tags():
    page = "<article><p title=it's>one two</p><p>don't stop</p><p data-x = 'a>b'>three</p></article>"
    assert [t for _, t in main_text.parse(page)] == ["one two", "don't stop", "three"]
    deep = "<article>" + "<div>a</section></i>" * 30_000
    assert len(main_text.parse(deep)) == 30_000
    assert main_text.parse("<p " + "a=\"b\" c='" * 30_000) is not None


def test_repeated_runs_against_windows():
    rng = random.Random(5)
    for _ in range(40):
        pages = [[rng.choice("abc") for _ in range(rng.randint(0, 25))] for _ in range(5)]
        length = rng.randint(2, 6)
        tokens = np.array([ord(t) for p in pages for t in p], dtype=np.int64)
        page = np.array([k for k, p in enumerate(pages) for _ in p], dtype=np.int64)
        where = {}
        for k, p in enumerate(pages):
            for i in range(len(p) - length + 1):
                where.setdefault(tuple(p[i : i + length]), set()).add(k)
        expected = []
        for p in pages:
            covered = [False] * len(p)
            for i in range(len(p) - length + 1):
                if len(where[tuple(p[i : i + length])]) > 1:
                    covered[i : i + length] = [True] * length
            expected += covered
        assert main_text.repeated(tokens, page, length).tolist() == expected


def test_pages_without_article_lose_what_their_host_repeats(spark):
    menu = "<div>home news sport weather travel money video more links</div>"
    rows = [(i, f"http://h.org/{i}", f"{menu}<p>n{i} is the text of page {i * i}</p>") for i in range(6)]
    rows += [(10, "http://h.org/a", "<article><p>home news sport weather travel money video more links"), (11, None, None)]
    rows += [(12, "http://solo.org/", f"{menu}<p>alone"), (None, "x", "<p>no id"), (12, "http://solo.org/", f"{menu}<p>alone")]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, part int")
    found = {(r.page_id, r.url): r for r in main_text.extract(pages).collect()}
    assert main_text.extract(pages).count() == len(rows)
    for i in range(6):
        assert found[(i, f"http://h.org/{i}")].text == f"n{i} is the text of page {i * i}"
    assert found[(10, "http://h.org/a")].text == "home news sport weather travel money video more links"
    assert (found[(11, None)].text, found[(11, None)].n_chars) == ("", 0)
    assert found[(None, "x")].text == "no id"
    # Two copies of one page: nothing unique is left, so it stays.
    assert found[(12, "http://solo.org/")].text.endswith("\n\nalone")
    assert main_text.extract(pages.limit(0)).count() == 0


def test_articles_lose_short_runs_of_many_pages_only(spark):
    share = "Tell your friends about this page on every network"
    copied = " ".join(f"c{i}" for i in range(60))
    rows = []
    for i in range(12):
        own = " ".join(f"w{i}x{k}" for k in range(50))
        menu = f"<nav>{share}</nav>" if i < 2 else ""
        rows.append((i, f"http://h.org/{i}", f"{menu}<article><p>{own}</p><p>{share}</p><p>{share} and cut {i}</p></article>"))
        rows.append((100 + i, f"http://h.org/c{i}", f"<main><p>{copied} n{i} {copied[::-1]}</main>"))
        # The same line on few pages of another host is a quotation; so is one that no menu has.
        rows.append((300 + i, f"http://q.org/{i}", f"<article><p>{own}</p><p>{share}</p></article>"))
        rows.append((200 + i, f"http://h{i // 3}.org/", f"<article><p>{own}</p><p>{share}</p></article>"))
    found = {r.page_id: r.text for r in main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(found) == len(rows)
    for i in range(12):
        own = " ".join(f"w{i}x{k}" for k in range(50))
        assert found[i] == f"{own}\n\n{share} and cut {i}"
        assert found[300 + i] == f"{own}\n\n{share}"
        assert found[100 + i] == f"{copied} n{i} {copied[::-1]}"
        assert found[200 + i] == f"{own}\n\n{share}"


def test_main_text_does_not_depend_on_how_a_host_is_dealt(spark, monkeypatch):
    rng = random.Random(3)
    lines = [" ".join(rng.choice("abcdefgh") for _ in range(10)) for _ in range(12)]
    rows = []
    for i in range(120):
        own = " ".join(f"w{i}x{k}" for k in range(60))
        tag = rng.choice(("article", "div"))
        # Line 11 is on two pages only.
        extra = rng.choice(lines[:11]) if i not in (7, 90) else lines[11]
        rows.append((i, f"http://h{i % 13 == 12}.org/{i}", f"<footer>{rng.choice(lines)}</footer><{tag}><p>{own}<p>{extra}</{tag}>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = []
    for chars in (10**9, 5_000):
        monkeypatch.setattr(main_text, "GROUP_CHARS", chars)
        found.append({r.page_id: r.text for r in main_text.extract(pages).collect()})
    assert found[0] == found[1] and len(found[0]) == len(rows)
    assert len({len(text.split("\n\n")) for text in found[0].values()}) == 2


def test_main_text_deals_pages_once_and_sums_up_few_windows(spark, monkeypatch):
    monkeypatch.setattr(main_text, "GROUP_CHARS", 5_000)
    notice = "one notice that two pages have beside their articles here"
    quoted = "one long line that many articles quote word by word here"
    rows = []
    for i in range(60):
        beside = notice if i in (7, 50) else f"p{i} " * 9
        rows.append((i, f"http://h.org/{i}", f"<article><p>{' '.join(f'w{i}x{k}' for k in range(40))}<p>{quoted}</article><div>{beside}</div>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = main_text.extract(pages)
    assert len(found.collect()) == 60
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("ReusedExchange") >= 2
    # Of the windows of several parts only those open on several pages have their whole hashes handed on.
    parts = [main_text.Stream([main_text.parse(html) for _, _, html in rows[k::4]]) for k in range(4)]
    leading = [part.leading(40) for part in parts]
    frame = pd.DataFrame(
        [(k, main_text._gaps(f), *(np.packbits(n >= m).tobytes() for m in (1, 2))) for k, (f, n) in enumerate(leading)],
        columns=["part", "leading", "one", "two"],
    )
    flags = dict(main_text.suspects(frame))
    words = len(notice.split()) - main_text.RUN_TOKENS + 1
    assert {k: int(f.sum()) for k, f in flags.items()} == {7 % 4: words, 50 % 4: words}
    for part, (lead, n_open) in zip(parts, leading):
        hashes, order = part.counted().hashes(), np.argsort(part.hashes())
        assert (hashes[order] >> np.uint64(24) == lead).all() and (part.n_open[order] == n_open).all()


def test_rising_numbers_by_their_gaps():
    for numbers in ([], [0], [2**60 - 1], [0, 1, 2, 300, 70_000, 2**40, 2**60 - 1]):
        rising = np.array(numbers, dtype=np.uint64)
        assert main_text._from_gaps(main_text._gaps(rising)).tolist() == numbers
        edges = main_text._edges(rising, 17, 60)
        assert edges[0] == 0 and edges[-1] == len(numbers) and len(edges) == 18
        assert all((n * 17) >> 60 == b for b in range(17) for n in numbers[edges[b] : edges[b + 1]])


# --- License scan ---


def test_licenses_are_found_with_spans(spark):
    mit = TEMPLATES["MIT text"]
    changed = mit.replace("free of charge", "at no charge at all").replace("sublicense,", "")
    filler = " ".join(f"zz{i}" for i in range(500))
    rows = [
        (1, f"é {filler} {mit} {filler}"), (2, f"{filler}\n{changed}"), (3, "Released under the MIT License."), (4, filler),
        (5, None), (6, ""), (7, mit[:200]), (8, "released under the mit license. x Released under the MIT License"),
        (3, "Released under the MIT License."),
    ]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, coverage double")
    found = {}
    for r in licenses.scan(docs).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert set(found) == {1, 2, 3, 8}
    (one,) = found[1]
    assert one.license == "MIT text" and one.coverage == 1.0
    assert rows[0][1][one.start : one.end] == mit.rstrip(".")
    (two,) = found[2]
    assert two.license == "MIT text" and 0.9 < two.coverage < 1.0
    assert len(found[3]) == 2 and len(found[8]) == 2
    assert licenses.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text, license", [
    ("Licensed under CC BY 4.0", "CC-BY-4.0"), ("Licensed under CC BY-NC 4.0", "CC-BY-NC-4.0"),
    ("Licensed under CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"), ("Licensed under CC BY-ND 3.0", "CC-BY-ND-3.0"),
    ("licensed under the GNU General Public License, version 2", "GPL-2.0"),
    ("licensed under the GNU General Public License, version 3", "GPL-3.0"),
    ("licensed under the GNU Lesser General Public License, version 3", "LGPL-3.0"),
    ("licensed under the GNU Lesser General Public License, version 2.1", "LGPL-2.1"),
    ("licensed under the GNU Affero General Public License, version 3", "AGPL-3.0"),
    ("licensed under the Eclipse Public License, version 2.0", "EPL-2.0"),
    ("Released under the MIT License", "MIT"), ("Released under CC0 1.0", "CC0-1.0"),
    (TEMPLATES["BSD-3-Clause"].split(" 3. Neither")[0], "BSD-2-Clause"), (TEMPLATES["BSD-3-Clause"], "BSD-3-Clause"),
    (TEMPLATES["GPL-3.0 notice"].replace("version 3", "version 2"), "GPL-2.0"),
    ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
     "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
     "commercial or non-commercial, and by any means.", "Unlicense"),
])
def test_licenses_get_the_name_of_their_kind_and_version(text, license):
    found = licenses.scan_text(f"Some words before. {text}. And after.", licenses.Index(TEMPLATES), licenses.COVERAGE)
    assert [name.split()[0] for name, *_ in found] == [license]


def test_whole_texts_and_long_insertions():
    index = licenses.Index(TEMPLATES)
    for name in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "CC0-1.0", "MPL-2.0"):
        (match,) = licenses.scan_text(f"Above. {TEMPLATES[name + ' text']} Below.", index, licenses.COVERAGE)
        assert match[0] == f"{name} text" and match[1] == 1.0
    mit = TEMPLATES["MIT text"].split()
    filler = " ".join(f"zz{i}" for i in range(40))
    text = " ".join(mit[:45]) + f" {filler} " + " ".join(mit[45:])
    (match,) = licenses.scan_text(f"x {text} y", index, licenses.COVERAGE)
    assert match[:2] == ("MIT text", 1.0)
    assert f"x {text} y"[match[3] : match[4]] == text.rstrip(".")


def test_alignment_counts_common_words_near_the_diagonal():
    template = np.arange(20)
    text = np.concatenate([[-1] * 5, template[:8], [-1, -1], template[8:11], template[12:]])
    assert licenses.align(template, text, 5) == (19, 5, len(text))


# --- Exact top-k search ---


def brute_top_k(rows, k):
    vectors = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            vectors.append((i, [math.floor(256 * x) for x in v]))
    out = []
    for i, q in vectors:
        if i % 50 == 0:
            scored = [(-sum(a * b for a, b in zip(q, v)), j) for j, v in vectors if j != i and len(v) == len(q)]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_top_k_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(size=20))]) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(60)]  # ties
    rows += [(50, None), (51, [None] * 20), (52, [float("nan")] * 20), (53, [float("inf")] * 20), (None, rows[0][1])]
    rows += [(2000, [0.5, 1.0]), (2001, [0.25, 2.0]), (2050, []), (7, rows[7][1])]
    monkeypatch.setattr(topk, "CANDIDATES", 100)
    monkeypatch.setattr(topk, "QUERIES", 4)
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    found = sorted(tuple(r) for r in topk.top_k(vectors, F.col("vec_id") % 50 == 0).collect())
    assert found == brute_top_k(rows, 5)
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# --- Token files ---


def test_coder_round_trip():
    rng = np.random.default_rng(4)
    blocks = [np.minimum(rng.zipf(1.4, int(n)), 50256).astype("u4") for n in rng.integers(0, 400, 50)]
    blocks += [np.zeros(0, "u4"), np.full(500, 65535, "u4"), np.tile(np.arange(7, dtype="u4"), 60)]
    coded = range_coder.encode(blocks, 4)
    back = range_coder.decode(coded, np.array([len(b) for b in blocks]), 4)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, back))
    # Each block is on its own, whatever it is coded beside, and what repeats gets short.
    assert range_coder.encode(blocks[-1:], 4)[0] == coded[-1]
    assert len(coded[-1]) < len(blocks[-1])
    wide = [np.array([0, 2**32 - 1, 12345678], dtype="u4")]
    assert range_coder.decode(range_coder.encode(wide, 8), np.array([3]), 8)[0].tolist() == wide[0].tolist()
    assert range_coder.encode([], 4) == []


def test_long_blocks_take_few_steps_and_learn():
    rng = np.random.default_rng(5)
    common = rng.permutation(50257)[np.minimum(rng.zipf(1.3, 300_000), 50256)]
    blocks = [common, rng.integers(0, 1 << 16, 70_001), np.zeros(100_000, int), np.arange(40_000) % 20_011]
    blocks += [common[:n] for n in (1, 2, 511, 512, 513, 1025, 5000)]
    began = time.process_time()
    coded = range_coder.encode([b.astype("u4") for b in blocks], 4)
    back = range_coder.decode(coded, np.array([len(b) for b in blocks]), 4)
    assert time.process_time() - began < 45  # an id of a block at a time takes minutes
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, back))
    share = np.unique(common, return_counts=True)[1] / len(common)
    entropy = -(share * np.log2(share)).sum() / 8
    assert len(coded[0]) < 1.2 * entropy * len(common)
    assert len(coded[2]) < 0.05 * len(blocks[2])
    wide = rng.integers(0, 1 << 32, 3000).astype("u4")
    assert (range_coder.decode(range_coder.encode([wide], 8), [3000], 8)[0] == wide).all()
    # A damaged or short block gives other ids, not an error of its own.
    for bad in (b"", coded[-1][:1001], bytes([coded[-1][0] ^ 128]) + coded[-1][1:]):
        found = range_coder.decode([bad], [5000], 4)[0]
        assert len(found) == 5000 and (found != blocks[-1]).any()


def test_segments_hold_long_blocks(monkeypatch):
    ids = np.random.default_rng(6).integers(0, 300, 30_000).astype("<u4")

    def blocks():
        segment = token_files._Segment(0)
        for k, part in enumerate(np.split(ids, [10, 10_000, 10_001])):
            segment.add(k or None, part.tobytes())
        return segment.blocks()

    (block,) = blocks()
    assert (block == ids).all()
    monkeypatch.setattr(token_files, "BLOCK_IDS", 8_000)
    assert [len(b) for b in blocks()] == [10_000] * 3
    assert (np.concatenate(blocks()) == ids).all()


def test_pieces_have_the_ids_of_whole_texts(monkeypatch):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\r", "a", "Be", "é", "ß", "÷", "×", "Ωm", "'s", "it's", ".", "$$", "-", "0", "12"]
    parts += ["don't", "\u2019s", "naïve", "日本", "привет", "\x0b", "\x0c", "\x1c", "\x85", "\u180e", "\u3000"]
    parts += ["½", "²", "_", "\u00a0", "\u2003", "\x7f", "\xad", "\0", "<|endoftext|>", "x" * 60, "🙂", "un", "done", " the"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(5000)] + [None, "", " ", "end "]
    library, own = _load(BYTE_BPE), LibraryEncoder(BYTE_BPE, spaces_kept=True)
    wanted = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(own.encode_pieces(pa.array(texts))) == wanted
    assert list(own.encode_pieces(pa.array(texts, pa.large_string())[7:])) == wanted[7:]
    monkeypatch.setattr(tokens, "CACHED_CHUNKS", 20)
    monkeypatch.setattr(tokens, "SLICE_BYTES", 300)
    own = LibraryEncoder(BYTE_BPE, spaces_kept=True)
    assert list(own.encode_pieces(pa.array(texts))) == wanted
    # Words go to the library once, whatever marks follow them; nothing else does.
    own, asked = LibraryEncoder(BYTE_BPE, spaces_kept=True), []
    tokenize = own._model.tokenize
    own._model = SimpleNamespace(tokenize=lambda piece: asked.append(piece) or tokenize(piece))
    own.whole = own.chunks = None
    assert len(list(own.encode_pieces(pa.array(["plain words, plain.\nWords", "plain, Words! words"])))) == 2
    assert len(asked) == len(set(asked)) == 9


def test_token_files_hold_all_documents_in_order(spark, monkeypatch, tmp_path):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "cat", "sat", "Zürich", "x" * 30]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    rows = [(rng.randint(-50, 10**12), t) for t in texts] + [(5, None), (5, "<|endoftext|> a"), (None, "b"), (6, "word " * 9000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(4)
    found = token_files.write_and_read(docs).collect()
    library = _load(BYTE_BPE)
    expected = []
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        expected.append((str(doc_id), len(ids), zlib.crc32(ids.tobytes())))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in found) == sorted(expected)
    at = 0
    ordered = sorted(found, key=lambda r: r.start)
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in ordered]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert token_files.write_and_read(docs.limit(0)).count() == 0


def test_damage_is_noticed(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text " * 50)], "doc_id long, text string")
    path = str(tmp_path / "ids")
    token_files.write(docs, path)
    (segment,) = spark.read.parquet(path).collect()
    data = bytearray(segment.data)
    data[30] ^= 1
    with pytest.raises(ValueError):
        token_files.read_segment(bytes(data))
    coded = token_files.read_segment(bytes(segment.data))[3]
    data = bytearray(segment.data)
    data[len(data) - len(coded[0]) + 1] ^= 1
    worse = str(tmp_path / "worse")
    spark.createDataFrame([(0, 0, segment.n_ids, bytes(data))], "part int, first long, n_ids long, data binary").write.parquet(worse)
    with pytest.raises(Exception, match="damaged block"):
        token_files.read(spark, worse).collect()


# --- Jaccard join ---


def shingles(text):
    parts = (text or "").lower().split()
    return {tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


def brute_components(sets, percent=75):
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(sets))]


def near_copies(rng, groups, size):
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 90))]
        if rng.random() < 0.4:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(rng.randint(1, size)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("block, common", [(400, 1 << 17), (4, 8)])
def test_linked_groups_against_all_pairs(spark, monkeypatch, block, common):
    rng = random.Random(9)
    texts = near_copies(rng, 30, 12) + [None, "", " \t", "One two", "one TWO", "one two three four five", "One two three four five"]
    texts += ["a b c d e f g h i"] * 3
    rows = list(enumerate(texts)) + [(None, texts[0]), (3, texts[3])]
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    monkeypatch.setattr(jaccard_join, "OPEN_SETS", block)
    monkeypatch.setattr(jaccard_join, "COMMON", common)
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n int").repartition(3)
    found = jaccard_join.link(docs).collect()
    sets = [shingles(t) for _, t in rows]
    ids = [i for i, _ in rows]
    root = brute_components(sets)
    expected = []
    for k, (i, s) in enumerate(zip(ids, sets)):
        members = [ids[m] for m in range(len(rows)) if root[m] == root[k] and ids[m] is not None]
        expected.append((str(i), len(s), str(min(members) if members else None)))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in found) == sorted(expected)


@pytest.mark.parametrize("mask", [255, 7])
def test_sets_under_one_key_keep_their_links(spark, monkeypatch, mask):
    rng = random.Random(5)
    texts = near_copies(rng, 25, 6) + [None, "", "a b", "A b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard_join, "KEY_MASK", mask)
    found = {r[0]: (r[1], r[2]) for r in jaccard_join.link(docs).collect()}
    sets = [shingles(t) for t in texts]
    assert found == {i: (len(sets[i]), root) for i, root in enumerate(brute_components(sets))}


def test_too_many_sets_under_one_key_stop_the_job(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word {i}") for i in range(20)], "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "KEY_MASK", 1)
    monkeypatch.setattr(jaccard_join, "RENAMED", 3)
    with pytest.raises(ValueError, match="share a 64-bit key"):
        jaccard_join.link(docs)


def test_join_of_nothing(spark):
    assert jaccard_join.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("cells", [8_000_000, 500])
def test_prefix_tree_against_all_pairs(monkeypatch, cells):
    monkeypatch.setattr(trie_join, "PROBE_CELLS", cells)
    rng = np.random.default_rng(3)
    for _ in range(25):
        sets = []
        for _ in range(8):
            base = rng.choice(300, size=int(rng.integers(1, 50)), replace=False)
            for _ in range(int(rng.integers(1, 7))):
                own = base[int(rng.integers(0, len(base) // 4 + 1)) :]
                sets.append(np.unique(np.concatenate([own, rng.choice(300, size=int(rng.integers(0, 5)))])))
        expected = brute_components([set(s.tolist()) for s in sets])
        assert trie_join.similar(sets, 75).tolist() == expected
        known = np.arange(len(sets)) // 3
        linked = trie_join.similar(sets, 75, known)
        for i in range(len(sets)):
            assert linked[i] == linked[3 * (i // 3)]
            assert linked[i] == linked[expected[i]]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(200, 200), (7, 3)]
    found = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- Toxicity ---


@pytest.fixture(scope="module")
def toxic_corpus(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        own = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(5, 60))]
        poor, bad = rng.random() < 0.3, rng.random() < 0.2
        if poor:
            own = [w + "!!" for w in own]
        if bad:
            own.insert(rng.randrange(len(own)), rng.choice(["vileone", "viletwo", "Grimthing"]))
        rows.append((i, " ".join(own), bad))
        if i < 400:
            labels.append((i, int(poor), int(bad)))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, rejected string")
    return docs, spark.createDataFrame(labels, "doc_id long, poor int, toxic int"), rows


def test_held_out_toxicity(toxic_corpus):
    docs, labels, rows = toxic_corpus
    chain = toxicity.fit(docs, labels, ("poor", "toxic"))
    found = {r.doc_id: r for r in toxicity.detect(docs, chain, "toxic").collect()}
    held_out = [(found[i].rejected, bad) for i, _, bad in rows[400:]]
    caught = sum(r and b for r, b in held_out) / sum(b for _, b in held_out)
    wrong = sum(r and not b for r, b in held_out)
    assert caught >= 0.95 and wrong <= 2
    assert len(chain.earlier[0]) == 0 and len(chain.earlier[1]) == 1
    assert all(0 <= r.p_poor <= 1 for r in found.values())
    # Beginnings of words stand for words not seen in training.
    score = chain.scorer()
    assert score("w1 w2 vilething w3")[1] > score("w1 w2 w3")[1]


def test_toxicity_of_awkward_tables(spark, toxic_corpus):
    docs, labels, _ = toxic_corpus
    odd = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "vileone")], "doc_id long, text string")
    chain = toxicity.fit(docs, labels, ("poor", "toxic"))
    rows = toxicity.detect(odd, chain, "toxic").collect()
    assert len(rows) == 4 and rows[0] == rows[1]
    for other in (labels.limit(0), labels.withColumn("toxic", F.lit(0)), labels.withColumn("toxic", F.lit(None).cast("int"))):
        none = toxicity.fit(docs, other, ("poor", "toxic"))
        assert not any(r.rejected for r in toxicity.detect(odd, none, "toxic").collect())
    assert toxicity.detect(odd.limit(0), chain, "toxic").count() == 0


def test_logistic_model_separates():
    x = toxicity.Table(np.array([0, 1, 2]), np.array([0, 0, 0]), (6, 1), np.zeros((6, 0)))
    weights, bias = toxicity.fit_logistic(x, np.array([1, 1, 1, 0, 0, 0], float))
    assert weights[0] + bias > 1 and bias < -1


def test_the_toxicity_sample_is_bounded_in_rows(spark):
    rows = [(1, "same text")] * 50 + [(2, f"text {i}") for i in range(50)] + [(3, "more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    assert toxicity._sampled(docs, labels, ("toxic",), 10).count() == 10
    whole = toxicity._sampled(docs, labels, ("toxic",), 1000)
    assert {r.doc_id: r["count"] for r in whole.groupBy("doc_id").count().collect()} == {1: 1, 2: 50, 3: 1}


def test_jaccard_join_sends_sets_in_passes_and_leaves_no_tables_of_them(spark, monkeypatch):
    rng = random.Random(8)
    texts = [[f"w{rng.randrange(500)}" for _ in range(60)] for _ in range(30)]
    for k in range(0, 30, 2):
        texts.append([*texts[k][:-1], "other"])
    docs = spark.createDataFrame(list(enumerate(map(" ".join, texts))), "doc_id long, text string")
    whole = sorted(map(tuple, jaccard_join.link(docs).collect()))
    assert sum(a != c for a, _, c in whole) == 15
    made, calls = [], []
    durable, linked = jaccard_join.durable, jaccard_join._linked
    monkeypatch.setattr(jaccard_join, "durable", lambda df: made.append(durable(df)) or made[-1])
    monkeypatch.setattr(jaccard_join, "_linked", lambda *a: calls.append(a) or linked(*a))
    monkeypatch.setattr(jaccard_join, "PASS_BYTES", 1)
    monkeypatch.setattr(jaccard_join, "MOST_PASSES", 3)
    assert sorted(map(tuple, jaccard_join.link(docs).collect())) == whole
    assert len(calls) >= 3
    tables = [df for df in made if {"hashes", "h"} & set(df.columns) and df.inputFiles() and "c" not in df.columns]
    assert len([df for df in tables if "k1" in df.columns]) >= 4
    for df in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0])
        gone = not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        assert gone or "k1" not in df.columns
