"""Exact deduplication, packing and byte-pair encoding against plain versions."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronage.llm import bpe, exact_dedup, packing
from patronage.llm.tokens import BYTE_BPE, WORD_BPE, _load, encoder

SCHEMA = "doc_id long, text string, kept string, _name string"
LONG = "".join(chr(97 + i * i % 23) for i in range(30_000))
DOCS = [
    (1, "a b c", "x", "y"),
    (2, "abc", "x", "y"),
    (3, "a  b c", None, None),
    (3, "a  b c", None, None),
    (4, None, "x", "y"),
    (5, "", "x", "y"),
    (6, " \n\t", "x", "y"),
    (None, "abc", "x", "y"),
    (None, None, None, None),
    (7, LONG, "x", "y"),
    (8, LONG[:-1] + "!", "x", "y"),
    (9, LONG + " ", "x", "y"),
    (10, LONG * 3, "x", "y"),
    (11, "İ é ñ 中文 🙂 <|endoftext|>  x\n\n y  ", "x", "y"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3)


@pytest.mark.parametrize("size, fingerprints", [(2, None), (5, None), (4096, None), (2, 4), (4096, 2)])
def test_exact_dedup_against_grouping(docs, monkeypatch, size, fingerprints):
    if fingerprints:
        monkeypatch.setattr(exact_dedup, "_fingerprint", lambda block: F.pmod(F.xxhash64(block), F.lit(fingerprints)))
    data = DOCS if size > 2 else [d for d in DOCS if len(d[1] or "") < 100]
    rows = exact_dedup.exact_dedup(docs.where("length(text) < 100 or text is null") if size == 2 else docs, size).collect()
    groups = defaultdict(list)
    for doc_id, text, *_ in data:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0))
    expected = []
    for norm, members in groups.items():
        keep = None if min(members)[1] else min(members)[2]
        sha = hashlib.sha256(norm.encode()).hexdigest()
        expected += [(None if n else i, keep, len(members), sha) for _, n, i in members]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r[0], r[1], r[2], r[4]) for r in rows), key=key) == sorted(expected, key=key)
    assert sum(r.kept for r in rows) == len(groups)
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_empty_tables_give_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert bpe.round_trip(empty).count() == 0


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing_is_gapless_and_whole(docs, capacity):
    rows = packing.pack(docs, capacity=capacity).collect()
    library = _load(WORD_BPE)
    expected = []
    for doc_id, text, *_ in DOCS:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for piece, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            expected.append((str(doc_id), piece, at, len(own), zlib.crc32(own.tobytes())))
    assert sorted((str(r[0]), *r[1:5]) for r in rows) == sorted(expected)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in rows)
    assert len(sequences) <= -(-total // capacity) + 1


def test_best_fill_reaches_the_fullest_sum():
    counts = {7: 2, 5: 3, 3: 1}
    sums = {7 * a + 5 * b + 3 * c for a in range(3) for b in range(4) for c in range(2)}
    for room in range(40):
        chosen = packing.best_fill(counts, room)
        assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= room)
        assert all(n <= counts[k] for k, n in chosen.items())


def test_plan_uses_every_piece_once():
    counts = {k: 1 + k * k % 17 for k in range(1, 65)}
    used = defaultdict(int)
    for times, combination in packing.plan(dict(counts), 64):
        assert sum(k * n for k, n in combination.items()) <= 64
        for k, n in combination.items():
            used[k] += times * n
    assert used == counts


TEXTS = [
    "", " ", "  ", " a", "a ", "a  ", " a  b   c ", "a\n \nb", "a \n b", "x  <|endoftext|>  y<|endoftext|>",
    "<|startoftext|> a<|endoftext|>", "a" * 3000, "it's it'll 'S 's", "\r\n\r\n  a", "Oiç### eauê***  ùn%%%.",
    "\u0085x\x1cy  z", "é İ Σς ² ½ 中文 🙂", LONG[:5000], "the thereof, theremin",
]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_those_of_the_library(text):
    library, words = _load(BYTE_BPE), _load(WORD_BPE)
    ids = np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4")
    model = bpe.model(BYTE_BPE)
    assert model.encode(text) == ids.tobytes()
    assert model.whole(text) == ids.tobytes()
    assert encoder(BYTE_BPE, True).encode(text) == ids.tobytes()
    back = library.decode(ids.tolist(), skip_special_tokens=False)
    assert model.decode(ids.astype(np.int64)).decode("utf-8", "replace") == back
    ids = np.array(words.encode(text, add_special_tokens=False).ids, dtype="<u4")
    assert encoder(WORD_BPE, False).encode(text) == ids.tobytes()


def test_round_trip_and_its_parts(docs):
    rows = bpe.round_trip(docs).collect()
    library = _load(BYTE_BPE)
    expected = []
    for doc_id, text, *_ in DOCS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        digests = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), back.encode())]
        expected.append((str(doc_id), len(ids), *digests))
    assert sorted((str(r[0]), *r[1:]) for r in rows) == sorted(expected)
    texts = bpe.decode(bpe.encode(docs)).collect()
    assert sorted((str(r[0]), r[1]) for r in texts) == sorted((str(d[0]), d[1] or "") for d in DOCS)


def test_many_texts_at_once_get_the_ids_of_each(monkeypatch):
    import random

    import pyarrow as pa

    from patronage.llm import tokens

    monkeypatch.setattr(tokens, "SLICE_BYTES", 200)
    monkeypatch.setattr(tokens, "GROUP_CHUNKS", 7)
    monkeypatch.setattr(tokens, "CACHED_CHUNKS", 50)
    rng = random.Random(2)
    pieces = ["the", "Wörter", "x.", "İ", "中文", "🙂", "a\nb", "", "  ", "word" * 20, "tail,", "\t", "é!", "it's"]
    texts = [" ".join(rng.choice(pieces) + rng.choice(["", str(rng.randint(0, 40))]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += [None, "", " ", "a" * 1000]
    library = _load(WORD_BPE)
    own = tokens.LibraryEncoder(WORD_BPE, spaces_kept=False)
    for batch in (pa.array(texts), pa.array(texts).slice(40, 200), pa.array([], pa.string())):
        wanted = [np.array(library.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in batch.to_pylist()]
        assert list(own.encode_many(batch)) == wanted


def test_words_go_to_the_library_once_whatever_marks_follow():
    import pyarrow as pa

    from patronage.llm import tokens

    texts = ["plain words, plain.", "words;; other,x  plain! Zoë; 'tis!!", "plain\nwords. ,", "", None, "<|endoftext|>! x<|endoftext|>."]
    library, asked = _load(WORD_BPE), []
    own = tokens.LibraryEncoder(WORD_BPE, spaces_kept=False)
    chunks = own.chunks
    own.chunks = lambda new: asked.extend(new) or chunks(new)
    wanted = [np.array(library.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert list(own.encode_many(pa.array(texts))) == wanted
    assert len(asked) == len(set(asked))
    assert {"plain", "words", ",", ".", "!", ";;", "other,x", "Zoë", ";", "'tis!!"} <= set(asked)
    assert not {"words,", "plain.", "words;;", "plain!", "Zoë;"} & set(asked)


def test_encoding_many_texts_holds_little_at_once():
    import random

    import pyarrow as pa

    from patronage.llm import tokens

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    texts = pa.array([" ".join(rng.choices(words, k=1500)) for _ in range(1600)])
    own, before = tokens.LibraryEncoder(WORD_BPE, spaces_kept=False), pa.default_memory_pool()
    counted = pa.proxy_memory_pool(before)
    pa.set_memory_pool(counted)
    try:
        assert sum(len(ids) > 0 for ids in own.encode_many(texts)) == len(texts)
    finally:
        pa.set_memory_pool(before)
    assert texts.nbytes > 15e6
    assert counted.max_memory() < 45e6


def test_packing_and_linking_send_texts_in_small_batches(spark, monkeypatch):
    from patronage import session
    from patronage.llm import jaccard_join, packing

    seen = []

    def recorded(df):
        seen.append(spark.conf.get(session._BATCH_SETTING, None))
        return session.durable(df)

    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
    for module, run in ((packing, packing.pack), (jaccard_join, jaccard_join.link)):
        monkeypatch.setattr(module, "durable", recorded)
        seen.clear()
        assert run(docs).count() == 3
        assert seen[0] == str(session.BATCH_BYTES)
        assert spark.conf.get(session._BATCH_SETTING, None) is None
    spark.conf.set(session._BATCH_SETTING, "9999999")
    try:
        with session.small_batches(spark):
            assert spark.conf.get(session._BATCH_SETTING) == "9999999"
        assert spark.conf.get(session._BATCH_SETTING) == "9999999"
    finally:
        spark.conf.unset(session._BATCH_SETTING)
