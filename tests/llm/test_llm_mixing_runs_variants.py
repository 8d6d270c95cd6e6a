"""Mixing sources, periodic runs and spelling variants against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from patronage.llm import mixing, runs, variants

SCHEMA = "doc_id long, text string, source string, size string, place int, word string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)


# ---- mixing ----


def plain_targets(sizes):
    """Source sizes by name to targets, by resharing the excess until no target is above its bound."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    fixed = {}
    while True:
        rest = sum(sizes.values()) - sum(fixed.values())
        free = sum(w for s, w in weight.items() if s not in fixed)
        found = {s: fixed.get(s, rest * w / free if free else 0.0) for s, w in weight.items()}
        above = {s: 3.0 * sizes[s] for s in found if s not in fixed and found[s] > 3 * sizes[s]}
        if not above:
            return found
        fixed |= above


def check_mix(rows, docs):
    """The invariants of a mix; rows as dicts with source."""
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len(WORD.findall((text or "").encode()))
    expected = plain_targets(sizes)
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in rows) == Counter(
        (d, s, len(WORD.findall((t or "").encode()))) for d, t, s in docs
    )
    taken, least = defaultdict(int), defaultdict(lambda: 1 << 60)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(expected[r["source"]], rel=1e-9, abs=1e-9)
        whole = r["target"] / r["source_size"] if r["source_size"] else 0
        assert r["taken"] in (int(whole + 1e-9) * r["size"], int(whole + 1 - 1e-9) * r["size"])
        taken[r["source"]] += r["taken"]
        least[r["source"]] = min(least[r["source"]], max(r["size"], 1))
    return {s: abs(taken[s] - expected[s]) for s in sizes}


def made_documents(seed, n, hot=0.6, long=0):
    random.seed(seed)
    names = ["a", "b", "é", "Z", "z", "中", "🙂", "", None]
    out = []
    for i in range(n):
        source = "hot" if random.random() < hot else random.choice(names)
        words = random.choice([0, 1, 3, 10, 40]) if i >= long else 600
        out.append((i, " ".join(["w"] * words) if words or i % 2 else None, source))
    return out


@pytest.mark.parametrize("fan_in", [8, 64])
def test_mix_keeps_targets_and_copies(spark, fan_in):
    docs = made_documents(fan_in, 1200, long=6)
    rows = [r.asDict() for r in mixing.mix(frame(spark, docs), fan_in=fan_in).collect()]
    misses = check_mix(rows, docs)
    # the short documents of the hot source take over what its long ones leave open
    assert misses["hot"] <= 63
    assert max(misses.values()) <= 600


def test_mix_agrees_between_partitionings_and_is_fair(spark):
    docs = made_documents(9, 150)
    first = mixing.mix(frame(spark, docs)).collect()
    again = mixing.mix(frame(spark, docs).repartition(7)).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    ups, n = 0.0, 0
    for r in first:
        if r.size and r.source == "hot":
            ups, n = ups + r.copies - r.target / r.source_size, n + 1
    assert abs(ups / n) < 0.1


def test_mix_edge_cases(spark):
    assert mixing.mix(frame(spark, [(1, "a", "s")]).limit(0)).collect() == []
    one = mixing.mix(frame(spark, [(None, "a b\x0bc d", None)])).collect()
    assert [(r.doc_id, r.size, r.target, r.taken) for r in one] == [(None, 3, 3.0, 3)]
    blank = mixing.mix(frame(spark, [(1, None, "s"), (1, "", "s"), (2, " \t", None)])).collect()
    assert [(r.size, r.target, r.taken) for r in blank] == [(0, 0.0, 0)] * 3
    copies = [(5, "a b c", "s")] * 400 + [(6, "d " * 300, "t")] * 200 + [(None, "e", None)] * 100
    rows = [r.asDict() for r in mixing.mix(frame(spark, copies)).collect()]
    misses = check_mix(rows, copies)
    assert misses["s"] <= 3 and misses["t"] <= 300 and misses[None] <= 1


# ---- runs ----


def plain_runs(words, least=12):
    """(start, length, period) by trying every period."""
    found, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if i > start and length >= max(least, 2 * q):
                own = words[start : start + length]
                if all(any(own[k] != own[k + p] for k in range(length - p)) for p in range(1, q)):
                    found.append((start, length, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_document(doc_id, text, plant):
    words = WORD.findall((text or "").encode())
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_squares_of_small_words_against_all_periods():
    random.seed(4)
    for _ in range(800):
        letters, n = random.choice([1, 2, 3, 6]), random.randint(0, 50)
        words = [random.randrange(letters) for _ in range(n)]
        if n > 5 and random.random() < 0.5:
            a = random.randrange(n)
            p = 1 + (n - a) // random.randint(2, 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        for least in (1, 5, 12):
            assert runs.find_runs(words, least) == plain_runs(words, least)


def test_long_repetitive_words_end_quickly():
    a, b = [0], [0, 1]
    while len(b) < 5000:
        a, b = b, b + a
    for words in ([7] * 50_000, [i % 700 for i in range(20_000)], b):
        assert len(runs.find_runs(words)) >= 1
    assert runs.find_runs([7] * 50_000) == [(0, 50_000, 1)]


@pytest.mark.parametrize("plant", [False, True])
def test_runs_against_plain_version(spark, plant):
    random.seed(6)
    docs = []
    for i in range(400):
        words = [random.choice(["a", "b", "é", "中文", "the", " x", "o\x1cf"]) for _ in range(random.choice([0, 5, 30, 90]))]
        if i % 3 == 0:
            words = words[: len(words) // 4] * 5
        docs.append((i, random.choice([" ", "  ", "\n", "\t \x0b\x0c\r"]).join(words) + random.choice(["", " ", "\n"]), "s"))
    docs += [(None, "a b " * 40, "s"), (None, None, None), (7000, None, "s"), (7001, "", "s"), (7002, " \n ", "s")]
    docs += [docs[3], docs[3], (8, "x y z " * 30, None)]
    docs.append((9000, " ".join(f"w{i % 3001}" for i in range(20_000)), "s"))
    rows = [tuple(r) for r in runs.detect_runs(frame(spark, docs), plant=plant).collect()]
    wanted = [plain_document(d, t, plant) for d, t, _ in docs[:-1]]
    long = [r for r in rows if r[0] == 9000]
    assert sorted(map(str, [r for r in rows if r[0] != 9000])) == sorted(map(str, wanted))
    assert [r[1:6] for r in long] == [(1, 0, 20_000, 3001, 6664)] or plant
    assert runs.detect_runs(frame(spark, docs).limit(0)).collect() == []


def test_runs_in_slices_and_pieces(monkeypatch):
    import numpy as np

    monkeypatch.setattr(runs, "SLICE_BYTES", 50)
    random.seed(8)
    ids = np.array([random.randrange(3) for _ in range(2000)] + list(range(3, 400)) + [1, 2] * 9)
    owner = np.repeat(np.arange(3), [1000, 1200, len(ids) - 2200])
    found = [
        (begin + s, length, q)
        for begin, end in runs.pieces(ids, owner)
        for s, length, q in runs.find_runs(ids[begin:end].tolist())
    ]
    wanted = []
    for doc in range(3):
        at = int(np.flatnonzero(owner == doc)[0])
        wanted += [(at + s, length, q) for s, length, q in plain_runs(ids[owner == doc].tolist())]
    assert sorted(found) == sorted(wanted)


# ---- spelling variants ----


def plain_near(a, b):
    """Exactly one replaced, inserted or deleted code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(counts):
    near = {w: [v for v in counts if v != w and plain_near(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 10 * counts[w]:
            form[w] = best
    rows = []
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        best = form.get(w)
        rows.append((w, best, root, counts[w], len(near[w]), counts[best] if best else None))
    return rows


def plain_counts(docs):
    counts = Counter()
    for doc_id, text, _ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            if len(word) >= 7:
                counts[word] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def test_variants_of_made_words(spark):
    random.seed(3)
    words = {}
    for _ in range(60):
        base = "".join(random.choice("abé÷") for _ in range(random.choice([7, 8, 9, 16, 40, 70])))
        words[base] = random.randint(200, 3000)
        for _ in range(6):
            k, letter = random.randrange(len(base) + 1), random.choice("abéÿ")
            other = random.choice([base[:k] + letter + base[k:], base[:k] + base[k + 1 :], base[:k] + letter + base[k + 1 :]])
            if len(other) >= 7:
                words.setdefault(other, random.choice([2, 19, 20, 21, 250]))
    # a chain of forms, and equal letters in a row
    words |= {"kkkkkkk": 5, "kkkkkkkk": 60, "kkkkkkkkk": 900, "kkkkkkkkb": 900, "zzzzzzz": 2}
    made = spark.createDataFrame([(w, n) for w, n in words.items()] + [(None, 5)], "word string, n long").repartition(5)
    rows = [tuple(r) for r in variants.group_variants(made).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, plain_variants(words)))
    assert ("kkkkkkk", "kkkkkkkk", "kkkkkkkkb", 5, 1, 60) in rows


def test_variants_of_documents(spark, monkeypatch):
    random.seed(12)
    stems = ["".join(random.choice("aeinrst") for _ in range(random.randint(6, 9))) for _ in range(40)]
    docs = []
    for i in range(300):
        picks = [random.choice(stems) for _ in range(60)]
        picks = [w.upper() if random.random() < 0.1 else w.title() if random.random() < 0.2 else w for w in picks]
        docs.append((i, random.choice([" ", ", ", "1"]).join(picks), "s"))
    docs += [(None, "ÀÉÎÕÜßÿ ÀÉÎÕÜßÿ àéîõüßÿ " + "q" * 5000, None), (1, None, "s"), (2, "", "s"), docs[0], docs[0], (3, "q" * 5000, "s")]
    docs += [(4, "q" * 4999 + " " + "q" * 4999, None)]
    rows = [tuple(r) for r in variants.spelling_variants(frame(spark, docs), damage=31).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, plain_variants(plain_counts(docs))))
    assert variants.spelling_variants(frame(spark, docs).limit(0)).collect() == []


def test_pairs_of_all_words_are_never_broadcast(spark):
    words = spark.createDataFrame([(f"{a}ordering{b}", 5) for a in "abcd" for b in "xyz"], "word string, n long")
    known = words.selectExpr("word", "monotonically_increasing_id() as id")
    pairs = variants._numbered_pairs(known)
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().sparkPlan().toString()
    found = variants.group_variants(words)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") >= 2 and {r.n_near for r in found.collect()} == {5}
