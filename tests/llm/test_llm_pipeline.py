"""The pipeline on a small corpus against a plain version, and its stages on awkward tables."""

import re
from collections import defaultdict

import pytest

from patronage.llm.tokens import WORD_BPE, _load
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _doc string, _id long"


def words(seed: int, n: int) -> list[str]:
    return [f"w{(seed * 7919 + i * i * 31 + i * seed) % 9973}" for i in range(n)]


def corpus():
    rows = []
    for i in range(120):
        rows.append((i, " ".join(words(i, 40 + i % 30))))
    for i in range(0, 60, 3):  # toxic documents, labelled and not
        rows[i] = (i, rows[i][1] + " utterly vilewordish rubbishword")
    for i in range(10):  # exact copies with other white space
        rows.append((200 + i, re.sub(" ", "\n ", rows[61 + i][1])))
    for i in range(10):  # near copies: one word of the text changed at its end
        rows.append((300 + i, rows[81 + i][1][:-1] + "x"))
    rows += [(400, ""), (401, None), (402, "two words"), (403, "two words")]
    return rows


def plain(rows):
    kept = [r for r in rows if "vilewordish" not in (r[1] or "")]
    groups = defaultdict(list)
    for r in kept:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append((-len(r[1] or ""), r[0], r[1]))
    kept = sorted((min(g)[1], min(g)[2]) for g in groups.values())
    sets = {}
    for i, text in kept:
        w = (text or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i, _ in kept}
    changed = True
    while changed:
        changed = False
        for a in root:
            for b in root:
                both = len(sets[a] & sets[b])
                if sets[a] and 100 * both >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return {i: t for i, t in kept if root[i] == i}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "en", "s", len(t or ""), "d", 1) for i, t in corpus()]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int("vilewordish" in (t or ""))) for i, t in corpus() if i % 2 == 0 or i in (3, 9)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_against_plain_version(spark, folder):
    rows = pipeline.run(spark, folder).collect()
    expected = plain(corpus())
    library = _load(WORD_BPE)
    lengths = {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in expected.items()}
    assert {r.doc_id: r.length for r in rows} == lengths
    used = defaultdict(int)
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096
    assert len(used) == -(-sum(lengths.values()) // 4096)


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        assert out.where("_doc <> 'd' or _id <> 1").isEmpty()


def test_repeated_rows_nulls_and_empty_tables(spark, folder):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "ab cdef"), (None, "x"), (None, None), (2, None), (2, "")]
    docs = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in rows], SCHEMA)
    left = pipeline.drop_exact_copies(spark, docs, folder)
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == [("1", "a b c d e f"), ("2", None), ("None", "x")] or \
        sorted((str(r.doc_id), r.text or "") for r in left.collect()) == [("1", "a b c d e f"), ("2", ""), ("None", "x")]
    assert pipeline.drop_near_copies(spark, docs, folder).count() == 7
    assert pipeline.reject_toxic(spark, docs, folder).count() == 7
    empty = docs.where(F.lit(False))
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
