"""Spelling variants: words one inserted, deleted or replaced letter apart, by pairs of trie nodes.

Every word is a path in a trie of the words read forwards and in one of the words read backwards. Nodes have
integer numbers: up to seven letters deep the number is the node's letters, eight bits each; deeper nodes that at
least two words pass get theirs from a dictionary (a deeper node of one word alone can join nothing). A word's
place k gives two pairs (node of the letters before, node of the letters behind): with letter k skipped, and with
nothing skipped, where a letter may be inserted. Two words that share a skipping pair differ by one replaced letter;
a word whose skipping pair is another's inserting pair has one letter more. Each pair of numbers holds at most one
word with nothing skipped and one word per letter otherwise, so a group is never larger than the alphabet, and what
is asked of the neighbours (how many, which is the most frequent) is aggregated per group: no pair is written.

Words are numbered from the most frequent down, ties in code-point order, so the best neighbour is the least number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patronage.session import durable

LEAST_LETTERS = 7
LEAST_COUNT = 2
FORM_FACTOR = 10
LETTERS = r"[A-Za-zÀ-ÿ]"
DAMAGE = 31  # the query deletes a letter in one of so many words
PACKED = 7  # letters of a node whose number is written out
PLAIN_KEY = 32  # letters of a deeper node that are its key as they are; longer ones are digested
_FIRST_NUMBER = 1 << 60  # numbers from the dictionary, beyond all packed ones
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(docs: DataFrame, least: int = LEAST_LETTERS, damage: int | None = None) -> DataFrame:
    """(word, n) of all words of ``docs`` (doc_id, text) with at least ``least`` letters.

    ``damage``: where the checksum of ``doc_id:word`` is divisible by it, the letter at the checksum modulo the
    length is deleted first. Only runs of ``least`` letters or more can give such words; equal words are counted in
    their map task before they are shuffled.
    """
    found = F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{least},}}"), F.lit(0)))
    runs = docs.where("text is not null").select("doc_id", found.alias("_run"))
    word = F.translate("_run", _UPPER, _LOWER)
    if damage:
        key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word"))
        runs = runs.select(word.alias("word"), "doc_id").withColumn("_sum", F.crc32(key))
        at = (F.col("_sum") % F.length("word")).cast("int")
        cut = F.concat(F.expr("substring(word, 1, CAST(_sum % length(word) AS INT))"), F.col("word").substr(at + 2, F.length("word")))
        word = F.when(F.col("_sum") % damage == 0, cut).otherwise(F.col("word"))
    counted = runs.select(word.alias("word")).where(F.length("word") >= least)
    return counted.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _deep_key(letters: bytes, digest) -> bytes:
    return letters if len(letters) <= PLAIN_KEY else digest.digest()


def _deep_nodes(word: bytes) -> list[bytes]:
    """The keys of the nodes of 0 … len(word) letters of a word read forwards; packed ones are empty."""
    keys, digest = [], hashlib.sha256(word[:PLAIN_KEY])
    for depth in range(len(word) + 1):
        if depth > PLAIN_KEY:
            digest.update(word[depth - 1 : depth])
        keys.append(b"" if depth <= PACKED else _deep_key(word[:depth], digest))
    return keys


def _packed_nodes(letters: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """(words, PACKED + 1) numbers of the nodes of up to PACKED letters, read from place ``at`` on in steps."""
    out = np.ones((len(at), PACKED + 1), dtype=np.int64)
    for depth in range(1, PACKED + 1):
        place = np.clip(at + step * (depth - 1), 0, max(len(letters) - 1, 0))
        out[:, depth] = (out[:, depth - 1] << 8) | letters[place]
    return out


def _places(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of (word, id): the words in one byte per letter, and for each of their pairs the word's index, the letters
    before and behind, and whether a letter is skipped."""
    words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    many = 2 * sizes + 1
    index = np.repeat(np.arange(len(words)), many)
    turn = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    before = turn // 2
    skips = turn % 2 == 1
    behind = sizes[index] - before - skips
    return words, index, before, behind, skips


_PAIR = "id long, p long, s long, skips boolean, first boolean"


def _pairs(batch: pa.RecordBatch, deep: bool) -> pa.RecordBatch:
    words, index, before, behind, skips = _places(batch)
    chosen = (before > PACKED) | (behind > PACKED)
    chosen = np.flatnonzero(chosen if deep else ~chosen)
    index, before, behind, skips = index[chosen], before[chosen], behind[chosen], skips[chosen]
    letters = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    front = _packed_nodes(letters, begin, 1)[index, np.minimum(before, PACKED)]
    back = _packed_nodes(letters, begin + sizes - 1, -1)[index, np.minimum(behind, PACKED)]
    # of equal letters in a row only the first counts as the inserted one
    at = begin[index] + before
    own, previous = letters[np.minimum(at, len(letters) - 1)], letters[np.maximum(at - 1, 0)]
    first = skips & ((before == 0) | (own != previous))
    ids = batch.column(1).to_numpy()[index]
    columns = [pa.array(ids), pa.array(front), pa.array(back), pa.array(skips), pa.array(first)]
    names = ["id", "p", "s", "skips", "first"]
    if deep:
        keys = [(_deep_nodes(w), _deep_nodes(w[::-1])) for w in words]
        pkeys = [keys[i][0][d] or None for i, d in zip(index.tolist(), before.tolist())]
        skeys = [keys[i][1][d] or None for i, d in zip(index.tolist(), behind.tolist())]
        columns += [pa.array(pkeys, pa.binary()), pa.array(skeys, pa.binary())]
        names += ["pkey", "skey"]
    return pa.RecordBatch.from_arrays(columns, names)


def _emit(words: DataFrame, deep: bool) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = 0
            sizes = np.cumsum(np.array([len(w) for w in batch.column(0).to_pylist()], dtype=np.int64))
            while begin < batch.num_rows:
                # a slice has about 40,000 letters, or is one word
                before = sizes[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(sizes, before + 40_000, side="right")))
                yield _pairs(batch.slice(begin, end - begin), deep)
                begin = end

    return words.select("word", "id").mapInArrow(emit, _PAIR + (", pkey binary, skey binary" if deep else ""))


def _node_numbers(words: DataFrame) -> DataFrame:
    """(backwards, key, number) of the deeper nodes of both tries that at least two words pass."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word in batch.column(0).to_pylist():
                letters = word.encode("latin-1")
                if len(letters) > PACKED:
                    ahead, back = _deep_nodes(letters)[PACKED + 1 :], _deep_nodes(letters[::-1])[PACKED + 1 :]
                    sides = [False] * len(ahead) + [True] * len(back)
                    yield pa.RecordBatch.from_arrays([pa.array(sides), pa.array(ahead + back, pa.binary())], ["backwards", "key"])

    passed = words.select("word").mapInArrow(_joined(nodes), "backwards boolean, key binary")
    shared = passed.groupBy("backwards", "key").agg(F.count(F.lit(1)).alias("_words")).where("_words > 1")
    return durable(shared.select("backwards", "key", (F.monotonically_increasing_id() + _FIRST_NUMBER).alias("number")))


def _joined(parts):
    """Small batches joined to larger ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in parts(batches):
            held.append(batch)
            rows += batch.num_rows
            if rows >= 50_000:
                yield pa.concat_batches(held)
                held, rows = [], 0
        if held:
            yield pa.concat_batches(held)

    return run


def _numbered_pairs(words: DataFrame) -> DataFrame:
    """All pairs (id, p, s, skips, first) whose nodes more than one word may share.

    The joins shuffle both sides: Spark takes the pairs for as many as there are words, and would broadcast them.
    """
    numbers = _node_numbers(words)
    fore = numbers.where("not backwards").select(F.col("key").alias("pkey"), F.col("number").alias("_p"))
    back = numbers.where("backwards").select(F.col("key").alias("skey"), F.col("number").alias("_s"))
    kept = ["id", "p", "s", "skips", "first"]
    rows = _emit(words, deep=True)
    ahead = rows.where("pkey is not null").join(fore.hint("merge"), "pkey").withColumn("p", F.col("_p")).select(*kept, "skey")
    rows = ahead.unionByName(rows.where("pkey is null").select(*kept, "skey"))
    behind = rows.where("skey is not null").join(back.hint("merge"), "skey").withColumn("s", F.col("_s")).select(kept)
    deep = behind.unionByName(rows.where("skey is null").select(kept))
    return _emit(words, deep=False).unionByName(deep)


def _neighbours(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best) of every word with a neighbour: how many it has, and the least number among them."""
    group = Window.partitionBy("p", "s")
    skips, first = F.col("skips"), F.col("first")
    counted = pairs.select(
        "id",
        "skips",
        "first",
        F.count(F.lit(1)).over(group).alias("_all"),
        F.count(F.when(skips, 1)).over(group).alias("_skipping"),
        F.count(F.when(first, 1)).over(group).alias("_longer"),
        F.min(F.when(skips, F.col("id"))).over(group).alias("_best_skipping"),
        F.min(F.when(first, F.col("id"))).over(group).alias("_best_longer"),
        F.min(F.when(~skips, F.col("id"))).over(group).alias("_shorter"),
    ).where("_all > 1")
    shorter = F.when(first, F.col("_shorter"))
    near = F.when(skips, F.col("_skipping") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0)).otherwise(F.col("_longer"))
    # a word that is the best of its own group has only rarer neighbours there, and none of them can be its form
    best = F.when(skips, F.least(F.col("_best_skipping"), shorter)).otherwise(F.col("_best_longer"))
    best = F.when(best != F.col("id"), best)
    return counted.groupBy("id").agg(F.sum(near).cast("long").alias("n_near"), F.min(best).alias("best"))


def _roots(steps: DataFrame) -> DataFrame:
    """(id, root) of every word with a form, from (id, form_id): the chain is halved in each round.

    A form is ``factor`` times as frequent, so chains end, after as many rounds as their length has binary digits.
    """
    current = durable(steps.select("id", F.col("form_id").alias("root")))
    while True:
        ahead = current.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        joined = current.join(ahead, "root", "left")
        step = durable(joined.select("id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if step.where("_moved").isEmpty():
            return step.drop("_moved")
        current = step.drop("_moved")


def group_variants(words: DataFrame, factor: int = FORM_FACTOR) -> DataFrame:
    """One row per word of ``words`` (word, n; distinct words of code points up to U+00FF): its near words and form.

    Near words differ by exactly one inserted, deleted or replaced code point. The form is the near word of largest
    n (ties: smallest in code-point order), if that is at least ``factor`` times the word's own n; ``root`` is the
    last word of the chain of forms. Null words are ignored; an empty table gives no rows.

    Columns: word, form, root, n, n_near, form_n.
    """
    ranked = words.where("word is not null").repartitionByRange(F.desc("n"), F.asc("word"))
    ranked = ranked.sortWithinPartitions(F.desc("n"), F.asc("word"))
    # A table of all words is much smaller in its file than in memory, so it is shuffled and never broadcast.
    known = durable(ranked.select("word", "n", F.monotonically_increasing_id().alias("id"))).hint("merge")
    near = durable(_neighbours(_numbered_pairs(known)))
    rows = known.join(near, "id", "left")
    forms = known.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    linked = near.where("best is not null").join(known.select("id", "n"), "id").join(forms, "best")
    linked = durable(linked.where(F.col("form_n") >= F.col("n") * factor).select("id", F.col("best").alias("form_id"), "form", "form_n"))
    roots = _roots(linked.select("id", "form_id")).withColumnRenamed("root", "_root")
    roots = roots.join(known.select(F.col("id").alias("_root"), F.col("word").alias("_last")), "_root").drop("_root")
    rows = rows.join(linked.drop("form_id"), "id", "left").join(roots, "id", "left")
    return rows.select(
        "word",
        "form",
        F.coalesce("_last", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        "form_n",
    )


def spelling_variants(
    docs: DataFrame, least: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, damage: int | None = None
) -> DataFrame:
    """Variants among the words of ``docs`` (doc_id, text), as in ``group_variants``.

    Words are runs of letters (A-Z lower-cased) of at least ``least`` code points that occur ``least_count`` times
    or more. Null and empty texts have none; a null doc_id counts as an empty one in the checksum of ``damage``;
    repeated rows count again; other columns are ignored.
    """
    words = words_of(docs, least, damage)
    return group_variants(durable(words.where(F.col("n") >= least_count)))
