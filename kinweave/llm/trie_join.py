"""Trie join: all pairs of distinct words within a bounded edit distance (problem 1).

The trie is joined with itself: like a Levenshtein automaton run for all words at once, each node keeps the set of nodes
whose distance from it is within the bound; a child's set follows from its parent's, so common prefixes are worked on
once.  Node sets are numpy arrays over a level of the trie.

A vocabulary up to WHOLE words (its size is counted first) is sent to every task.  Each task follows a run of the sorted
words, a part of the trie, through the whole trie, so every pair within the bound is met.
Beyond that size words are sharded: once by their first letters, once, reversed, by their last ones.  A pair whose edits
leave either end untouched meets in a shard.  A pair whose edits touch both ends has its first edit among the first
letters and its last one among the last; with at most two edits there are no others, so what is left of both words
without the edited letters is equal, and they meet there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.plans.runtime import cut

#: Letters at either end that shards are cut by.
END = 3
#: Largest distance followed in the trie.
MAX_EDITS = 2
#: Words shorter than this only match themselves.
MIN_LENGTH = 4
#: Words of a shard whose neighbours are searched at a time (bounds the size of the level arrays).
STEP = 20_000
#: Words that a task follows through the trie of a whole vocabulary at a time, however large its share.
RUN = 1_000
#: Words of a vocabulary that is sent to every task: some 20 MB at most.
WHOLE = 1_000_000
#: The second word of a pair is the one that stands for both: it weighs more, or as much and comes first in order.
OUTWEIGHS = "nb > na or (nb = na and b < a)"


class Trie:
    """Sorted words as level-wise arrays; children of a node are consecutive."""

    def __init__(self, words: list[bytes]):
        self.words = words
        n, width = len(words), max(map(len, words))
        m = np.zeros((n, width), np.uint8)
        for i, w in enumerate(words):
            m[i, : len(w)] = np.frombuffer(w, np.uint8)
        self.size = np.fromiter(map(len, words), np.int64, n)
        fresh = np.zeros(n, bool)
        fresh[0] = True
        at = np.zeros(n, np.int64)  # node of each word at the level before
        letter, first, count, word, self.at = [np.zeros(1, np.uint8)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.full(1, -1)], [at]
        total = 1
        for level in range(width):
            fresh[1:] |= m[1:, level] != m[:-1, level]
            alive = self.size > level
            new = fresh & alive
            ids = np.cumsum(new) - 1 + total
            rows = np.flatnonzero(new)
            parents = at[rows]
            base = total - len(first[-1])
            cnt = np.bincount(parents - base, minlength=len(first[-1]))
            count[-1][:] = cnt
            first[-1][:] = total + np.cumsum(cnt) - cnt
            letter.append(m[rows, level])
            first.append(np.zeros(len(rows), np.int64))
            count.append(np.zeros(len(rows), np.int64))
            ends = np.full(len(rows), -1)
            at = np.where(alive, ids, -1)
            last = np.flatnonzero(self.size == level + 1)
            ends[at[last] - total] = last
            word.append(ends)
            self.at.append(at)
            total += len(rows)
        self.letter, self.first, self.count, self.word = map(np.concatenate, (letter, first, count, word))
        self.total = total

    def children(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into nodes, child) of all children."""
        c = self.count[nodes]
        of = np.repeat(np.arange(len(nodes)), c)
        start = np.repeat(self.first[nodes] - (np.cumsum(c) - c), c)
        return of, start + np.arange(len(of))


def _least(a: np.ndarray, b: np.ndarray, d: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key = (a * total + b) * 8 + d
    key.sort()
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] >> 3) != (key[:-1] >> 3)
    key = key[keep]
    pair = key >> 3
    return pair // total, pair % total, key & 7


def neighbours(trie: Trie, roots: np.ndarray, level: int, k: int, run: slice | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word, word, distance) of all pairs below the same root within distance k.

    ``run``: first words are those of this run of the sorted words only.
    """
    mine = np.ones(trie.total, bool)
    if run is not None:
        mine[:] = False
        for nodes in trie.at:
            mine[nodes[run][nodes[run] >= 0]] = True
    a = b = roots
    d = np.zeros(len(roots), np.int64)
    while len(a):
        for _ in range(k):  # letters that only the second word has
            can = d < k
            of, kid = trie.children(b[can])
            a, b, d = _least(np.concatenate([a, a[can][of]]), np.concatenate([b, kid]), np.concatenate([d, d[can][of] + 1]), trie.total)
        hit = (trie.word[a] >= 0) & (trie.word[b] >= 0) & (a != b)
        if hit.any():
            x, y, z = trie.word[a[hit]], trie.word[b[hit]], d[hit]
            if run is not None:  # a word that begins others may belong to another run
                own = (x >= run.start) & (x < run.stop)
                x, y, z = x[own], y[own], z[own]
            yield x, y, z
        of, kid = trie.children(a)
        own = mine[kid]
        a, b, d = kid[own], b[of[own]], d[of[own]]
        x = trie.letter[a]
        of, other = trie.children(b)
        cost = d[of] + (trie.letter[other] != x[of])
        fit, can = cost <= k, d < k
        a, b, d = _least(np.concatenate([a[can], a[of][fit]]), np.concatenate([b[can], other[fit]]), np.concatenate([d[can] + 1, cost[fit]]), trie.total)


def _join_batch(shards: list[tuple[str, list[str]]], k: int) -> Iterator[pd.DataFrame]:
    batch: list[tuple[str, list[str]]] = []
    size = 0
    for shard in [*shards, None]:
        if batch and (shard is None or size + len(shard[1]) > STEP):
            words = sorted({w.encode() for _, ws in batch for w in ws})
            trie = Trie(words)
            roots = np.unique(trie.at[END][trie.at[END] >= 0])
            per = max(1, len(roots) * STEP // max(len(words), STEP))
            for i in range(0, len(roots), per):
                for a, b, d in neighbours(trie, roots[i : i + per], END, k):
                    yield pd.DataFrame({"a": [words[j].decode() for j in a], "b": [words[j].decode() for j in b], "d": d.astype("int32")})
            batch, size = [], 0
        if shard is not None:
            batch.append(shard)
            size += len(shard[1])


def _without_ends(w: Column, k: int) -> Column:
    """What is left of a word without up to one of its first END and one of its last END letters (k letters at most).

    If only one edit is allowed it has to lie in both ends.
    """
    left = lambda i: F.concat(F.substring(w, F.lit(1), F.lit(i)), F.substring(w, F.lit(i + 2), F.length(w)))
    if k == 1:
        return F.array_distinct(F.array_compact(F.array(w, *[F.when(F.length(w).between(i + 1, i + END), left(i)) for i in range(END)])))
    heads = F.array(w, *[left(i) for i in range(END)])
    right = lambda x, j: F.concat(F.substring(x, F.lit(1), F.length(x) - 1 - j), F.substring(x, F.length(x) - j + 1, F.lit(j)))
    tails = lambda x: F.array(x, *[right(x, j) for j in range(END)])
    return F.array_distinct(F.flatten(F.transform(heads, tails)))


def _both_ends(plain: DataFrame, k: int) -> DataFrame:
    """(a, b, d): pairs within distance k whose first END and whose last END letters differ."""
    # with one edit, only words up to 2 END - 1 letters have a letter in both ends
    few = plain.filter(F.length("w") <= 2 * END - 1) if k == 1 else plain
    keys = few.select(F.explode(_without_ends(F.col("w"), k)).alias("key"), "w")
    ends = (F.substring("a", 1, END) != F.substring("b", 1, END)) & (F.substring("a", -END, END) != F.substring("b", -END, END))
    met = keys.withColumnRenamed("w", "a").join(keys.withColumnRenamed("w", "b"), "key").filter((F.col("a") < F.col("b")) & ends)
    near = met.withColumn("d", F.levenshtein("a", "b")).filter(F.col("d") <= k).select("a", "b", "d")
    return near.unionAll(near.select("b", "a", "d"))


def _in_whole(plain: DataFrame, k: int, weighed: bool) -> DataFrame:
    """(a, b, d) by the trie of all words in every task; each follows a run of the sorted words through it."""
    spark = plain.sparkSession
    rows = sorted((r.w.encode(), r.n) for r in plain.collect())
    held = spark.sparkContext.broadcast([w for w, _ in rows])
    weights = spark.sparkContext.broadcast(np.array([n for _, n in rows], np.int64) if weighed else None)
    shares = 2 * spark.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not held.value or not batch.num_rows:
                continue
            trie, n = Trie(held.value), len(held.value)
            words = pa.array([w.decode() for w in held.value])
            for share in batch.column(0).to_pylist():
                end = n * (share + 1) // shares
                for at in range(n * share // shares, end, RUN):
                    for a, b, d in neighbours(trie, np.zeros(1, np.int64), 0, k, slice(at, min(at + RUN, end))):
                        if weighed:
                            n = weights.value
                            more = (n[b] > n[a]) | ((n[b] == n[a]) & (b < a))
                            a, b, d = a[more], b[more], d[more]
                        yield pa.RecordBatch.from_arrays([words.take(pa.array(a)), words.take(pa.array(b)), pa.array(d.astype(np.int32))], names=["a", "b", "d"])

    return spark.range(0, shares, 1, shares).mapInArrow(run, "a string, b string, d int")


def trie_join(words: DataFrame, column: str, k: int = MAX_EDITS, whole: int = WHOLE, weight: str | None = None) -> DataFrame:
    """(a, b, d): pairs of different words of ``column`` (plain letters) at Levenshtein distance d <= k.

    Both directions are given, and every pair is met (k is 1 or 2).  Words shorter than MIN_LENGTH and nulls take no
    part.  Repeated words count once; other columns are ignored.  Vocabularies up to ``whole`` words are sent to all
    tasks, larger ones are sharded; the result is the same.  With a ``weight`` (a whole number for each word) one
    direction is given, from the word that the other OUTWEIGHS.
    """
    if k not in (1, MAX_EDITS):
        raise ValueError(f"k must be 1 or {MAX_EDITS}")
    plain = words.select(F.col(column).alias("w"), (F.col(weight) if weight else F.lit(0)).cast("long").alias("n")).filter(F.length("w") >= MIN_LENGTH).groupBy("w").agg(F.max("n").alias("n"))
    if whole:
        plain = cut(plain)
        if plain.count() <= whole:
            return _in_whole(plain, k, weight is not None)
    met = _sharded(plain.select("w"), k)
    if weight is None:
        return met
    return met.join(plain.select(F.col("w").alias("a"), F.col("n").alias("na")), "a").join(plain.select(F.col("w").alias("b"), F.col("n").alias("nb")), "b").filter(OUTWEIGHS).select("a", "b", "d")


def _sharded(plain: DataFrame, k: int) -> DataFrame:
    ways = plain.select(F.explode(F.array(F.struct(F.lit(False).alias("back"), F.col("w")), F.struct(F.lit(True).alias("back"), F.reverse("w").alias("w")))).alias("x")).select("x.*")
    ways = ways.withColumn("shard", F.concat(F.col("back").cast("string"), F.substring("w", 1, END))).repartition("shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bool, list] = {False: [], True: []}
        for pdf in batches:
            for (back, shard), g in pdf.groupby(["back", "shard"], sort=False):
                lane = held[bool(back)]
                if lane and lane[-1][0] == shard:
                    lane[-1][1].extend(g["w"])
                else:
                    lane.append((shard, list(g["w"])))
        for back, shards in held.items():
            for out in _join_batch(shards, k):
                if back:
                    out["a"], out["b"] = out["a"].str[::-1], out["b"].str[::-1]
                yield out

    found = ways.select("back", "shard", "w").mapInPandas(run, "a string, b string, d int")
    return found.unionAll(_both_ends(plain, k)).groupBy("a", "b").agg(F.min("d").alias("d"))
