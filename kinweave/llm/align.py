"""Test items inside training text: n-gram seeds join documents to items, then local alignment (problem 8).

A document becomes words without markup.  Seeds (item n-grams) that lie near each other and in order in a document mark a
passage, and Smith-Waterman over words decides how much of the item stands there, edits included: any passage and any
stretch of an alignment that is long and clean enough counts.

The items' words are counted first.  Up to WHOLE_WORDS of them are sent to every task and all documents are read once.  Beyond that
the seeds of documents (those that a bitmap of fixed size over the items' seeds lets pass) are joined with the seeds of
items, and the pairs that share enough are aligned.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.plans.runtime import cut

#: Words of a seed.
SEED = 3
#: Words of the items that are sent to every task (about 100 bytes a word).
WHOLE_WORDS = 1_000_000
#: Bits of the map of item seeds.
MAP_BITS = 1 << 24
#: Item words that have to be spanned by the alignment, and the share of them that must be met.
MIN_SPAN = 25
MIN_MATCHED = 0.9
#: Seeds of one item that a passage needs before it is aligned, however many items hold them.  Of the 23 seeds of 25 words a
#: changed, added or left out word breaks three at most, so five such words leave eight.
MIN_SEEDS = 8
#: Words added or left out that seeds of a passage may be apart in the item and in the text, and words of the text they lie in.
DRIFT = 5
REACH = MIN_SPAN + DRIFT
#: Words without a seed that end a passage.
PASSAGE_GAP = 40
MATCH, MISMATCH, GAP = 2, -1, -1
#: Score below which no alignment meets MIN_MATCHED of MIN_SPAN words, unless more than five words are added in between: 23
#: words met, two not, five added.
LEAST_SCORE = 39
#: Cells of the row of alignments that are scored at a time.
CELLS = 60000

# Markup that is dropped together with its argument, and what else is no word.
_DROPPED = r"\\(?:cite\w*|label|ref|eqref|vspace|hspace|includegraphics|index|pagebreak)\*?(?:\[[^\]]*\])?\{[^}]*\}"
_JOINED = r"\\-|\\/|\\allowbreak ?|\\kern ?-?[\d.]+(?:pt|em)|\x{ad}|-\s*\n%*\s*"
_MACRO = r"\\[a-zA-Z@]+\*?|\\."


def words_of(texts: pa.Array) -> pa.ListArray:
    """Lower-case words of each text without markup; null gives no words."""
    t = pc.utf8_lower(pc.fill_null(texts, ""))
    t = pc.replace_substring_regex(t, _JOINED, "")
    t = pc.replace_substring_regex(t, _DROPPED, " ")
    t = pc.replace_substring_regex(t, _MACRO, " ")
    return pc.split_pattern_regex(t, r"[^\pL\pN]+")


class Items:
    """Vocabulary and seeds of a block of items; items of the same words are one class and aligned once."""

    def __init__(self, ids: list[int], texts: list[str]):
        lists = words_of(pa.array(texts, pa.string())).to_pylist()
        lists = [[w for w in ws if w] for ws in lists]
        classes: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for key, ws in zip(ids, lists, strict=True):
            classes[tuple(ws)].append(key)
        self.ids = list(classes.values())
        lists = list(classes)
        self.vocabulary = sorted({w for ws in lists for w in ws})
        at = {w: i + 1 for i, w in enumerate(self.vocabulary)}
        self.base = len(at) + 2
        self.words = [np.array([at[w] for w in ws], np.int64) for ws in lists]
        every = [codes(ws, self.base) for ws in self.words]
        code = np.concatenate([*every, np.zeros(0, np.int64)])
        order = np.argsort(code, kind="stable")
        self.seeds, self.begin = np.unique(code[order], return_index=True)
        self.begin = np.append(self.begin, len(code))
        self.cls = np.repeat(np.arange(len(every)), [len(c) for c in every])[order]
        self.at = np.concatenate([*(np.arange(len(c)) for c in every), np.zeros(0, np.int64)])[order]


def codes(ids: np.ndarray, base: int) -> np.ndarray:
    """One number per n-gram."""
    n = len(ids) - SEED + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.int64)
    for k in range(SEED):
        out = out * base + ids[k : k + n]
    return out


def _sweep(item: np.ndarray, text: np.ndarray, taken: np.ndarray | None = None) -> tuple[int, int, int]:
    """(score, item end, text end) of the best local alignment that meets no pair of words in ``taken``."""
    steps = np.arange(len(text) + 1) * -GAP
    row = np.zeros(len(text) + 1, np.int64)
    best = (0, 0, 0)
    for i, w in enumerate(item):
        new = np.zeros(len(text) + 1, np.int64)
        same = text == w if taken is None else (text == w) & ~taken[i]
        new[1:] = row[:-1] + np.where(same, MATCH, MISMATCH)
        np.maximum(new, row + GAP, out=new)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + steps) - steps
        j = int(new.argmax())
        if new[j] > best[0]:
            best = (int(new[j]), i + 1, j)
        row = new
    return best


def scores(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Score of the best local alignment of each (item, text), many at a time."""
    out = np.zeros(len(pairs), np.int64)
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][1]), len(pairs[k][0])))
    begin = 0
    while begin < len(order):
        end = begin + 1
        while end < len(order) and (len(pairs[order[end]][1]) + 1) * (end - begin + 1) <= CELLS:
            end += 1
        part = order[begin:end]
        begin = end
        high, wide = (max(len(pairs[k][x]) for k in part) for x in (0, 1))
        kind = np.int16 if 2 * (high + wide) < 32_000 else np.int32
        # words that stand nowhere fill up
        item, text = np.full((high, len(part)), -1, np.int32), np.full((wide, len(part)), -2, np.int32)
        for n, k in enumerate(part):
            item[: len(pairs[k][0]), n], text[: len(pairs[k][1]), n] = pairs[k]
        steps = (np.arange(wide + 1, dtype=kind) * kind(-GAP))[:, None]
        row, best = np.zeros((wide + 1, len(part)), kind), np.zeros(len(part), kind)
        for w in item:
            new = np.maximum(row + kind(GAP), kind(0))
            met = (text == w).astype(kind)
            met *= kind(MATCH - MISMATCH)
            met += row[:-1]
            met += kind(MISMATCH)
            np.maximum(new[1:], met, out=new[1:])
            new += steps
            np.maximum.accumulate(new, axis=0, out=new)
            new -= steps
            np.maximum(best, new.max(0), out=best)
            row = new
        out[part] = best
    return out


def _met(item: np.ndarray, text: np.ndarray, same: np.ndarray) -> list[tuple[int, int]]:
    """(item word, text word) met by the best alignment of the whole of both; ``same`` tells which may meet."""
    steps = np.arange(len(text) + 1) * -GAP
    rows = [-steps]
    for i in range(len(item)):
        new = rows[-1] + GAP
        np.maximum(new[1:], rows[-1][:-1] + np.where(same[i], MATCH, MISMATCH), out=new[1:])
        rows.append(np.maximum.accumulate(new + steps) - steps)
    i, j = len(item), len(text)
    out = []
    while i and j:
        here = rows[i][j]
        if here == rows[i - 1][j - 1] + (MATCH if same[i - 1, j - 1] else MISMATCH):
            i, j = i - 1, j - 1
            if same[i, j]:
                out.append((i, j))
        elif here == rows[i - 1][j] + GAP:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def stretch(met: np.ndarray) -> tuple[int, float]:
    """(words, share of them met) of the longest stretch of at least MIN_SPAN words that reaches MIN_MATCHED.

    All words, if there is none.
    """
    seen = np.concatenate([[0], np.cumsum(met)])
    for size in range(len(met), MIN_SPAN - 1, -1):
        most = int((seen[size:] - seen[:-size]).max())
        if most >= MIN_MATCHED * size:
            return size, most / size
    return len(met), float(met.mean())


def good(found: tuple[int, float]) -> bool:
    return found[0] >= MIN_SPAN and found[1] >= MIN_MATCHED


def aligned(item: np.ndarray, text: np.ndarray) -> tuple[int, float]:
    """(item words spanned, share of them met) of the best stretch of a local alignment of the words.

    Alignments are taken best first, each without the pairs of words the ones before have met, until a stretch is good
    or nothing is left that could hold one.
    """
    first = (0, 0.0)
    taken = np.zeros((len(item), len(text)), bool)
    while True:
        score, i, j = _sweep(item, text, taken)
        if score < (LEAST_SCORE if first[0] else 1):
            return first
        _, back, forth = _sweep(item[:i][::-1], text[:j][::-1], taken[:i, :j][::-1, ::-1])
        lo, at = i - back, j - forth
        same = (item[lo:i, None] == text[None, at:j]) & ~taken[lo:i, at:j]
        pairs = _met(item[lo:i], text[at:j], same)
        met = np.zeros(back, bool)
        for x, y in pairs:
            met[x] = taken[lo + x, at + y] = True
        found = stretch(met)
        if good(found):
            return found
        first = first if first[0] else found


def dense(cls: np.ndarray, text_at: np.ndarray, item_at: np.ndarray) -> np.ndarray:
    """Which seeds lie with MIN_SEEDS or more of the same item within DRIFT and REACH (a few more are let through).

    Seeds are counted in overlapping steps of place and shift, so every such group lies in one of them as a whole.
    """
    keep = np.zeros(len(cls), bool)
    if not len(cls):
        return keep
    shift = text_at - item_at
    shift, classes = shift - shift.min(), int(cls.max()) + 1
    for ds in (0, DRIFT):
        for dp in (0, REACH):
            place = (text_at + dp) // (2 * REACH)
            key = (place * ((int(shift.max()) + ds) // (2 * DRIFT) + 1) + (shift + ds) // (2 * DRIFT)) * classes + cls
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.diff(np.append(first, len(key)))
            keep[order[np.repeat(n >= MIN_SEEDS, n)]] = True
    return keep


def passages(items: Items, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(class of items, begin, end) of the passages of texts (behind each other, zeros between) that may hold them."""
    known = ids > 0
    may = np.flatnonzero(np.logical_and.reduce([known[k : len(ids) - SEED + 1 + k] for k in range(SEED)])) if len(ids) >= SEED else np.zeros(0, np.int64)
    if not len(may) or not len(items.seeds):
        return
    c = np.zeros(len(may), np.int64)
    for k in range(SEED):
        c = c * items.base + ids[may + k]
    at = np.searchsorted(items.seeds, c)
    at[at == len(items.seeds)] = 0
    met = items.seeds[at] == c
    may, at = may[met], at[met]
    n = items.begin[at + 1] - items.begin[at]
    where = np.repeat(items.begin[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    p, cls, q = np.repeat(may, n), items.cls[where], items.at[where]
    keep = dense(cls, p, q)
    p, cls, q = p[keep], cls[keep], q[keep]
    if not len(p):
        return
    order = np.lexsort((p, cls))
    p, cls, q = p[order], cls[order], q[order]
    new = np.flatnonzero((np.diff(cls) != 0) | (np.diff(p) > PASSAGE_GAP)) + 1
    for lo, hi in zip(np.append(0, new), np.append(new, len(p)), strict=True):
        i = int(cls[lo])
        # as far as the item can reach on either side of its seeds
        before, after = int(q[lo:hi].max()) + 2 * DRIFT, len(items.words[i]) - int(q[lo:hi].min()) + 2 * DRIFT
        yield i, max(0, int(p[lo]) - before), int(p[hi - 1]) + after


def spans(items: Items, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, float]]:
    """(class of items, place of the text, words spanned, share met) of every class that stands in a text well enough."""
    gap = np.zeros(SEED, np.int64)
    flat = np.concatenate([x for t in texts for x in (t, gap)]) if texts else gap
    ends = np.cumsum([len(t) + SEED for t in texts])
    tasks = []
    for i, lo, hi in passages(items, flat):
        # seeds of one text only: the text is the one that the middle lies in
        for k in range(int(np.searchsorted(ends, lo, "right")), min(len(texts), int(np.searchsorted(ends, hi, "left")) + 1)):
            begin = int(ends[k]) - SEED - len(texts[k])
            part = texts[k][max(0, lo - begin) : max(0, hi - begin)]
            if len(part) >= MIN_SPAN // 2:
                tasks.append((i, k, part))
    best: dict[tuple[int, int], tuple[int, float]] = {}
    for (i, k, passage), score in zip(tasks, scores([(items.words[i], passage) for i, _, passage in tasks]), strict=True):
        if score >= LEAST_SCORE:
            best[i, k] = max(best.get((i, k), (0, 0.0)), aligned(items.words[i], passage), key=lambda x: (good(x), x))
    for (i, k), (span, met) in best.items():
        yield i, k, span, met


def _read(items: Items, vocabulary: pa.Array, texts: pa.Array) -> list[np.ndarray]:
    """Numbers of the words of each text; words that no item has are 0."""
    lists = words_of(texts)
    flat = lists.flatten()
    known = np.asarray(pc.fill_null(pc.index_in(flat, value_set=vocabulary), -1)).astype(np.int64) + 1
    # an empty word stands at the ends of a text; it is dropped with its place
    empty = np.asarray(pc.equal(flat, ""))
    offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    return [known[part][~empty[part]] for part in (slice(offsets[k], offsets[k + 1]) for k in range(len(lists)))]


_RESULT = "item_id long, doc_id long, span int, met double"
#: Texts that are worked on together, and bytes of them.
TEXTS, TEXT_BYTES = 200, 4_000_000


def _some(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Ranges of rows with a bounded number of texts and bytes."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0))
    begin = held = 0
    for k in range(batch.num_rows):
        if k > begin and (k - begin >= TEXTS or held + size[k] > TEXT_BYTES):
            yield begin, k
            begin, held = k, 0
        held += int(size[k])
    if batch.num_rows > begin:
        yield begin, batch.num_rows


def _rows(rows: list[tuple[int, int, int, float]]) -> Iterator[pa.RecordBatch]:
    if rows:
        a, b, c, d = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int32()), pa.array(d, pa.float64())], names=["item_id", "doc_id", "span", "met"])


def leaks(documents: DataFrame, items: DataFrame, whole_words: int = WHOLE_WORDS) -> DataFrame:
    """(item_id, doc_id, span, met): documents that hold passages of items, with the item words spanned.

    ``documents``: doc_id, text; ``items``: item_id, item_text.  Null and empty texts hold nothing.  Repeated rows give
    repeated results; other columns are ignored.  Documents are read whole and once; items above ``whole_words`` words
    are joined by their seeds, with the same result.
    """
    docs, held = documents.select("doc_id", "text"), items.select("item_id", "item_text").filter("item_text is not null")
    n = held.agg(F.sum(F.length("item_text"))).first()[0] or 0
    if n == 0:
        return documents.sparkSession.createDataFrame([], _RESULT)
    return _in_whole(docs, held) if n <= 5 * whole_words else _by_seeds(docs, held)


def _in_whole(docs: DataFrame, items: DataFrame) -> DataFrame:
    rows = items.orderBy("item_id").collect()
    held = docs.sparkSession.sparkContext.broadcast(([r.item_id for r in rows], [r.item_text for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Items(*held.value)
        vocabulary = pa.array(block.vocabulary, pa.string())
        for batch in batches:
            keys = batch.column(0)
            out: list[tuple[int, int, int, float]] = []
            for begin, end in _some(batch):
                for i, k, span, met in spans(block, _read(block, vocabulary, batch.column(1).slice(begin, end - begin))):
                    out.extend((item, keys[begin + k].as_py(), span, met) for item in block.ids[i])
            yield from _rows(out)

    return docs.mapInArrow(run, _RESULT)


def _seeds_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of each text, in order."""
    for ws in words_of(texts):
        words = np.array([w for w in (ws.as_py() or []) if w], object)
        n = len(words) - SEED + 1
        h = pd.util.hash_array(words, categorize=True) if len(words) else np.zeros(0, np.uint64)
        out = np.zeros(max(0, n), np.uint64)
        for k in range(SEED if n > 0 else 0):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
        yield out.astype(np.int64)


def _seed_rows(df: DataFrame, key: str, bits: object = None) -> DataFrame:
    """(key, s, at): the seeds of each text, those that the map ``bits`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None if bits is None else np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            for k, s in zip(batch.column(0).to_pylist(), _seeds_of(batch.column(1)), strict=True):
                at = np.arange(len(s))
                if held is not None:
                    b = s % MAP_BITS
                    keep = (held[b >> 3] >> (b & 7)) & 1 > 0
                    s, at = s[keep], at[keep]
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), k)), pa.array(s), pa.array(at)], names=[key, "s", "at"])

    return df.mapInArrow(run, f"{key} long, s long, at long")


def _by_seeds(docs: DataFrame, items: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    item_seeds = cut(_seed_rows(items, "item_id"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(MAP_BITS // 8, np.uint8)
        for batch in batches:
            b = batch.column(0).to_numpy() % MAP_BITS
            np.bitwise_or.at(bits, b >> 3, (1 << (b & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    # one map of MAP_BITS from each of a few tasks
    maps = [np.frombuffer(r.bits, np.uint8) for r in item_seeds.select("s").coalesce(8).mapInArrow(mapped, "bits binary").collect()]
    bits = spark.sparkContext.broadcast(np.bitwise_or.reduce(maps).tobytes())
    hits = _seed_rows(docs.filter("text is not null"), "doc_id", bits).withColumnRenamed("at", "p").join(item_seeds.withColumnRenamed("at", "q"), "s")
    steps = [F.struct(F.floor((F.col("p") - F.col("q") + ds) / (2 * DRIFT)).alias("d"), F.floor((F.col("p") + dp) / (2 * REACH)).alias("r"), F.lit(ds * 1000 + dp).alias("o")) for ds in (0, DRIFT) for dp in (0, REACH)]
    near = hits.select("doc_id", "item_id", F.explode(F.array(*steps)).alias("x")).groupBy("doc_id", "item_id", "x").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_SEEDS)
    pairs = near.select("doc_id", "item_id").distinct()
    both = pairs.join(docs.filter("text is not null"), "doc_id").join(items, "item_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, float]] = []
            for k, (doc, item, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                block = Items([item], [text])
                for _, _, span, met in spans(block, _read(block, pa.array(block.vocabulary, pa.string()), batch.column(1).slice(k, 1))):
                    out.append((item, doc, span, met))
            yield from _rows(out)

    return both.select("doc_id", "text", "item_id", "item_text").mapInArrow(run, _RESULT)
