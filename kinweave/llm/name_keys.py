"""Keys and pairs of names from the spellings of their words, worked out over Arrow batches (problems 1 and 6).

Of every two words of a name, each spelling of one with each of the other is a key (kind TWO), whatever the order of the
words.  A word beside an abbreviation gives keys of its spellings and the abbreviation's first letter (CUT), which the same
spellings beside whole words meet (WHOLE); what the abbreviation has must begin the whole word.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.plans.runtime import shuffle_width

TWO, CUT, WHOLE = 0, 1, 2
#: Letters of a word that are compared with an abbreviation.
STEM = 8
#: Rows of a key that are paired in one task; the rows of larger keys are handed on and joined.
BIG = 500_000
#: Keys of a name, about, and rows that are packed and taken from packs at a time.
PER_NAME = 12
PACK = 1_000_000
#: Pairs that are looked at together, and handed to the JVM at once (some 90 bytes each on both sides).
STEP = 250_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

KEYS = "key bigint, kind int, stem bigint, nid bigint, n int, tabs int, years bigint"
_NAMES = [f.split()[0] for f in KEYS.split(", ")]
#: Bits of ``tabs`` below those of the dates, the tables whose pairs may be some years apart, and the one whose pairs may not.
TABS = 3
REGISTRIES, CERTIFICATE = 3, 4
#: Rows of KEYS as they are exchanged: those of a bucket, under their names, compressed from ``size`` bytes.
PACKED = "bucket int, size int, rows binary"


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two numbers, in their order."""
    h = (a.astype(np.uint64) * _MIX[0]) ^ (b.astype(np.uint64) + _MIX[2])
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return (h ^ (h >> np.uint64(31))).astype(np.int64)


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index repeated as often as it counts, running number within each)."""
    of = np.repeat(np.arange(len(count)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)


def _packed(words: pa.Array) -> np.ndarray:
    """The first STEM letters as one number, first letter highest; short words are filled with zeros."""
    cut = np.array(pc.utf8_slice_codeunits(pc.replace_substring(words, ".", ""), 0, STEM).to_pylist(), f"S{STEM}")
    return cut.view(">u8").astype(np.uint64)


def _keys(batch: pa.RecordBatch) -> pa.RecordBatch:
    lists = batch.column("xs")
    off = np.asarray(lists.offsets)
    items = lists.values
    words = items.field("w")
    hubs = items.field("hubs")
    hub, hoff = np.asarray(hubs.values), np.asarray(hubs.offsets)
    size = np.diff(hoff)
    short = np.asarray(pc.or_(pc.ends_with(words, "."), pc.less_equal(pc.utf8_length(words), 2)))
    stem = _packed(words)
    letter = stem >> np.uint64(56)
    m = np.diff(off)
    # all pairs of words of a name
    two = np.flatnonzero(m == 2)
    i, j, name = [off[two]], [off[two] + 1], [two]
    for r in np.flatnonzero(m > 2):
        x, y = np.triu_indices(m[r], 1)
        i.append(off[r] + x)
        j.append(off[r] + y)
        name.append(np.full(len(x), r))
    i, j, name = map(np.concatenate, (i, j, name))
    out = []
    whole = ~short[i] & ~short[j]
    a, b, who = i[whole], j[whole], name[whole]
    of, k = _spread(size[a] * size[b])
    x, y = hub[hoff[a[of]] + k // size[b[of]]], hub[hoff[b[of]] + k % size[b[of]]]
    out.append((mixed(np.minimum(x, y), np.maximum(x, y)), np.full(len(of), TWO), np.zeros(len(of), np.uint64), who[of]))
    for a, b in ((i, j), (j, i)):
        of, k = _spread(size[a])
        other = b[of]
        out.append((mixed(hub[hoff[a[of]] + k], letter[other]), np.where(short[other], CUT, WHOLE), stem[other], name[of]))
    one = np.flatnonzero(m == 1)
    of, k = _spread(size[off[one]])
    x = hub[hoff[off[one][of]] + k]
    out.append((mixed(x, x), np.full(len(of), TWO), np.zeros(len(of), np.uint64), one[of]))
    key, kind, stems, who = map(np.concatenate, zip(*out, strict=True))
    order = np.argsort(who.astype(np.min_scalar_type(batch.num_rows)), kind="stable")  # rows of a name stand together
    key, kind, stems, who = key[order], kind[order], stems[order], who[order]
    held = [batch.column(c).take(pa.array(who)) for c in ("nid", "n", "tabs", "years")]
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(kind.astype(np.int32)), pa.array(stems.astype(np.int64)), *held], names=_NAMES)


def _bytes(a: np.ndarray) -> bytes:
    """First bytes first: what is alike stands together."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


#: What a pack holds one after the other: of each row, of each row that is not TWO, of each name (``held`` rows).
_PARTS = [("key", np.int64, 0), ("kind", np.uint8, 0), ("stem", np.int64, 1), ("nid", np.int64, 2), ("held", np.int32, 2), ("n", np.int32, 2), ("tabs", np.int32, 2), ("years", np.int64, 2)]


def _packs(batches: list[pa.RecordBatch], buckets: int) -> pa.RecordBatch:
    """PACKED of rows of KEYS; what is known of a name is told once for its rows of a bucket that stand together."""
    cols = {c: np.concatenate([np.asarray(b.column(c)) for b in batches]) for c in _NAMES}
    bucket = (cols["key"].view(np.uint64) % np.uint64(buckets)).astype(np.min_scalar_type(buckets))
    order = np.argsort(bucket, kind="stable")
    bucket, cols = bucket[order], {c: v[order] for c, v in cols.items()}
    fresh = np.ones(len(bucket), bool)
    fresh[1:] = (bucket[1:] != bucket[:-1]) | (cols["nid"][1:] != cols["nid"][:-1])
    first = np.flatnonzero(fresh)
    held = np.diff(np.append(first, len(bucket)))
    of, sizes, blobs = np.unique(bucket), [], []
    for b in of:
        lo, hi = np.searchsorted(bucket, b), np.searchsorted(bucket, b, "right")
        i, j = np.searchsorted(first, lo), np.searchsorted(first, hi)
        mine = {c: v[lo:hi] for c, v in cols.items()} | {"held": held[i:j], **{c: cols[c][first[i:j]] for c in ("nid", "n", "tabs", "years")}}
        mine["stem"] = mine["stem"][mine["kind"] != TWO]
        told = [mine[c].astype(t) for c, t, _ in _PARTS]
        raw = b"".join([np.array([hi - lo, len(mine["stem"]), j - i], np.int64).tobytes(), told[0].tobytes(), *map(_bytes, told[1:])])
        sizes.append(len(raw))
        blobs.append(pa.compress(raw, "zstd", asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "size", "rows"])


def _unpacked(blob: bytes, size: int) -> dict[str, np.ndarray]:
    raw = np.frombuffer(pa.decompress(blob, size, "zstd", asbytes=True), np.uint8)
    counts, out, at = raw[:24].view(np.int64), {}, 24
    for c, t, of in _PARTS:
        w, count = np.dtype(t).itemsize, int(counts[of])
        part = raw[at : at + count * w]
        out[c] = (part if c == "key" else np.ascontiguousarray(part.reshape(w, count).T).reshape(-1)).view(t)
        at += count * w
    out["kind"] = out["kind"].astype(np.int32)
    stem = np.zeros(len(out["key"]), np.int64)
    stem[out["kind"] != TWO] = out["stem"]
    held, out["stem"] = out.pop("held"), stem
    return out | {c: np.repeat(out[c], held) for c in ("nid", "n", "tabs", "years")}


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(bucket, (compressed rows, size)), and (None, None) behind the last."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].as_py(), (batch.column(2)[i].as_py(), batch.column(1)[i].as_py())
    yield None, None


def _in_packs(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        waiting.append(batch)
        size += batch.num_rows
        if size >= PACK:
            yield _packs(waiting, buckets)
            waiting, size = [], 0
    if size:
        yield _packs(waiting, buckets)


def buckets_of(spark: SparkSession, names: int) -> int:
    """So many that a bucket has half of PACK rows about, and as many in each partition."""
    width = shuffle_width(spark)
    return width * max(1, ceil(names * PER_NAME / (width * PACK // 2)))


def keys_of(grouped: DataFrame, buckets: int) -> DataFrame:
    """PACKED rows of KEYS for names (nid, n, tabs, years, xs: array of struct w, hubs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_packs((_keys(batch) for batch in batches if batch.num_rows), buckets)

    return grouped.select("nid", "n", "tabs", "years", "xs").mapInArrow(run, PACKED)


def _filled(batch: pa.RecordBatch, known: pa.Table, order: list[str]) -> pa.RecordBatch:
    """nid, n, tabs, years, ws (words) with the spellings of the words as xs; ``known``: w (in order), own, hubs.

    A name of abbreviations only is completed in its longest one (of three letters at least) to every word it can be.
    """
    lists = batch.column("ws")
    words, off = lists.values, np.asarray(lists.offsets)
    hubs = known.column("hubs").chunk(0).take(pc.index_in(words, known.column("w").chunk(0)))
    short = np.asarray(pc.or_(pc.ends_with(words, "."), pc.less_equal(pc.utf8_length(words), 2)))
    whole = np.concatenate([[0], np.cumsum(~short)])
    completed: dict[int, list[int]] = {}
    for r in np.flatnonzero((whole[off[1:]] == whole[off[:-1]]) & (np.diff(off) > 0)):
        mine = words[off[r] : off[r + 1]].to_pylist()
        long = max(mine, key=lambda w: (len(w), w))
        stem = long.removesuffix(".")
        if len(long) <= 3 or len(stem) > STEM + 1:
            continue
        lo, hi = bisect_left(order, stem), bisect_left(order, stem + "{")  # behind all letters
        lo += lo < hi and order[lo] == stem and len(stem) > 3
        if lo < hi:
            completed |= {int(off[r]) + i: known.column("own").chunk(0)[lo:hi].to_pylist() for i, w in enumerate(mine) if w == long}
    if completed:
        told = hubs.to_pylist()
        for at, found in completed.items():
            told[at] = found
        hubs = pa.array(told, pa.list_(pa.int64()))
    xs = pa.ListArray.from_arrays(lists.offsets, pa.StructArray.from_arrays([words, hubs], names=["w", "hubs"]))
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("nid", "n", "tabs", "years")], xs], names=["nid", "n", "tabs", "years", "xs"])


def keys_from(names: DataFrame, hub_of: DataFrame, filtered: int, buckets: int) -> tuple[DataFrame, list[Broadcast]]:
    """``keys_of`` names (nid, n, tabs, years, ws: words) with a vocabulary (w, hubs) that is sent to all tasks, and what was sent.

    Rows that only abbreviations meet (WHOLE) are left out where no abbreviation gives their key, if the keys of
    abbreviations are not more than ``filtered``.
    """
    spark = names.sparkSession
    held = spark.sparkContext.broadcast(hub_of.select("w", F.xxhash64("w").alias("own"), "hubs").toArrow().sort_by("w").combine_chunks())
    names = names.select("nid", "n", "tabs", "years", "ws")

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = order = None
        for batch in batches:
            if batch.num_rows and len(held.value):
                if known is None:
                    known, order = held.value, held.value.column("w").to_pylist()
                yield _keys(_filled(batch, known, order))

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in every(batches):
            key = np.unique(np.asarray(out.column("key"))[np.asarray(out.column("kind")) == CUT])
            yield pa.RecordBatch.from_arrays([pa.array(key)], names=["key"])

    asked = names.filter(F.exists("ws", lambda w: w.endswith(".") | (F.length(w) <= 2))).mapInArrow(cuts, "key bigint").distinct().limit(filtered + 1).toArrow()
    if len(asked) > filtered:
        return names.mapInArrow(lambda batches: _in_packs(every(batches), buckets), PACKED), [held]
    met = spark.sparkContext.broadcast(np.sort(asked.column("key").to_numpy()))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = met.value
        for out in every(batches):
            key, kind = np.asarray(out.column("key")), np.asarray(out.column("kind"))
            at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
            yield out.filter(pa.array((kind != WHOLE) | ((keys[at] == key) if len(keys) else False)))

    return names.mapInArrow(lambda batches: _in_packs(some(batches), buckets), PACKED), [held, met]


def begins(cut: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """What the abbreviation has begins the word; from four letters one of them may differ."""
    same = (cut ^ whole).astype(">u8").view(np.uint8).reshape(-1, STEM) == 0
    has = cut.astype(">u8").view(np.uint8).reshape(-1, STEM) != 0
    off = (~same & has).sum(1)
    return off <= (has.sum(1) > 3)


def _fewer_first(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, nid_a: np.ndarray, nid_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a and b changed over where b is of the name of fewer records, or of as many and the lower number."""
    first = (na < nb) | ((na == nb) & (nid_a < nid_b))
    return np.where(first, a, b), np.where(first, b, a)


def _where(sides: Callable, tabs: np.ndarray, other: np.ndarray, years: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Bits of the tables in which two names may meet: registries with years a step apart, certificates with a year and a date in common."""
    one = np.uint64(1)
    wide = others | (others << one) | (others >> np.uint64(63)) | (others >> one) | (others << np.uint64(63))
    same = (years & others != 0) & ((tabs & other) >> TABS != 0)
    return (sides(tabs, other) & (np.where(years & wide != 0, REGISTRIES, 0) | np.where(same, CERTIFICATE, 0))).astype(np.int32)


def _pairs(cols: dict[str, np.ndarray], sides: Callable, heavy: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(x, y, heavy, y_years, sides) of the rows of whole keys; x is the name of fewer records, beyond TABS the dates of y are among its sides."""
    order = np.lexsort((cols["kind"], cols["key"]))
    key, kind, stem, nid, n, tabs, years = (cols[c][order] for c in _NAMES)
    stem, years = stem.astype(np.uint64), years.astype(np.uint64)
    size = len(key)
    end = np.searchsorted(key, key, "right")
    # names with two words meet each other, abbreviations all that is behind them
    two = np.concatenate([[0], np.cumsum(kind == TWO)])
    start = np.searchsorted(key, key, "left")
    stop = np.where(kind == TWO, start + two[end] - two[start], np.where(kind == CUT, end, 0))
    count = np.maximum(0, stop - np.arange(size) - 1)
    total = np.cumsum(count)
    lo = 0
    while lo < size:
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + STEP, "right")))
        of, k = _spread(count[lo:hi])
        r = lo + of
        s = r + 1 + k
        both = _where(sides, tabs[r], tabs[s], years[r], years[s])
        fit = (nid[r] != nid[s]) & (both != 0)
        r, s, both = r[fit], s[fit], both[fit]
        cut = kind[r] == CUT
        if cut.any():
            ok = begins(stem[r], stem[s]) | ((kind[s] == CUT) & begins(stem[s], stem[r])) | ~cut
            r, s, both = r[ok], s[ok], both[ok]
        r, s = _fewer_first(r, s, n[r], n[s], nid[r], nid[s])
        yield nid[r], nid[s], n[r].astype(np.int64) * n[s] > heavy, years[s].astype(np.int64), both | (tabs[s] >> TABS << TABS)
        lo = hi


PAIRS = f"x bigint, y bigint, heavy boolean, y_years bigint, sides int, {KEYS}"


def pairs_of(keys: DataFrame, sides: Callable, heavy: int, big: int = BIG) -> DataFrame:
    """Rows of PAIRS: x, y, heavy, the years of y and the tables to look in of the names that share a key, or, of keys with more than ``big`` rows, the rows.

    ``keys`` are rows of KEYS, PACKED or not.  They are exchanged in packs, half the bytes of rows, and sorted bucket by bucket.
    """

    def handed(cols: dict[str, np.ndarray]) -> pa.RecordBatch:
        none = [pa.nulls(len(cols["key"]), t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32())]
        return pa.RecordBatch.from_arrays([*none, *(pa.array(cols[c]) for c in _NAMES)], names=["x", "y", "heavy", "y_years", "sides", *_NAMES])

    def paired(cols: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for x, y, h, years, both in _pairs(cols, sides, heavy):
            if len(x):
                none = [pa.nulls(len(x), t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(h), pa.array(years), pa.array(both), *none], names=["x", "y", "heavy", "y_years", "sides", *_NAMES])

    def split(parts: list[dict], over: np.ndarray) -> tuple[dict, dict, np.ndarray]:
        """The rows that are kept, those that are handed on, and the keys (``over``, and more) that these are of."""
        held = {c: np.concatenate([p[c] for p in parts]) for c in _NAMES}
        if len(held["key"]) <= big and not len(over):
            return held, {c: v[:0] for c, v in held.items()}, over
        key, count = np.unique(held["key"], return_counts=True)
        over = np.union1d(over, key[count > big])
        on = np.isin(held["key"], over)
        return {c: v[~on] for c, v in held.items()}, {c: v[on] for c, v in held.items()}, over

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, parts, size, most, over = None, [], 0, 0, np.zeros(0, np.int64)
        for bucket, blob in _blobs(batches):
            if bucket != of:
                if parts:
                    kept, on, _ = split(parts, over)
                    for lo in range(0, len(on["key"]), STEP):
                        yield handed({c: v[lo : lo + STEP] for c, v in on.items()})
                    yield from paired(kept)
                of, parts, size, most, over = bucket, [], 0, 4 * PACK, np.zeros(0, np.int64)
            if blob is None:
                continue
            parts.append(_unpacked(*blob))
            size += len(parts[-1]["key"])
            if size > most:  # a bucket this large has keys that are handed on
                kept, on, over = split(parts, over)
                for lo in range(0, len(on["key"]), STEP):
                    yield handed({c: v[lo : lo + STEP] for c, v in on.items()})
                parts, size = [kept], len(kept["key"])
                most = 2 * size + 4 * PACK

    width = shuffle_width(keys.sparkSession)
    packed = keys if "bucket" in keys.columns else keys.mapInArrow(lambda batches: _in_packs(batches, width), PACKED)
    return packed.repartitionById(width, F.col("bucket") % width).sortWithinPartitions("bucket").mapInArrow(run, PAIRS)


def joined_pairs(rows: DataFrame, sides: Callable, heavy: int) -> DataFrame:
    """x, y, heavy, y_years and sides of the rows that were handed on, by a join that spills and is split where it is skewed."""
    other = rows.select("key", *[F.col(c).alias(f"{c}2") for c in _NAMES[1:]])
    met = rows.join(other, "key").filter(((F.col("kind") == TWO) & (F.col("kind2") == TWO) & (F.col("nid") < F.col("nid2"))) | ((F.col("kind") == CUT) & (F.col("kind2") != TWO) & (F.col("nid") != F.col("nid2"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {f.name: np.asarray(b.column(f.name)) for f in b.schema}
            y, z = c["years"].astype(np.uint64), c["years2"].astype(np.uint64)
            both = _where(sides, c["tabs"], c["tabs2"], y, z)
            fit = both != 0
            cut = c["kind"] == CUT
            s, t = c["stem"].astype(np.uint64), c["stem2"].astype(np.uint64)
            fit &= ~cut | begins(s, t) | ((c["kind2"] == CUT) & begins(t, s))
            n, nid = [c["n"][fit], c["n2"][fit]], [c["nid"][fit], c["nid2"][fit]]
            names = _fewer_first(*nid, *n, *nid)
            late, dates = (_fewer_first(c[v][fit], c[f"{v}2"][fit], *n, *nid)[1] for v in ("years", "tabs"))
            yield pa.RecordBatch.from_arrays([*map(pa.array, names), pa.array(n[0].astype(np.int64) * n[1] > heavy), pa.array(late), pa.array(both[fit] | (dates >> TABS << TABS))], names=["x", "y", "heavy", "y_years", "sides"])

    return met.mapInArrow(run, "x bigint, y bigint, heavy boolean, y_years bigint, sides int")
