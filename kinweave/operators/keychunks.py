"""Per-key results over keys of very different weight, by exact offset chunking.

A group-by that needs a key's rows in order sends the whole key to one task.  Here rows are range-partitioned by
(key, order), so a heavy key is spread over several partitions that are in order among themselves:

1. count the rows of each key in each partition,
2. prefix-sum these counts over a key's partitions, which gives every partition an exact offset,
3. number every row: offset plus its position among its key's rows of the partition,
4. cut a key's numbered rows into chunks of equal size and reduce each chunk on its own to a boundary state,
5. merge the ordered boundary states of a key.

No task ever holds more than one chunk of a key, and nothing is sampled or dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.plans.runtime import cut, shuffle_width

#: Rows of one key that a single task reduces in order.
CHUNK_ROWS = 4096

_PID, _ORD, _NO, _CHUNK = "__pid", "__ord", "__no", "__chunk"


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Adds ``__no``: 1, 2, ... per key in the given order, without a window over whole keys.

    Null key values form keys of their own.  Rows that tie in ``order`` are numbered in an arbitrary but fixed order
    (the sorted projection is written once, so every later stage sees the same one).  An empty input gives no rows.
    """
    width = shuffle_width(df.sparkSession)
    cols = [F.col(c) for c in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    placed = df.repartitionByRange(width, *cols).sortWithinPartitions(*cols)
    mid = F.monotonically_increasing_id()
    placed = cut(placed.withColumn(_ORD, mid))
    placed = placed.withColumn(_PID, F.shiftright(F.col(_ORD), 33))
    per_part = placed.groupBy(*keys, _PID).agg(F.count(F.lit(1)).alias("__n"), F.min(_ORD).alias("__first"))
    w = Window.partitionBy(*keys).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    offsets = offsets.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(_PID).alias("__at"), "__first", "__off")
    cond = F.col(_PID) == F.col("__at")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return placed.join(offsets, cond).select(*df.columns, (F.col(_ORD) - F.col("__first") + F.col("__off") + 1).alias(_NO))


def weighted_keys(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], min_share: float) -> DataFrame:
    """Keys that hold at least ``min_share`` of all rows, with their row counts, from the chunked numbering.

    A key's count is the highest number of its rows.  All rows count, also repeated ones; nulls are keys of their own.
    ``min_share`` is in (0, 1].
    """
    chunks = chunked_states(df, keys, order, [])
    return share_of_rows(chunks.groupBy(*keys).agg(F.sum("__rows").alias("n_rows")), keys, min_share)


def share_of_rows(counts: DataFrame, keys: Sequence[str], min_share: float) -> DataFrame:
    """Keeps the keys of ``counts`` (keys, n_rows) that reach the share of the total."""
    total = counts.agg(F.sum("n_rows").alias("__total"))
    # a one-row side: its size is known
    return counts.join(F.broadcast(total), F.col("n_rows") >= F.col("__total") * F.lit(min_share)).select(*keys, "n_rows")


def chunked_states(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], aggs: Sequence[Column], step: Column | None = None, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """One state per (key, chunk): ``__rows``, the given aggregates and, if asked for, an ordered statistic.

    ``step`` is an expression over a row and ``prev`` (struct of the preceding row of the same key); inside a chunk
    its values are summed to ``__steps``; the first row of a chunk has no predecessor there, so the state also keeps
    the chunk's first and last row (``__head``, ``__tail``) for the merge.
    """
    numbered = number_rows(df, keys, order).withColumn(_CHUNK, F.floor((F.col(_NO) - 1) / F.lit(chunk_rows)))
    base = [F.count(F.lit(1)).alias("__rows"), *aggs]
    if step is None:
        return numbered.groupBy(*keys, _CHUNK).agg(*base)
    row = F.struct(*[F.col(c) for c in df.columns])
    w = Window.partitionBy(*keys, _CHUNK).orderBy(_NO)
    stepped = numbered.withColumn("prev", F.lag(row).over(w)).withColumn("__step", F.when(F.col("prev").isNull(), F.lit(0)).otherwise(F.coalesce(step, F.lit(0))))
    return stepped.groupBy(*keys, _CHUNK).agg(*base, F.sum("__step").alias("__steps"), F.min_by(row, F.col(_NO)).alias("__head"), F.max_by(row, F.col(_NO)).alias("__tail"))


def merged_steps(states: DataFrame, keys: Sequence[str], step_between: Column) -> DataFrame:
    """Adds to each chunk's ``__steps`` the step across its left boundary (``prev`` = the tail of the chunk before)."""
    w = Window.partitionBy(*keys).orderBy(_CHUNK)
    joined = states.withColumn("prev", F.lag("__tail").over(w))
    return joined.withColumn("__steps", F.col("__steps") + F.when(F.col("prev").isNull(), F.lit(0)).otherwise(F.coalesce(step_between, F.lit(0))))
