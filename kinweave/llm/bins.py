"""Filling fixed-capacity containers: vector bin packing with a dot-product heuristic (problem 7).

An item has a size in each of three dimensions: tokens, segments and loss-bearing tokens; a container has a limit for
each.  Containers are filled one after the other: of the items that still fit, the one with the largest dot product of
its size and the container's free room goes in, each dimension weighted by how scarce it is.  Packing runs in blocks of
items, each in its own task; a second pass takes the containers that stayed below a fill and packs their contents anew, so
what is left over at the edges of blocks is little.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.plans.runtime import cut

#: Container limits: tokens, segments (texts or parts), loss-bearing tokens (those after the preamble).
CAPACITY = (2048, 24, 2000)
#: Items packed together; a block is one task's group, so its size does not grow with the data.
BLOCK = 4096
#: Containers filled less than this are packed anew in the second pass.
REFILL_BELOW = 0.97
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Word pattern of the byte-level vocabulary (as published with it).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=2)
def _encoding(data: bytes):
    """The tokenizer of a vocabulary file, and the number of bytes of each token."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def parts_of(total: int, head: int, capacity: tuple[int, int, int]) -> list[tuple[int, int]]:
    """Token ranges of a text: the whole, or if it exceeds a limit, runs of as many tokens as fit (loss-bearing from ``head``)."""
    out, lo = [], 0
    while not out or lo < total:
        hi = min(total, lo + capacity[0], max(lo, head) + capacity[2])
        out.append((lo, hi))
        lo = hi
    return out


def sized_texts(documents: DataFrame, capacity: tuple[int, int, int] = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, part, n_parts, first_token, tokens, loss_tokens): whole texts, or parts of those that exceed a limit.

    Parts are consecutive tokens of the text from ``first_token``; loss-bearing tokens are those after the preamble (all,
    if a text has none).  Null and empty texts have one part of no tokens.  The vocabulary file is read here (``tokenizer``, else the
    setting ``kinweave.tokenizer``, else TOKENIZER) and sent to the tasks.
    """
    spark = documents.sparkSession
    with open(tokenizer or spark.conf.get("kinweave.tokenizer", TOKENIZER), "rb") as f:
        held = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sizes = _encoding(held.value)
        for batch in batches:
            out: list[tuple[int, int, int, int, int, int]] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                source = text.as_py() or ""
                ids = enc.encode_ordinary(source)
                cut_at = source.find("\\begin{document}")
                head = 0
                if cut_at > 0:  # tokens that begin before the body
                    ends = np.cumsum(sizes[ids])
                    head = int(np.searchsorted(ends, len(source[:cut_at].encode()), "left"))
                parts = parts_of(len(ids), head, capacity)
                for k, (lo, hi) in enumerate(parts):
                    out.append((key, k, len(parts), lo, hi - lo, max(0, hi - max(lo, head))))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), *[pa.int32()] * 5), strict=True)], names=_ITEM)

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, part int, n_parts int, first_token int, tokens int, loss_tokens int")


_ITEM = ["doc_id", "part", "n_parts", "first_token", "tokens", "loss_tokens"]


def pack(sizes: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """Container number of each item (rows of ``sizes``; every item fits an empty container)."""
    rel = sizes / capacity
    where = np.full(len(sizes), -1)
    if not len(sizes):
        return where
    # how much of all containers' room a dimension needs
    weight = rel.sum(0) / max(rel.sum(), 1e-9)
    order = np.argsort(-(rel * weight).sum(1), kind="stable")
    rest, n = rel[order], 0
    left = np.arange(len(order))
    while len(left):
        free = np.ones(rel.shape[1])
        can, taken = np.arange(len(left)), []
        while len(can):
            # the first of the largest: ties go to the earlier item
            k = can[int(((rest[left[can]] * free) @ weight).argmax())]
            taken.append(k)
            free = free - rest[left[k]]
            can = can[(can != k)]
            can = can[(rest[left[can]] <= free + 1e-9).all(1)]
        where[order[left[taken]]] = n
        n += 1
        left = np.delete(left, taken)
    return where


def _pack_blocks(items: DataFrame, block: str, capacity: tuple[int, int, int], tag: str) -> DataFrame:
    """items + container: string id unique over blocks."""
    cap = np.array(capacity, float)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "part"], kind="stable")
        sizes = np.column_stack([pdf["tokens"], np.ones(len(pdf)), pdf["loss_tokens"]]).astype(float)
        pdf["container"] = [f"{tag}{key[0]}-{n}" for n in pack(sizes, cap)]
        return pdf[[*_ITEM, "container"]]

    return items.groupBy(block).applyInPandas(run, "doc_id long, part int, n_parts int, first_token int, tokens int, loss_tokens int, container string")


def packed(items: DataFrame, capacity: tuple[int, int, int] = CAPACITY, block: int = BLOCK) -> DataFrame:
    """(doc_id, part, n_parts, first_token, tokens, loss_tokens, container) with no container above any limit.

    Items are spread over blocks by a hash of their id; the number of blocks follows the number of items, so blocks
    stay of one size.  Items of no tokens take a segment.  Repeated rows are items of their own.  No items, no rows.
    """
    items = cut(items)
    n = items.count()
    blocks = max(1, n // block)
    first = cut(_pack_blocks(items.withColumn("b", F.pmod(F.xxhash64("doc_id", "part"), F.lit(blocks))), "b", capacity, "a"))
    fill = first.groupBy("container").agg(F.sum("tokens").alias("t")).filter(F.col("t") < F.lit(REFILL_BELOW * capacity[0])).select("container")
    loose = first.join(fill, "container", "left_semi").drop("container")
    loose = cut(loose)
    again = max(1, loose.count() // block)
    second = _pack_blocks(loose.withColumn("b", F.pmod(F.xxhash64("part", "doc_id"), F.lit(again))), "b", capacity, "b")
    return first.join(fill, "container", "left_anti").select(second.columns).unionByName(second)
