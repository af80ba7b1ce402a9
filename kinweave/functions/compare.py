"""Name comparators: a registry of scores, their direction, defaults and discretisation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = bytearray(len(b))
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = 1
                left.append(x)
                break
    if not left:
        return 0.0
    right = [y for j, y in enumerate(b) if used[j]]
    m = len(left)
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def _jaro_winkler(a: str, b: str, p: float = 0.1) -> float:
    """No minimum similarity for the prefix bonus."""
    base = _jaro(a, b)
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return base + same * p * (1 - base)


def _restricted_damerau(a: str, b: str) -> int:
    """Optimal string alignment: a swapped pair is not edited again."""
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return row[-1]


def _pandas(fn: Callable, kind: str) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(kind)
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else fn(x, y) for x, y in zip(a, b, strict=True)])

    return udf


def within_edits(a: Column, b: Column, most: int) -> Column:
    """At most so many edits apart; the distance is worked out no further than that."""
    return F.levenshtein(a, b, most) >= 0


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


_encoder: Callable[[str], set[str]] | None = None


def use_phonetic_encoder(encode: Callable[[str], set[str]]) -> None:
    """Plug in a phonetic encoder (word to set of codes) for the method ``bm``."""
    global _encoder
    _encoder = encode


def phonetic_similarity(a: Column, b: Column) -> Column:
    """Jaccard of the words' phonetic codes; 0 where one side has none."""
    if _encoder is None:
        raise RuntimeError("the phonetic method needs an encoder: call use_phonetic_encoder() first")
    encode = _encoder

    def score(x: str, y: str) -> float:
        cx, cy = ({c for w in s.split() for c in encode(w)} for s in (x, y))
        return len(cx & cy) / len(cx | cy) if cx and cy else 0.0

    return _pandas(score, "double")(a, b)


@dataclass(frozen=True)
class Method:
    score: Callable[[Column, Column], Column]
    higher: bool
    threshold: float
    #: a distance: turned to a similarity by the longer name
    distance: bool


METHODS = {
    "jwd": Method(lambda a, b: _pandas(_jaro_winkler, "double")(a, b), True, 0.85, False),
    "ld": Method(lambda a, b: F.levenshtein(a, b).cast("double"), False, 3, True),
    "dld": Method(lambda a, b: _pandas(_restricted_damerau, "int")(a, b).cast("double"), False, 3, True),
    "nld": Method(levenshtein_similarity, True, 0.85, False),
    "bm": Method(phonetic_similarity, True, 0.5, False),
}


def passes(score: Column, method: str, threshold: float | None = None) -> Column:
    m = METHODS[method]
    t = m.threshold if threshold is None else threshold
    return score >= t if m.higher else score <= t


def similarity(score: Column, a: Column, b: Column, method: str) -> Column:
    if not METHODS[method].distance:
        return score
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - score / longest))


def level(sim: Column, n: int) -> Column:
    return F.least(F.floor(sim * n).cast("int"), F.lit(n - 1))
