"""Folding of typed names to a plain, sound-oriented key; all expressions stay in the JVM."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinweave.llm.text_forms import LOOKALIKES

# Cyrillic letters and their Latin spelling.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "ђ": "đ", "е": "e", "ж": "ž", "з": "z", "и": "i", "ј": "j", "к": "k", "л": "l",
    "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "ћ": "ć", "у": "u", "ф": "f", "х": "h", "ц": "c", "ч": "č", "ш": "š",
}
CYRILLIC_TWO = {"љ": "lj", "њ": "nj", "џ": "dž"}

# Spellings of one sound in neighbouring orthographies, longest first.
SOUNDS = [
    ("tszh", "c"), ("tsch", "c"), ("sch", "s"), ("dzh", "dz"), ("sh", "s"), ("zh", "z"), ("ch", "c"), ("ck", "k"), ("cs", "c"), ("cz", "c"),
    ("tz", "c"), ("sz", "s"), ("ph", "f"), ("th", "t"), ("dj", "d"), ("x", "ks"), ("q", "k"),
]


@cache
def _plain() -> tuple[str, str]:
    """Letters with marks and compatibility letters, lower case, and the single plain letter each becomes."""
    src, dst = [], []
    for cp in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        c = chr(cp)
        if c in LOOKALIKES or c == "ß":
            continue
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        base = {"đ": "d", "ł": "l", "ø": "o"}.get(base, base)
        if len(base) == 1 and base != c and ord(base) < 128:
            src.append(c)
            dst.append(base)
    return "".join(src), "".join(dst)


def plain(text: Column) -> Column:
    """Lower-case ASCII reading of a text: look-alikes and marks undone, Cyrillic texts transliterated, spaces single.

    Null stays null.
    """
    # most values need lower case and five letters only
    usual = ~text.rlike("[^\\x20-\\x7eČčĆćĐđŠšŽž]|  ")
    return F.when(usual, F.trim(F.translate(F.lower(text), "čćđšž", "ccdsz"))).otherwise(_any_plain(text))


def _any_plain(text: Column) -> Column:
    clean = F.regexp_replace(text, r"[\p{Cf}\p{Mn}]", "")
    low = F.lower(clean)
    cyr = F.translate(low, "".join(CYRILLIC), "".join(CYRILLIC.values()))
    for k, v in CYRILLIC_TWO.items():
        cyr = F.replace(cyr, F.lit(k), F.lit(v))
    looks = {k: v.lower() for k, v in LOOKALIKES.items()}
    lat = F.lower(F.translate(clean, "".join(looks), "".join(looks.values())))
    whole = text.rlike(r"\p{IsCyrillic}") & ~text.rlike(r"[\p{L}&&[^\p{IsCyrillic}]]")
    out = F.when(~text.rlike(r"[^\x00-\x7f]"), F.lower(text)).otherwise(F.when(whole, cyr).otherwise(lat))
    for k, v in {"ǆ": "dž", "ǉ": "lj", "ǌ": "nj", "ǅ": "dž", "ǈ": "lj", "ǋ": "nj", "ﬁ": "fi", "ﬂ": "fl", "ß": "ss"}.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    src, dst = _plain()
    out = F.translate(out, src, dst)
    return F.trim(F.regexp_replace(out, r"[\s\p{Z}]+", " "))


def sound(low: Column) -> Column:
    """One letter per sound of a plain text: w = v, y = j = i, z = c, no doubled letters."""
    for a, b in SOUNDS:
        low = F.replace(low, F.lit(a), F.lit(b))
    low = F.translate(low, "wyjz", "viic")
    return F.regexp_replace(low, r"([a-z])\1+", "$1")
