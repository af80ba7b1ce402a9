"""One frame of person records over the registries, with plain and sound-folded attributes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.places import AFTER, BEFORE
from kinweave.llm.spell import CYRILLIC, CYRILLIC_TWO, SOUNDS, _plain
from kinweave.llm.text_forms import LOOKALIKES
from kinweave.plans.runtime import table

# Titles and words in names that are no part of them (sound-folded), and marks of missing values.
NOT_NAMES = ["dr", "prof", "ing", "inc", "mr", "mag", "gda", "gdia", "gosp", "rod", "ud", "geb", "ne", "mladi", "stariii", "ml", "st", "nn"]
NOT_NAMES_SHORT = ["dr.", "prof.", "ing.", "inc.", "mr.", "mag.", "g.", "gosp.", "rod.", "ud.", "geb.", "ml.", "st."]
MISSING = ["", "-", "*", "9999", "?"]

#: Numbers of the tables in record ids.
TABLES = ["export_xlsx", "export_xlsx_partial", "match_entries"]

# Raw columns of each table in the order of ``_RAW``; None where a table has none.
_RAW = ["given", "family", "born", "place", "father", "dyear", "dplace", "camp", "sex"]
_COLUMNS = {
    "export_xlsx": ("row_id", [None, "name_and_surname", "Date of Birth:", "Place of Birth:", "Father Name:", "Year of Death:", "Death Place:", "Camp:", "Sex:"]),
    "export_xlsx_partial": ("IDNumber", ["Name", "Surname", "BirthYear", "Place", "FatherName", "DeathYear", "DeathPlace", None, None]),
    "match_entries": ("row_idx", ["name", "surname", "birth_date", "birth_place", None, None, None, None, None]),
}
#: What makes the stored name of a table.
_STORED = {"export_xlsx": ["name_and_surname"], "export_xlsx_partial": ["Name", "Surname"], "match_entries": ["surname"]}
_FOLDED = "tokens array<string>, given_n int, byear int, byear2 int, bdate int, place string, father string, dyear int, dplace string, sex string, pletters int, fletters int, dletters int"


def people(spark: SparkSession, sf_dir: str, tables: list[str] = TABLES) -> DataFrame:
    """rid, r, nid, tokens, given_n, byear, byear2, bdate, place, father, dyear, dplace, sex, and the letters of place, father and
    dplace as bits.

    One row per delivery.  ``rid`` (four times the key, and the number of the table) is the record, ``r`` a hash of its
    stored name and ``nid`` one of its folded name.  ``given_n`` of the tokens are from a column of given names, -1 where
    names are not split.  ``bdate`` is yyyymmdd.  Records without a key are left out; missing values are null.
    """
    rows = None
    for name in tables:
        key, cols = _COLUMNS[name]
        df = table(spark, sf_dir, name)
        key_col = F.expr(f"try_cast(trim({key}) as bigint)") if key == "IDNumber" else F.col(key)
        stored = F.hash(*[F.coalesce(F.col(c), F.lit("")) for c in _STORED[name]])
        raw = [(F.lit(None).cast("string") if c is None else F.col(f"`{c}`")).alias(n) for n, c in zip(_RAW, cols, strict=True)]
        part = df.select((key_col * 4 + TABLES.index(name)).alias("rid"), stored.alias("r"), *raw).filter("rid is not null")
        rows = part if rows is None else rows.unionAll(part)
    folded = rows.mapInArrow(_fold_batches, f"rid bigint, r int, {_FOLDED}")
    return folded.withColumn("nid", F.xxhash64("tokens"))


# Folding runs over Arrow batches in Python: as one expression tree it is too large for the JVM's compiler and runs
# interpreted, several times slower.  Distinct values are folded once and remembered up to a bound.
_CASE = str.maketrans({k: v.lower() for k, v in LOOKALIKES.items()})
_CYR = str.maketrans(CYRILLIC | CYRILLIC_TWO)
_MARKS = str.maketrans(dict(zip(*_plain(), strict=True)) | {"ǆ": "dz", "ǉ": "lj", "ǌ": "nj", "ß": "ss", "ﬁ": "fi", "ﬂ": "fl"})
_UNSEEN = re.compile("[\u00ad\u034f\u0300-\u036f\u200b-\u200f\u2060-\u2064\ufeff]")
_NOT_CYR = re.compile(r"[^\W\d_\u0400-\u04ff]")
_ANY_CYR = re.compile("[\u0400-\u04ff]")
_KEYS = str.maketrans("wyjz", "viic")
_TWICE = re.compile(r"([a-z])\1+")
_WORDS = re.compile(r"[a-z]+\.?")
_DOUBLE = re.compile(r"-(?=[A-ZČĆĐŠŽ])")
_BRACKETS = re.compile(r"\(.*?\)")
_BARE = re.compile("[A-ZČĆĐŠŽ][a-zčćđšž]+(?: [A-ZČĆĐŠŽ][a-zčćđšž]+)?")
_BEFORE, _AFTER = re.compile(BEFORE), re.compile(AFTER)
_GONE = str.maketrans("", "", " -'/()?*0123456789")
_SKIP = {*NOT_NAMES, *NOT_NAMES_SHORT}
_DATE = re.compile(r"\s*(?:(\d{4})(?:-(\d\d)-(\d\d))?|(\d\d?)\.\s?(\d\d?)\.\s?(\d{4}))(?:\s*\[(\d{4})\])?")
_NONE = {*MISSING}
#: What keeps the words of a name from being folded one by one: brackets, hyphens, and letters that are read by their whole text.
_WHOLE = re.compile("[(\\-\u0250-\U0010ffff]")
#: Values of a column that a worker remembers.
REMEMBERED = 40_000


def _low(s: str) -> str:
    if not s.isascii():
        s = _UNSEEN.sub("", s)
        if _ANY_CYR.search(s) and not _NOT_CYR.search(s):
            s = s.lower().translate(_CYR)
        else:
            s = s.translate(_CASE).lower()
        s = s.translate(_MARKS)
    return " ".join(s.lower().split())


def _key(low: str) -> str:
    for a, b in SOUNDS:
        if a in low:
            low = low.replace(a, b)
    return _TWICE.sub(r"\1", low.translate(_KEYS))


def _tokens(s: str) -> list[str]:
    """Words of a name in sound folding; a final full stop stays as the mark of an abbreviation.

    Bracketed words (a father's name) are left out, double names become two words.  "Surname, Given" needs no special
    order: names are compared free of order.
    """
    if not _WHOLE.search(s):
        return list(dict.fromkeys([w for x in s.split() for w in _WORD[x]]))
    return _any_tokens(s)


def _any_tokens(s: str) -> list[str]:
    if "-" in s:
        s = _DOUBLE.sub(" ", s)
    low = _low(s)
    if "(" in low:
        low = _BRACKETS.sub(" ", low)
    return list(dict.fromkeys(_WORDS.findall(_key(low.replace("'", "").replace("-", "")))))


def _untitled(words: list[str]) -> list[str]:
    """Without titles, if a given name and a surname can be left."""
    kept = [w for w in words if w not in _SKIP]
    return kept if len(kept) > 1 else words


def _place(s: str) -> str | None:
    s = s.partition(",")[0]
    low = _low(s)
    if not _BARE.fullmatch(s):
        low = re.sub(r"[^a-z. ]", "", _AFTER.sub("", _AFTER.sub("", _BEFORE.sub("", low)))).strip()
    low = low.translate(_GONE)
    return _key(low) if len(low) > 2 else None


def _father(s: str) -> str | None:
    return _key(_low(s).translate(_GONE)) or None


def _year(s: str | None) -> int | None:
    return int(s) if s and 1800 <= int(s) <= 1999 else None


def _born(s: str) -> tuple[int | None, int | None, int | None]:
    """Year, second year in brackets, full date as a number."""
    m = _DATE.match(s)
    if not m:
        return None, None, None
    y, month, day, d2, m2, y2, other = m.groups()
    year = _year(y or y2)
    full = None
    if year and (month or y2):
        full = int(y) * 10000 + int(month) * 100 + int(day) if y else int(y2) * 10000 + int(m2) * 100 + int(d2)
    return year, _year(other), full


def _letters(s: str) -> int:
    """Bits of the letters of a folded word."""
    out = 0
    for c in s:
        if "a" <= c <= "z":
            out |= 1 << (ord(c) - 97)
    return out


class _Memory(dict):
    """Folded values; missing and null give ``nothing``."""

    def __init__(self, fold: Callable, nothing: object = None):
        super().__init__()
        self.fold, self.nothing = fold, nothing

    def __missing__(self, v: str | None):
        out = self.nothing if v is None or v.strip() in _NONE else self.fold(v)
        if len(self) < REMEMBERED:
            self[v] = out
        return out


_WORD = _Memory(lambda x: _WORDS.findall(_key(_low(x).replace("'", "").replace("-", ""))), [])


def folded_words(df: DataFrame) -> DataFrame:
    """A frame of text columns, sound-folded; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([None if v is None else _key(_low(v)) for v in col.to_pylist()], pa.string()) for col in batch.columns], names=batch.schema.names)

    return df.mapInArrow(run, ", ".join(f"{c} string" for c in df.columns))


def _once(col: pa.Array, *folds: tuple[Callable, pa.DataType]) -> list[pa.Array]:
    """A column under each of the functions, which see each of its values once; null becomes null."""
    held = col.dictionary_encode()
    values = held.dictionary.to_pylist()
    return [pa.array([f(v) for v in values], t).take(held.indices) for f, t in folds]


def _fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, place, father, born = _Memory(_tokens, []), _Memory(_place), _Memory(_father), _Memory(_born, (None, None, None))
    died = _Memory(lambda s: _born(s)[0])
    letters = _Memory(_letters)
    sex = _Memory(lambda s: s.strip().upper())
    text, number = pa.string(), pa.int32()
    part = lambda k: (lambda v: born[v][k], number)
    told = lambda f: ((f.__getitem__, text), (lambda v: letters[f[v]], number))
    for batch in batches:
        col = {n: batch.column(i + 2) for i, n in enumerate(_RAW)}
        tokens, given_n = [], []
        for g, f in zip(col["given"].to_pylist(), col["family"].to_pylist(), strict=True):
            if g is None:
                tokens.append(_untitled(words[f]))
                given_n.append(-1)
            else:
                first, rest = words[g], words[f]
                both = _untitled([*first, *(w for w in rest if w not in first)])
                tokens.append(both)
                given_n.append(sum(w in first for w in both))
        (where, at), (fathers, named), (died_at, ended), (camps, kept) = (_once(col[n], *told(f)) for n, f in (("place", place), ("father", father), ("dplace", place), ("camp", place)))
        made = [pa.array(tokens, pa.list_(text)), pa.array(given_n, number), *_once(col["born"], part(0), part(1), part(2)), where, fathers]
        made += [*_once(col["dyear"], (died.__getitem__, number)), pc.coalesce(died_at, camps), *_once(col["sex"], (sex.__getitem__, text))]
        made += [at, named, pc.if_else(died_at.is_valid(), ended, kept)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["rid", "r", *[f.split()[0] for f in _FOLDED.split(", ")]])
