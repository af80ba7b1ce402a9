"""Personal data in free text, found through an offset-preserving normaliser (problem 9).

A transducer reads the text once and rewrites markup and disguises (accents as macros, ties, "(at)", "dot", spelled
digits, full-width and look-alike characters) to plain characters, keeping for every rewritten piece where it came
from.  Detectors run over the normalised text; their spans are mapped back to source positions.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

from kinweave.llm.text_forms import LOOKALIKES

# Accent macros, letters spelled as macros, and digit words.
ACCENTS = {'"': "\u0308", "'": "\u0301", "`": "\u0300", "^": "\u0302", "~": "\u0303", "=": "\u0304", ".": "\u0307", "v": "\u030c", "u": "\u0306", "c": "\u0327", "H": "\u030b", "k": "\u0328", "r": "\u030a"}
LETTERS = {"ss": "ß", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "ae": "æ", "AE": "Æ", "oe": "œ", "aa": "å", "AA": "Å", "i": "i", "j": "j", "dj": "đ", "DJ": "Đ"}
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_DIGIT = "|".join(DIGITS)
_BASE = (
    rf"""(?P<accent>\\["'`^~=.](?:\{{\\?([A-Za-z])\}}|([A-Za-z]))|\\[vucHkr]\{{\\?([A-Za-z])\}})"""
    r"""|(?P<letter>\\(ss|ae|AE|oe|aa|AA|dj|DJ|[oOlLij])(?:\{\}| |(?![A-Za-z])))"""
    r"""|(?P<none>\\allowbreak ?|\\-|\\/|[\u00ad\u200b-\u200f\u2060\ufeff])"""
    r"""|(?P<space>~|\\[,;: ]|[\u00a0\u2000-\u200a\u202f\u3000])"""
    r"""|(?P<at>[(\[{]\s*(?:at|@)\s*[)\]}])"""
    r"""|(?P<dot>[(\[{]\s*dot\s*[)\]}])"""
    r"""|(?P<escaped>\\[_@&%#$])"""
    r"""|(?P<other>[\uff01-\uff5e\u0370-\u052f\u0531-\u0587])"""
)
#: The usual pieces, and the same with those that begin like any word and are only looked for where they can occur.
_PIECES = re.compile(_BASE)
_ALL_PIECES = re.compile(rf"{_BASE}|(?P<word_dot> (?:dot|DOT) )|(?P<digits>\b(?:{_DIGIT})(?:[ -](?:{_DIGIT}))+\b)")
_AROUND = re.compile(r"(?:\s|\\,)+")


class Reading:
    """A normalised text and the way back to source positions."""

    __slots__ = ("text", "_at", "_from", "_kept")

    def __init__(self, source: str):
        out: list[str] = []
        self._at: list[int] = [0]
        self._from: list[int] = [0]
        self._kept: list[bool] = [True]
        pos = size = 0
        rare = " dot " in source or " DOT " in source or sum(f" {w}" in source for w in DIGITS) > 1
        for m in (_ALL_PIECES if rare else _PIECES).finditer(source):
            kind = m.lastgroup
            begin, stop = m.span()
            if kind in ("at", "dot"):  # space around the sign belongs to the disguise
                while begin > pos and (source[begin - 1].isspace() or source.startswith("\\,", begin - 2) or source[begin - 1] == "~"):
                    begin -= 2 if source.startswith("\\,", begin - 2) else 1
                if wide := _AROUND.match(source, stop):
                    stop = wide.end()
                if begin < pos or stop > len(source):
                    continue
            if begin < pos:
                continue
            piece = m.group()
            if kind == "accent":
                letter = m.group(2) or m.group(3) or m.group(4)
                new = unicodedata.normalize("NFC", letter + ACCENTS[piece[1]])
            elif kind == "letter":
                new = LETTERS[m.group(6)]
            elif kind == "none":
                new = ""
            elif kind == "space":
                new = " "
            elif kind == "at":
                new = "@"
            elif kind in ("dot", "word_dot"):
                new = "."
            elif kind == "escaped":
                new = piece[1]
            elif kind == "digits":
                new = "".join(DIGITS[w] for w in re.split("[ -]", piece))
            else:
                new = unicodedata.normalize("NFKC", piece)
                new = LOOKALIKES.get(new, new)
            if kind in ("at", "dot") and out and not out[-1].strip() and pos == begin:
                # a tie just before was read as a space already
                size -= len(out[-1])
                out[-1] = ""
            out.append(source[pos:begin])
            size += begin - pos
            self._mark(size, begin, False)
            out.append(new)
            size += len(new)
            pos = stop
            self._mark(size, pos, True)
        out.append(source[pos:])
        self.text = "".join(out)

    def _mark(self, at: int, source: int, kept: bool) -> None:
        self._at.append(at)
        self._from.append(source)
        self._kept.append(kept)

    def start(self, i: int) -> int:
        """Source position of the first character of normalised position i."""
        k = bisect_right(self._at, i) - 1
        return self._from[k] + (i - self._at[k] if self._kept[k] else 0)

    def end(self, i: int) -> int:
        """Source position after the character before normalised position i."""
        k = bisect_right(self._at, i - 1) - 1
        if self._kept[k]:
            return self._from[k] + i - self._at[k]
        return self._from[k + 1]


_BREAK = re.compile(r"[ /](?=[+(\d])")
_NAME = r"[^\W\d_]"
_UP = r"(?:(?![a-zà-öø-ÿ])[^\W\d_])"
_AT = re.compile(r"@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}| at (?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w.]*[a-z]\.)")
_LOCAL = re.compile(r"[A-Za-z0-9][\w.+-]*$")
#: Where a number or an identity mark can begin, and what an address needs.
_NUMBERLIKE = re.compile(r"[+(\d][\d ().\-/]{7,}")
_MARKLIKE = re.compile(r"[A-Z][A-Z] ?\d\d")
_STREETS = ("gasse", "weg", "straße", "strasse", "str.", "platz", "allee", "Allee", "ulica", "ul.", "trg", "Trg", "rue ", "avenue", "boulevard", "quai", "chemin", "cesta",
            "Street", "St.", "Road", "Rd", "Avenue", "Ave", "Lane", "Square", "Close", "Terrace", "Quay", "Drive", "Court", "Place", "Way", "Hill", "Row", "Ln", "Sq.", "No.", "Crescent", "Gardens", "Straße", "Weg", "Gasse")
# The ways telephone numbers are written; separators are spaces, dots, slashes and one or two hyphens.
_S = r"(?:\ |-{1,2}|\.|/)?"
PHONE = re.compile(
    rf"(?<![\w.+/-])(?:(?:\+|00)\d{{1,3}}{_S}(?:\(0\){_S})?(?:\(\d{{1,4}}\){_S})?\d{{1,5}}(?:{_S}\d{{2,8}}){{1,5}}"
    rf"|\(0\d{{2,4}}\)\ ?\d{{3,4}}{_S}\d{{2,4}}|\(\d{{3}}\)\ ?\d{{3}}-\d{{4}}"
    rf"|0[1-9]\d{{2,3}}[ -]\d{{3}}[ -]?\d{{3,4}}|0[1-9](?:[. ]\d\d){{4}}|[2-9]\d\d([.-])\d{{3}}\1\d{{4}})(?![\w/]|[.-]\d)"
)
# Shapes of numbers that identify a person.
ID = re.compile(
    r"(?<![\w./:+-])(?:[A-Z]{2}\ ?\d{2}\ ?\d{2}\ ?\d{2}\ ?[A-D]|[A-Z]{2}\d{7}|9\d\d([ -])\d\d\1\d{4}|\d{6}/\d{3,4}|\d{13}|\d{11})(?![\w/]|[.-]\d)"
)
_W = rf"{_UP}[\w'’-]*"
_NO = r"(?:No\.?\ ?)?\d{1,4}(?:\ ?[A-Za-z](?!\w)|\ bis)?"
_AFTER = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Square|Sq\.?|Close|Terrace|Quay|Drive|Dr\.?|Court|Place|Way|Hill|Crescent|Gardens|Row)"
_ONE = rf"{_UP}[\w'’-]*(?:gasse|weg|straße|strasse|str\.|platz|allee|ring|ufer|damm)"
_TWO = rf"{_W}\ (?:ulica|Allee|Straße|Strasse|Weg|Platz|Gasse|Ring|cesta|trg)"
_RUE = rf"(?:rue|avenue|boulevard|place|quai|chemin|impasse|allée)\ (?:d[eu](?:s|\ la)?\ |d['’]|la\ |le\ )?{_W}(?:\ {_W})?"
_UL = rf"(?:ul\.|ulica|trg|Trg|Ulica)\ {_W}(?:\ {_W})?"
ADDRESS = re.compile(
    rf"(?<![\w-])(?:{_NO},?\ (?:{_W}\ ){{1,2}}{_AFTER}(?!\w)|(?:{_W}\ ){{1,2}}{_AFTER},?\ {_NO}(?!\w)|{_NO},?\ {_RUE}|{_RUE},?\ {_NO}(?!\w)|(?:{_ONE}|{_TWO}|{_UL}),?\ {_NO}(?!\w))"
)
_INIT = rf"{_UP}\."
_PARTICLE = r"(?:(?:van|von|de|der|den|di|da|del|la|le|zu)\ ){0,2}"
_FAM = rf"{_PARTICLE}{_UP}{_NAME}+(?:[-’'](?:{_UP}{_NAME}+))*"
#: Two or more capitalised words or initials in a row; which of them are names is decided by the given names known.
NAMES = re.compile(rf"(?<![\w@.\\-])(?:(?:{_INIT}\ ?){{1,3}}{_FAM}|{_FAM},\ (?:{_INIT}(?:\ ?{_INIT}){{0,2}}|{_UP}{_NAME}+)|{_UP}{_NAME}+(?:-{_UP}{_NAME}+)?(?:\ {_INIT}){{0,2}}(?:\ |\n){_FAM})(?![\w@])")
_BLOCKS = re.compile(r"\\begin\{thebibliography\}.*?(?:\\end\{thebibliography\}|\Z)|\\author(?:\[[^\]]*\])?\{(?:[^{}]|\{[^{}]*\})*\}|\\bibitem.*?(?=\\bibitem|\n\n|\Z)", re.S)


def found_spans(source: str) -> list[tuple[str, int, int, str, str]]:
    """(type, start, end, given, shape) of everything found in a text, in source positions.

    Names carry the word that has to be a known given name (``given``), and how the name is written (``shape``):
    "initials", "reversed" or "plain".  Overlaps are settled in the order email, phone, id_number, address, name.
    """
    read = Reading(source)
    text = read.text
    taken: list[tuple[int, int]] = []
    out: list[tuple[str, int, int, str, str]] = []
    closed = [(m.start(), m.end()) for m in _BLOCKS.finditer(text)]

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y in taken)

    def add(kind: str, a: int, b: int, given: str = "", shape: str = "") -> None:
        taken.append((a, b))
        out.append((kind, read.start(a), read.end(b), given, shape))

    if "@" in text or " at " in text:
        for m in _AT.finditer(text):
            spelled = m.group()[0] == " "
            if spelled and not source.count("dot"):
                continue
            if local := _LOCAL.search(text, max(0, m.start() - 64), m.start()):
                add("email", local.start(), m.end())
    for t in _MARKLIKE.finditer(text):
        m = ID.match(text, t.start())
        if m is not None and free(m.start(), m.end()):
            add("id_number", m.start(), m.end())
    for t in _NUMBERLIKE.finditer(text):
        i = t.start()
        while i < t.end():
            m, kind = ID.match(text, i), "id_number"
            if m is None:
                m, kind = PHONE.match(text, i), "phone"
                if m is not None and not 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    m = None
            if m is not None and free(m.start(), m.end()):
                add(kind, m.start(), m.end())
                i = m.end()
            else:  # the next place a number may begin: after a break
                step = _BREAK.search(text, i + 1, t.end())
                i = step.end() if step else t.end()
    if any(k in text for k in _STREETS):
        for m in ADDRESS.finditer(text):
            if free(m.start(), m.end()):
                add("address", m.start(), m.end())
    pos = 0
    while m := NAMES.search(text, pos):
        a, b = m.span()
        pos = a + 1 if b - a > 1 else b
        inside = next((y for x, y in closed if x <= a < y), None)
        if inside is not None:
            pos = max(inside, pos)
            continue
        if not free(a, b):
            continue
        name = m.group()
        first = re.match(rf"{_UP}{_NAME}+", name)
        if "," in name:
            rest = name.split(",", 1)[1].strip()
            out.append(("name", read.start(a), read.end(b), "" if re.match(_INIT, rest) else rest, "reversed" if not re.match(_INIT, rest) else "reversed initials"))
        elif first is None and re.search(r"[\d$}%]\s?$", text[max(0, a - 3) : a]):
            pos = a + 2  # a unit that ends a sentence
            continue
        elif first is None:
            out.append(("name", read.start(a), read.end(b), "", "initials"))
            pos = b
        else:
            out.append(("name", read.start(a), read.end(b), first.group(), "plain"))
        # the next candidate may begin inside this one; names that overlap are settled by the given name
        step = re.match(rf"(?:{_INIT}\ ?)+|{_UP}[\w'’-]*", text[a:b])
        pos = max(pos, a + (step.end() if step else 1))
    return out
