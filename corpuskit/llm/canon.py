"""Character folding shared by the text operators of this subpackage.

``plain`` brings one text into plain form (NFC letters of the script of the word, ordinary spaces, nothing invisible
beside a word) and ``plain_map`` also returns, for every character of the result, its place in the source text.
``skeleton`` goes further for comparing: no case, punctuation, emoji, tags, links or forward marks.
Null gives an empty string; no text is shortened.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import regex

# Letters that look like a Latin letter (Greek, Cyrillic, IPA), with that letter.
LOOKALIKES = {
    "ɑ": "a", "ɡ": "g", "ɩ": "i", "ı": "i",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W",
}

# Of these the likeness is loose, so that a word of one script with one of them is not Latin in disguise.
LOOSE = "вкмнт"

# Ligatures of Latin letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}

# A vowel letter and sign that together look like another vowel letter (Devanagari).
VOWELS = {"अा": "आ", "अॅ": "ॲ", "अॉ": "ऑ", "अो": "ओ", "अौ": "औ", "आे": "ओ", "आै": "औ", "एे": "ऐ", "एॅ": "ऍ", "उु": "ऊ"}

# Spaces that look like U+0020, and characters without a shape of their own.
SPACES = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f\u3164\ufeff\uffa0\ufdd0\ufdd1"

_WIDE = {i: i - 0xFEE0 for i in range(0xFF01, 0xFF5F)}
_ONE = _WIDE | dict.fromkeys(map(ord, SPACES), 0x20)
_LOOK = str.maketrans(LOOKALIKES)
_GONE = set(INVISIBLE)
_SUSPECT = regex.compile("[" + "".join(LIGATURES) + SPACES + INVISIBLE + "\u200d\ufe00-\ufe0f\uff01-\uff5e\u0958-\u095f" + "".join(LOOKALIKES) + "]|[अआएउ]\\p{M}")
_SPECIAL = regex.compile("[" + "".join(LIGATURES) + INVISIBLE + "\u200d\ufe00-\ufe0f]")
_SPLIT = regex.compile(r"[अआएउ]\p{M}")
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
_KEEP = regex.compile(r"[\p{So}\p{Sk}\ufe0f\U0001f3fb-\U0001f3ff]")
_LATIN = regex.compile(r"^[\p{Latin}\p{M}" + "".join(LOOKALIKES) + "]+$")
_FOREIGN = regex.compile("[" + "".join(LOOKALIKES) + "]")
_OWN = regex.compile(r"\p{Latin}")
_ELSE = regex.compile(r"[\p{Cyrillic}\p{Greek}--[" + "".join(LOOKALIKES) + "]]", regex.V1)


def disguised(word: str, text: str) -> bool:
    """Whether a word with look-alikes is a Latin one: all its letters are Latin or look-alikes, and it has a Latin one;
    or else only close look-alikes, in a text without any other letter of their scripts."""
    return bool(_LATIN.match(word)) and bool(_OWN.search(word) or not any(c in LOOSE for c in word) and not _ELSE.search(text))


def plain_map(text: str) -> tuple[str, list[int] | None]:
    """The plain form and the source place of each of its characters (None: places are unchanged)."""
    if text.isascii() or (not _SUSPECT.search(text) and unicodedata.is_normalized("NFC", text)):
        return text, None
    kept: list[str] = []
    at: list[int] = []
    n, end = len(text), 0
    for m in _SPECIAL.finditer(text):
        i, ch = m.start(), m.group()
        kept += text[end:i].translate(_ONE)
        at += range(end, i)
        end = i + 1
        if ch in _GONE:
            continue
        if ch == "\u200d":
            if not (i and i + 1 < n and _KEEP.match(text[i - 1]) and _KEEP.match(text[i + 1])):
                continue
        elif ch not in LIGATURES and not (i and _KEEP.match(text[i - 1])):
            continue
        for x in LIGATURES.get(ch, ch):
            kept.append(x)
            at.append(i)
    kept += text[end:].translate(_ONE)
    at += range(end, n)
    whole = "".join(kept)
    if _FOREIGN.search(whole):
        for m in _WORD.finditer(whole):
            w = m.group()
            if _FOREIGN.search(w) and disguised(w, text):
                kept[m.start() : m.end()] = w.translate(_LOOK)
        whole = "".join(kept)
    if unicodedata.is_normalized("NFC", whole) and not _SPLIT.search(whole):
        return whole, at
    out, places, i, n = [], [], 0, len(kept)
    while i < n:  # by base letter with its marks, so that places survive composition
        j = i + 1
        while j < n and unicodedata.category(kept[j])[0] == "M":
            j += 1
        s = unicodedata.normalize("NFC", "".join(kept[i:j]))
        if j > i + 1 and s[:2] in VOWELS:
            s = VOWELS[s[:2]] + s[2:]
        for k, ch in enumerate(s):
            out.append(ch)
            places.append(at[min(i + k, j - 1)])
        i = j
    return "".join(out), places


def plain(text: str | None) -> str:
    return plain_map(text)[0] if text else ""


_NOISE = regex.compile(r"(?:https?://|www\.)\S+|[#@][\p{L}\p{M}\p{N}_]+")
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_FORWARD = regex.compile(r"^\W*(?:(?:fwd|fw|rt|forwarded)\b[\W_]*)+", regex.I)


def skeleton(text: str | None) -> list[str]:
    """The words of a text for comparing: plain, lower case, without tags, links, emoji, punctuation or forward marks."""
    if not text:
        return []
    t = _NOISE.sub(" ", plain(text).lower())
    return _TOKEN.findall(_FORWARD.sub("", t))


# Digits and signs written for a Latin letter.
LEET = str.maketrans({"4": "a", "@": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"})
_RUN = regex.compile(r"(\X)\1+")
_LEETY = regex.compile(r"^[A-Za-z]*(?:[A-Za-z][4@31!0$57]+|[4@31!0$57]+[A-Za-z])[A-Za-z4@31!0$57]*$")
_EDGE = regex.compile(r"^[^\p{L}\p{M}\p{N}$@]+|[^\p{L}\p{M}\p{N}]+$")
_INNER = regex.compile(r"(?<=[\p{L}\p{M}\p{N}$])[._*\-~·•]+(?=[\p{L}\p{M}\p{N}$])")


@lru_cache(maxsize=400_000)
def spelt(token: str) -> str:
    """A white-space token as it is meant: plain, lower case, signs inside it removed, digits for letters read as
    letters. Empty for links, tags, handles and what has no letters."""
    t = plain(token)
    if t[:1] in "#@" or "://" in t:
        return ""
    t = _EDGE.sub("", t)
    u = _INNER.sub("", t)
    if _LEETY.match(u):
        u = u.translate(LEET)
    u = u.lower()
    if not _LETTER.search(u) or regex.search(r"\d", u):
        return ""
    return "".join(_WORD.findall(u))


@lru_cache(maxsize=400_000)
def spoken(token: str) -> str:
    """``spelt``, with repeated letters written once."""
    return _RUN.sub(r"\1", spelt(token))
