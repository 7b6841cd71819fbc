"""Porter's stemmer (1980) and tokens with folded case and diacritics."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

_VOWELS = "aeiou"
# The suffix tables of the published algorithm.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in _VOWELS or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if not 3 <= len(word.encode()) <= 64:
        return word
    w = word if word.isascii() else word.encode().decode("latin-1")  # bytes count as letters
    if len(w) > 3 and (w.endswith("sses") or w.endswith("ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed") and len(w) > 3:
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        end = max((e for e in table if w.endswith(e)), key=len, default=None)
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    end = max((e for e in STEP4 if w.endswith(e)), key=len, default=None)
    if end:
        rest = w[: -len(end)]
        if _measure(rest) > 1 and (end != "ion" or rest[-1] in "st"):
            w = rest
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w if word.isascii() else w.encode("latin-1").decode(errors="ignore")


def fold(word: str) -> str:
    """Lower case without diacritics; ligatures and fractions stay."""
    if word.isascii():
        return word.lower()
    split = unicodedata.normalize("NFD", word.lower())
    return unicodedata.normalize("NFC", "".join(c for c in split if not "\u0300" <= c <= "\u036f"))


_TOKEN = re.compile("(?:[^\\W_][\u0300-\u036f]*)+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, folded."""
    return [fold(w) for w in _TOKEN.findall(text or "")]


def tokens(text: str | None, stemmed: bool = True) -> list[str]:
    found = words(text)
    return [stem(t) for t in found] if stemmed else found
