"""Plain forms of disguised text, shared by the operators of this subpackage. Pure Python, run inside Arrow batches."""

from __future__ import annotations

import re
import unicodedata

# Letters of other alphabets (and foreign Latin letters) and the Turkish letter each looks like.
LOOKALIKES = dict(
    zip(
        "АВЕЗКМНОРСТУХЅІЈаеосрухѕіјһ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαεοινρυκ" "ȘșȚțɑɡΚᴏꜱ",
        "ABE3KMHOPCTYXSIJaeocpyxsijh" "ABEZHIKMNOPTYXaeoivpuk" "ŞşTtagKos",
        strict=True,
    )
)
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏  ‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
ODD_SPACES = "               　"
TURKISH = "abcçdefgğhıijklmnoöprsştuüvyzABCÇDEFGĞHIİJKLMNOÖPRSŞTUÜVYZâîûÂÎÛqwxQWX"

_DROP = {ord(c): None for c in INVISIBLE}
_LOOK = {ord(k): v for k, v in LOOKALIKES.items()}
_LATIN = set(TURKISH)
_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile("[" + "".join(LOOKALIKES) + "]")
_DOT = re.compile("([iIİ])̇")
_ODD = re.compile("[^\x00-\x7fçğıöşüâîûÇĞİÖŞÜÂÎÛ‘’“”–—…•·©®™€₺°]")
_ACCENTS = tuple(zip("çğıöşüâîû", "cgiosuaiu"))



def composed(text: str) -> str:
    """Compatibility forms and separate accents resolved, invisible characters dropped, odd spaces plain; foreign letters stay.
    Emoji lose their joiners here: for comparing, not for output."""
    if text.isascii() or not _ODD.search(text):
        return text
    if "̇" in text:
        text = _DOT.sub(lambda m: "i" if m[1] == "i" else "İ", text)
    return unicodedata.normalize("NFKC", text.translate(_DROP))


def _straight(match: re.Match) -> str:
    word = match[0]
    return word.translate(_LOOK) if not word.isascii() and _MIXED.search(word) and any(c in _LATIN for c in word) else word


def plain(text: str) -> str:
    """``composed`` with look-alike letters replaced in words that also hold Latin letters."""
    text = composed(text)
    return _WORD.sub(_straight, text) if not text.isascii() and _MIXED.search(text) else text


def lower_tr(text: str) -> str:
    """Turkish lower case."""
    return text.replace("I", "ı").replace("İ", "i").lower()


def folded(text: str) -> str:
    """Plain, lower case, without accents: only for comparing (ı = i)."""
    text = plain(text)
    if text.isascii():
        return text.lower()
    text = text.replace("İ", "i").lower()
    for accented, bare in _ACCENTS:
        text = text.replace(accented, bare)
    return text
