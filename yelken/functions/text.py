"""Turkish text scalars, Column -> Column; only NFC needs Python (Arrow)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from yelken.lexicon import AGENCIES, NOISE_PARTS

_FORMS = {"begins": "^{}", "ends": "{}$", "is": "^{}$", "holds": "{}", "labels": "^{}"}
#: Lines that are no part of a story: the table's, a clock time before a headline, a date alone.
NOISE_LINE = "|".join(
    [_FORMS[where].format(t.replace(" :", r"\s*:") if where == "labels" else t) for t, where in NOISE_PARTS]
    + [r"^\d{1,2}:\d{2}\s", r"^\d{1,2}[ ./]\S+[ ./]\d{4}(?:\s*-?\s*\d{1,2}[:.]\d{2})?$"]
)
LEAST_WORDS, LEAST_BODY, LEAST_STORY, LEAD_SEEN = 3, 150, 60, 60

@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def normalize_unicode(c: Column) -> Column:
    """NFC, one kind of quotes, dashes and spaces, no zero-width characters. The characters are fixed values."""
    plain = F.translate(nfc(c), "’‘ʼ`´“”„«»–—−   ", "'''''\"\"\"\"\"---   ")
    return F.regexp_replace(plain, "[​-‏⁠﻿]", "")


def turkish_lower(c: Column) -> Column:
    return F.lower(F.translate(c, "Iİ", "ıi"))


def remove_circumflex(c: Column) -> Column:
    return F.translate(c, "âîûÂÎÛ", "aiuAİU")


def for_matching(c: Column) -> Column:
    """Lower case, no circumflex, no apostrophe, one space for anything but Turkish letters and digits. NULL gives ''."""
    low = remove_circumflex(turkish_lower(normalize_unicode(F.coalesce(c, F.lit("")))))
    return F.trim(F.regexp_replace(F.replace(low, F.lit("'"), F.lit("")), "[^0-9a-zçğıöşü]+", " "))


_QUOTES = str.maketrans("’‘ʼ`´\u00a0\u2009\u202f", "'" * 5 + "   ", "\u200b\u200c\u200d\u200e\u200f\u2060\ufeff")
_LOWER = str.maketrans("IİâîûÂÎÛ", "ıiaiuaiu")
_OTHER = re.compile("[^0-9a-zçğıöşü]+")


def matching_text(value: str | None) -> str:
    """``for_matching`` in Python, for passes that need Python anyway: the text then crosses once."""
    if not value:
        return ""
    if not value.isascii():
        value = unicodedata.normalize("NFC", value)
    return _OTHER.sub(" ", value.translate(_QUOTES).translate(_LOWER).lower().translate(_LOWER).replace("'", "")).strip()


def ascii_fold(c: Column) -> Column:
    return F.trim(F.translate(turkish_lower(normalize_unicode(F.coalesce(c, F.lit("")))), "çğıöşüâîû", "cgiosuaiu"))


def allowed_characters(c: Column) -> Column:
    """Letters, digits, blanks and usual punctuation; three or more of the same mark become one."""
    kept = F.regexp_replace(c, r"(?U)[^\w\s.,;:!?'\"()\-/%&+₺]|_", " ")
    return F.regexp_replace(kept, r"([!?.,;:])\1{2,}", "$1")


def one_blank(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[ \t\r\f\u000b]+", " "), "^ | $", "")


def edges_off(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ .:\-!?]+|[ .:\-!?]+$", "")


def title_key(title: Column) -> Column:
    """What a line that only repeats the title is compared with."""
    return edges_off(turkish_lower(normalize_unicode(F.coalesce(title, F.lit("")))))


def noise_line(line: Column, key: Column | None = None) -> Column:
    """True for a cleaned line that is no part of a story: empty, an agency's name, the title again (``key``, see title_key), a known phrase, or of
    fewer than LEAST_WORDS words."""
    low = edges_off(turkish_lower(line))
    short = F.size(F.split(low, r"(?U)\s+")) < LEAST_WORDS
    again = F.lit(False) if key is None else (key != "") & (low == key)
    return (low == "") | low.isin(AGENCIES) | again | low.rlike(NOISE_LINE) | short


def kept_lines(lines: Column, key: Column | None = None) -> Column:
    """ARRAY<STRING> of the cleaned lines of an array that are no noise; of repeats (case ignored) the first stays. The array's text must have gone through
    normalize_unicode. NULL elements count as empty, a NULL array gives NULL."""
    # bound once, as a lambda can't hold what needs Python
    bound = F.array(F.struct(lines.alias("l"), (F.lit("") if key is None else key).alias("k")))
    cleaned = F.transform(bound, lambda b: F.struct(F.transform(b["l"], lambda x: F.trim(one_blank(allowed_characters(F.coalesce(x, F.lit("")))))).alias("l"), b["k"].alias("k")))
    story = F.transform(cleaned, lambda b: F.transform(F.filter(b["l"], lambda x: ~noise_line(x, b["k"])), lambda x: F.struct(turkish_lower(x).alias("k"), x.alias("v"))))
    return F.transform(story, lambda b: F.filter(b, lambda x, i: F.array_position(b["k"], x["k"]) == i + 1)).getItem(0)["v"]


def clean_lines(c: Column, title: Column | None = None) -> Column:
    """Plain text cleaned line by line, joined by LF; a sentence's end before two blanks ends a line too. NULL gives ''."""
    lines = F.split(normalize_unicode(F.coalesce(c, F.lit(""))), r"\n+|(?<=[.!?])\s{2,}")
    return F.array_join(kept_lines(lines, None if title is None else title_key(title)), "\n")


def article_text(title: Column, page_lines: Column, ld_body: Column, summary: Column) -> Column:
    """Text of a story: the structured body where it is long enough, else the longer of it and the page's lines (ARRAY<STRING>, see
    sources.pages.lines_of; it wins ties); the summary comes first unless its beginning stands in the text."""
    of_ld, of_summary = clean_lines(ld_body, title), clean_lines(summary, title)
    joined = normalize_unicode(F.array_join(F.coalesce(page_lines, F.array().cast("array<string>")), "\n"))
    of_page = F.array_join(kept_lines(F.split(joined, "\n"), title_key(title)), "\n")
    body = F.when(F.length(of_ld) >= LEAST_BODY, of_ld).when(F.length(of_page) >= F.length(of_ld), of_page).otherwise(of_ld)
    known = F.contains(turkish_lower(body), F.left(turkish_lower(of_summary), F.lit(LEAD_SEEN)))
    return F.trim(F.when((of_summary == "") | known, body).when(body == "", of_summary).otherwise(F.concat_ws("\n", of_summary, body)))


def clean_title(c: Column, tail_words: str) -> Column:
    """One blank; the last part after ' - ', ' | ' or ' – ' goes if it matches ``tail_words``, the alternatives that name publishers."""
    s = F.trim(F.regexp_replace(c, r"\s+", " "))
    parts = F.split(s, r" [-|–] ")
    cut = (F.size(parts) > 1) & F.element_at(parts, -1).rlike(f"(?iu){tail_words}")
    return F.array_join(F.when(cut, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts), " - ")
