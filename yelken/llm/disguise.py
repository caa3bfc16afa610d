"""Visually identical text with different characters (problem 1): script-aware repair.

A built-in expression finds the values that hold any unusual character; only those go to Python. There each word's
dominant script is determined and look-alikes in mixed-script words are proposed for substitution; a proposal stands
when its result exists in the corpus vocabulary, which is counted over every value. The vocabulary is only ever
joined with the (distinct) proposals, so neither side is collected or broadcast beyond Spark's own size check.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yelken.llm.plain import INVISIBLE, LOOKALIKES, ODD_SPACES, TURKISH, composed, lower_tr
from yelken.session import stored, table

FIELDS = ("title", "content", "location_text")
_PLAIN_CHARS = "\\x{00}-\\x{7F}çğıöşüâîûÇĞİÖŞÜÂÎÛ‘’‚“”„‹›«»–—‒―−·•…€₺£°§©®™"
_WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯ" + INVISIBLE + r"]+[^\W\d_]+)*")
_JOINER = "‍"
_LOOK = {ord(k): v for k, v in LOOKALIKES.items()}
_TURKISH = set(TURKISH)
_ORDINARY_COMPAT = set("…™®©")


def unusual(value: Column) -> Column:
    """True where ``value`` holds a character that needs a closer look (emoji included); built-in, no Python."""
    return value.rlike(f"[^{_PLAIN_CHARS}]")


def _emoji(char: str) -> bool:
    return unicodedata.category(char) in ("So", "Sk") or ord(char) in (0xFE0F, 0x20E3) or 0x1F000 <= ord(char) < 0x20000


def script_of(word: str) -> str:
    """Dominant script of a word: letters with a Turkish look-alike count for either side, so other letters decide;
    without any, one ordinary Latin letter makes it latin."""
    latin = sum(c in _TURKISH for c in word)
    foreign = sum(c not in _TURKISH and c not in LOOKALIKES and c.isalpha() for c in word)
    return "latin" if latin and latin >= foreign else "other"


def mixed(word: str) -> str | None:
    """The word with its look-alikes replaced, if it is a Latin word that holds some; else None."""
    if any(c in LOOKALIKES for c in word) and script_of(word) == "latin":
        return word.translate(_LOOK)
    return None


def settled(text: str) -> tuple[str, bool]:
    """(text with every form but look-alikes made ordinary, whether anything was wrong). Emoji keep their joiners."""
    out, wrong, n = [], False, len(text)
    for i, c in enumerate(text):
        if c < "\x7f":
            out.append(c)
        elif c == _JOINER and 0 < i < n - 1 and _emoji(text[i - 1]) and _emoji(text[i + 1]):
            out.append(c)
        elif c in INVISIBLE:
            wrong = True
        elif c in ODD_SPACES:
            out.append(" ")
            wrong = True
        elif unicodedata.combining(c) and out and out[-1].isalpha():
            wrong = True
            if c == "̇" and out[-1] in "iIİ":
                out[-1] = "i" if out[-1] == "i" else "İ"
            else:
                out.append(c)
        elif c not in _ORDINARY_COMPAT and unicodedata.decomposition(c).startswith("<"):
            out.append(unicodedata.normalize("NFKC", c))
            wrong = True
        else:
            out.append(c)
    made = unicodedata.normalize("NFC", "".join(out))
    return made, wrong


def _examine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        made, wrong, words = [], [], []
        for text in pdf["__value"]:
            t, w = settled(text)
            made.append(t)
            wrong.append(w)
            words.append(sorted({x for x in _WORD.findall(t) if mixed(x)}))
        yield pdf.drop(columns="__value").assign(__made=made, __wrong=wrong, __words=words)


def skeleton(word: Column) -> Column:
    """Lower case with dotted and dotless i as one: what a look-alike of i may stand for."""
    return F.translate(F.lower(F.translate(word, "Iİ", "ıi")), "ı", "i")


def _vocabulary(values: DataFrame) -> DataFrame:
    """(word, n): lower-case words in ordinary letters of all values with their counts. Map-side combined: the shuffle holds each word once a task."""
    letters = "".join(sorted(set(TURKISH)))
    lowered = F.lower(F.translate("__value", "Iİ", "ıi"))
    return values.select(F.explode(F.split(lowered, f"[^{letters}]+")).alias("word")).where("word != ''").groupBy("word").agg(F.count("*").alias("n"))


_I_LIKE = "ІіΙι"  # look-alikes that may stand for either i


def _substitute(word: str, known: str) -> str:
    """The mixed word with its look-alikes replaced, those of i after the vocabulary's word, in the case they had."""
    out = []
    for c, k in zip(word, known):
        if c in _I_LIKE:
            out.append(("İ" if k == "i" else "I") if c.isupper() else k)
        else:
            out.append(LOOKALIKES.get(c, c))
    return "".join(out)


def _choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"__from": pdf["__from"], "__to": [_substitute(w, k) for w, k in zip(pdf["__from"], pdf["word"])]})


def repair_disguises(df: DataFrame, key: str = "id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per (key, field) of ``df`` whose value is disguised: ``key``, field, repaired, other_forms, n_mixed, n_repaired.

    ``repaired`` has compatibility forms, separate accents, invisible characters and odd spaces made ordinary, and
    look-alike letters replaced in mixed-script words whose result is in the vocabulary of all values (case ignored; where a look-alike may stand
    for dotted or dotless i, the more frequent word decides);
    other_forms tells whether it held any but look-alikes, n_mixed counts the mixed-script words, n_repaired those replaced. NULL and empty values, values that are ordinary, and
    NULL keys give no row; of several deliveries of one key the smallest repaired value stands. Columns other than key and fields are ignored.
    """
    # the key goes under a name of our own: a column called 'field' or 'repaired' may exist
    values = df.select(F.col(key).alias("__key"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in fields])).alias("__x")).select(
        "__key", F.col("__x.field").alias("field"), F.col("__x.v").alias("__value")
    )
    values = values.where(F.col("__value").isNotNull() & F.col("__key").isNotNull())
    suspects = values.where(unusual(F.col("__value")))
    looked = suspects.mapInPandas(_examine, suspects.drop("__value").schema.simpleString()[7:-1] + ", __made string, __wrong boolean, __words array<string>").where(
        "__wrong or size(__words) > 0"
    )
    looked = stored(looked, "looked")  # the suspects' texts are examined once
    proposals = looked.select(F.explode("__words").alias("__from")).distinct()
    proposals = proposals.withColumn("__to", F.translate("__from", "".join(LOOKALIKES), "".join(LOOKALIKES.values()))).withColumn("__s", skeleton(F.col("__to")))
    # letters that are no look-alike of i must be the vocabulary word's: they are compared with every other letter in its place
    fixed = lambda of: F.transform(F.split("__from", ""), lambda c, i: F.when(c.isin(*_I_LIKE), "i").otherwise(F.substr(of, i + 1, F.lit(1))))
    low = F.lower(F.translate("__to", "Iİ", "ıi"))
    met = proposals.join(_vocabulary(values).withColumn("__s", skeleton(F.col("word"))), "__s").where((F.length("word") == F.length("__from")) & (F.array_join(fixed(low), "") == F.array_join(fixed(F.col("word")), "")))
    known = met.groupBy("__from").agg(F.max_by("word", F.struct("n", "word")).alias("word")).mapInPandas(_choose, "__from string, __to string")
    flat = looked.select("__key", "field", "__made", "__wrong", F.explode_outer("__words").alias("__from")).join(known, "__from", "left")
    swaps = F.collect_list(F.when(F.col("__to").isNotNull(), F.struct("__from", "__to")))
    per_row = flat.groupBy("__key", "field", "__made", "__wrong").agg(F.count("__from").cast("int").alias("n_mixed"), F.count("__to").cast("int").alias("n_repaired"), F.array_sort(swaps).alias("__swaps"))
    swap = F.aggregate("__swaps", F.col("__made"), lambda text, s: F.regexp_replace(text, F.concat(F.lit(r"(?<!\p{L})"), s["__from"], F.lit(r"(?!\p{L})")), s["__to"]))
    done = per_row.withColumnRenamed("__wrong", "other_forms").withColumn("repaired", F.when(F.size("__swaps") > 0, swap).otherwise(F.col("__made")))
    return done.groupBy(F.col("__key").alias(key), "field").agg(*[F.min_by(c, "repaired").alias(c) for c in ("repaired", "other_forms", "n_mixed", "n_repaired")])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, field) of every value of news that the repair brings to another form. A mixed-script word counts where the vocabulary has what it
    stands for; one it lacks is left as it is, and a value with nothing else is no row here (see repair_disguises: n_mixed > n_repaired)."""
    judged = repair_disguises(table(spark, sf_dir, "news"))
    return judged.where(F.col("other_forms") | (F.col("n_repaired") > 0)).select("id", "field")
