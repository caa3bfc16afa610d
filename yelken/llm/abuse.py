"""Abusive, hateful or sexual content (problem 10): multiple-instance learning.

A document is a bag of sentences, a sentence a bag of overlapping pieces of some words: an insult set on to a long harmless
sentence without a mark would drown in it. A piece's score is logistic in hashed features of its undisguised words, the sentence's and the
document's scores are noisy-ors; the weights are trained from document labels alone, through the noisy-or, allowing for raters'
errors. Scoring reads each document once and shuffles nothing but the drop of repeated keys and the counts per source.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yelken.llm.plain import folded
from yelken.session import table

TRAIN_DOCS = 12_000  # labelled documents the model is fitted on, at most
RATER_ERROR = 0.1  # share of labels taken to be wrong
DECAY = 1e-4  # pull of each weight towards 0
PIECE_WORDS, PIECE_STEP = 6, 3  # words of a piece of a sentence, and how far the next one is on
THRESHOLD = 0.35  # chosen by precision and recall on labelled documents kept out of the fit
BITS = 20

_LEET = str.maketrans("0134578@$!", "oieastbasi")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”’)]*\s+|[\r\n]+")
_WORD = re.compile(r"[a-z0-9@$!*]*[a-zß-ɏ][a-z0-9@$*ß-ɏ]*(?:[!@$](?=[a-z])[a-z0-9@$]*)*|\d+")
_SPELLED = re.compile(r"(?<![^\W_])(?:[^\W_][ .\-_*]{1,2}){2,}[^\W_](?![^\W_])")
_GAP = re.compile(r"[ .\-_*]")
_RUN = re.compile(r"(.)\1{2,}")
_MASKED = re.compile(r"(?<![^\W_])[^\W\d_][*]{2,}[^\W\d_]?")


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s and not s.isspace()]


def words_of_sentence(sentence: str) -> list[str]:
    """Undisguised words: spelled-out letters joined, digits standing for letters read as these, numbers as 0."""
    low = folded(sentence)
    low = _SPELLED.sub(lambda m: _GAP.sub("", m[0]) if any(c.isalpha() for c in m[0]) else m[0], low)
    out = []
    for w in _WORD.findall(low):
        if w.isdigit():
            out.append("0")
            continue
        if not w.isalpha():
            w = w.translate(_LEET).replace("*", "")
        out.append(_RUN.sub(r"\1", w))
    return out


def pieces(sentence: str, index: _Index, size: int = PIECE_WORDS, step: int = PIECE_STEP) -> list[list[int]]:
    """Feature indices of the overlapping pieces of a sentence, which together hold every word: words, stems, neighbours, words one apart, and
    whether letters of a word are blotted out. Every feature is hashed once, pieces are slices."""
    words = words_of_sentence(sentence)
    masked = index(["*mask*"] * len(_MASKED.findall(sentence))) if "**" in sentence else []
    single, at = [], [0]
    for w in words:
        single.append(w)
        if len(w) > 5:
            single.append(w[:5] + "-")
        at.append(len(single))
    single = index(single)
    pair = index([a + " " + b for a, b in zip(words, words[1:])])
    skip = index([a[:5] + "~" + b[:5] for a, b in zip(words, words[2:])])
    out = []
    for i in range(0, max(1, len(words) - size + step), step):
        j = min(i + size, len(words))
        out.append(single[at[i] : at[j]] + pair[i : j - 1] + skip[i : max(i, j - 2)] + masked)
    return out


class _Index:
    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, names: list[str]) -> list[int]:
        known, out = self.known, []
        for n in names:
            i = known.get(n)
            if i is None:
                if len(known) > 400_000:
                    known.clear()
                i = known[n] = zlib.crc32(n.encode()) & ((1 << BITS) - 1)
            out.append(i)
        return out


def _bags(texts: list[str], index: _Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature index, its piece, the piece's sentence within its document, the piece's document)."""
    flat, sizes, sentence, doc = [], [], [], []
    for d, text in enumerate(texts):
        for k, s in enumerate(sentences(text)):
            for f in pieces(s, index):
                flat.extend(f)
                sizes.append(len(f))
                sentence.append(k)
                doc.append(d)
    return np.array(flat, np.int64), np.repeat(np.arange(len(sizes)), sizes), np.array(sentence, np.int64), np.array(doc, np.int64)


class AbuseModel:
    def __init__(self, weights: np.ndarray):
        self.weights = weights.astype(np.float32)

    @classmethod
    def fit(cls, texts: list[str], labels: list[float], raters: list[int] | None = None, rounds: int = 80, rate: float = 0.4, decay: float = DECAY, error: float = RATER_ERROR) -> AbuseModel:
        """labels: share of raters that called the document abusive; raters: how many there were, each counts."""
        w = np.zeros((1 << BITS) + 1)
        w[-1] = -4.0
        if not texts:
            return cls(w)
        flat, at, _, doc = _bags(texts, _Index())
        y, n = np.array(labels, float), len(texts)
        votes = np.ones(n) if raters is None else np.array(raters, float)
        votes /= votes.sum()
        g2 = np.full_like(w, 1e-7)
        for _ in range(rounds):
            z = np.clip(np.bincount(at, w[flat], len(doc)) + w[-1], -15, 15)
            p = 1 / (1 + np.exp(-z))
            clean = np.exp(np.bincount(doc, np.log1p(-p), n))  # no piece is abusive
            said = error + (1 - 2 * error) * (1 - clean)
            slope = (said - y) / (said * (1 - said)) * (1 - 2 * error) * votes
            dz = (slope * clean)[doc] * p  # noisy-or: d(1 - clean) / dz = clean * p
            g = np.append(np.bincount(flat, dz[at], 1 << BITS), dz.sum()) + decay * np.append(w[:-1], 0)
            g2 += g * g
            w -= rate * g / np.sqrt(g2)
        return cls(w)

    def score(self, texts: list[str], index: _Index | None = None, least: float = THRESHOLD) -> list[tuple[float, list[tuple[int, float]]]]:
        """(document's score, [(sentence, score)] of those at or above ``least``) for each text; sentences count from 0."""
        if not texts:
            return []
        flat, at, sentence, doc = _bags(texts, index or _Index())
        z = np.bincount(at, self.weights[flat], len(doc)) + self.weights[-1] if len(doc) else np.zeros(0)
        p = 1 / (1 + np.exp(-np.clip(z, -15, 15)))
        clean = np.log1p(-p)
        total = 1 - np.exp(np.bincount(doc, clean, len(texts))) if len(doc) else np.zeros(len(texts))
        hits: list[list[tuple[int, float]]] = [[] for _ in texts]
        new = np.where(np.append(True, (np.diff(doc) != 0) | (np.diff(sentence) != 0)))[0] if len(doc) else np.zeros(0, np.int64)
        each = 1 - np.exp(np.add.reduceat(clean, new)) if len(new) else np.zeros(0)
        for k in np.where(each >= least)[0]:
            hits[doc[new[k]]].append((int(sentence[new[k]]), float(each[k])))
        return list(zip(total.tolist(), hits))


def train_abuse_model(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: int = TRAIN_DOCS, **options) -> AbuseModel:
    """Fit on at most ``most`` labelled documents, those whose key has the smallest hash. NULL labels and texts don't count; raters
    that disagree count by share, a document by its raters. Without labels every document scores low."""
    votes = labels.where("label is not null").groupBy(F.col(key).alias("__key")).agg(F.avg("label").alias("y"), F.count("*").alias("n"))
    chosen = votes.orderBy(F.xxhash64("__key"), "__key").limit(most)
    docs = df.select(F.col(key).alias("__key"), F.col(text).alias("__text")).where("__text is not null").join(F.broadcast(chosen), "__key")  # at most ``most`` rows
    rows = docs.groupBy("__key").agg(F.min("__text").alias("t"), F.first("y").alias("y"), F.first("n").alias("n")).orderBy("__key").collect()
    return AbuseModel.fit([r.t for r in rows], [float(r.y) for r in rows], [r.n for r in rows], **options)


def score_abuse(df: DataFrame, model: AbuseModel, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep..., score, sentences): the score of each distinct key and its offending sentences, ARRAY<STRUCT<sentence, score>>. NULL
    keys give no row, a NULL or empty text scores 0; of several rows of one key the one with the highest score stands."""
    rows = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)]).where("__key is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _Index()
        for pdf in batches:
            for start in range(0, len(pdf), 1024):
                part = pdf.iloc[start : start + 1024]
                made = model.score([t or "" for t in part["__text"]], index)
                yield part.drop(columns="__text").assign(score=[m[0] for m in made], sentences=[[{"sentence": i, "score": p} for i, p in m[1]] for m in made])

    out = rows.mapInPandas(run, rows.drop("__text").schema.simpleString()[7:-1] + ", score double, sentences array<struct<sentence: int, score: double>>")
    best = out.groupBy("__key").agg(F.max_by(F.struct(*[c for c in out.columns if c != "__key"]), "score").alias("x"))
    return best.select(F.col("__key").alias(key), *[F.col(f"x.__k{i}").alias(c) for i, c in enumerate(keep)], "x.score", "x.sentences")


def abuse_rates(scored: DataFrame, source: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """(source, n_docs, n_abusive, rate) per source, NULL being one."""
    hit = F.count_if(F.col("score") >= threshold)
    return scored.groupBy(source).agg(F.count("*").alias("n_docs"), hit.alias("n_abusive"), (hit / F.count("*")).alias("rate"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id) of the documents with an abusive, hateful or sexual passage."""
    docs = table(spark, sf_dir, "documents")
    model = train_abuse_model(docs, table(spark, sf_dir, "abuse_labels"))
    return score_abuse(docs, model).where(F.col("score") >= THRESHOLD).select("doc_id")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of such documents per source."""
    docs = table(spark, sf_dir, "documents")
    return abuse_rates(score_abuse(docs, train_abuse_model(docs, table(spark, sf_dir, "abuse_labels")), keep=("source",)))
