"""Evaluation texts leaking into training text (problem 8): suffix arrays over shards of the training text.

Each task turns its documents into shards of bounded size. Words the test items never use cannot be part of a match,
so they break the sequences (exact). Over the remaining positions a suffix array is built by doubling, test words ranked
along with the shard's; every test suffix is binary-searched in it, and neighbouring hits are chained to the
longest verbatim matches. The corpus is read once per block of test items; nothing of it is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yelken.llm.plain import folded
from yelken.session import table

MIN_WORDS = 12
ITEM_WORDS = 2_000_000  # words of test items handed to every task at once; more items are taken in further passes
SHARD_WORDS = 2_000_000  # words of training text in one suffix array; a longer document has one of its own

_WORDS = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Words for comparing: case, accents, punctuation, blanks, line ends and disguises don't matter."""
    return _WORDS.findall(folded(text)) if text else []


def _ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """rank[i] orders the ``depth`` tokens from i on. Token 0 breaks: beyond it nothing counts."""
    have, ranks, n = 1, {1: tokens.astype(np.int64)}, len(tokens)

    def joined(a: np.ndarray, b: np.ndarray, skip: int) -> np.ndarray:
        tail = np.zeros(n, np.int64)
        tail[: max(0, n - skip)] = b[skip:]
        return np.unique(a * (int(b.max(initial=0)) + 1) + tail, return_inverse=True)[1].astype(np.int64)

    while have * 2 <= depth:
        ranks[have * 2] = joined(ranks[have], ranks[have], have)
        have *= 2
    made, rank = have, ranks[have]
    for size in sorted(ranks, reverse=True):
        if made < depth and made + size <= depth and size < have:
            rank, made = joined(rank, ranks[size], made), made + size
    return rank


def _shard_matches(train: np.ndarray, test: np.ndarray, least: int, most: int = 4_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(training position, test position, words) of the maximal common runs of at least ``least`` words."""
    none = (np.zeros(0, np.int64),) * 3
    if not len(train) or not len(test):
        return none
    both = np.concatenate([train, [0], test, [0]])
    # positions with ``least`` non-breaking words ahead are the only suffixes that can match
    stop = np.where(both == 0)[0]
    ahead = stop[np.searchsorted(stop, np.arange(len(both)))] - np.arange(len(both))
    good = np.where(ahead >= least)[0]
    split = np.searchsorted(good, len(train))
    corpus, items = good[:split], good[split:]
    if not len(corpus) or not len(items):
        return none
    rank = _ranks(both, least)
    order = corpus[np.argsort(rank[corpus], kind="stable")]  # the shard's suffix array
    sorted_ranks = rank[order]
    low, high = np.searchsorted(sorted_ranks, rank[items], "left"), np.searchsorted(sorted_ranks, rank[items], "right")
    if not (high > low).any():
        return none
    # a passage repeated in corpus and items meets itself often: hits are spelled out for so many training positions at a time that they
    # stay bounded. Runs never cross a break, so parts end at breaks
    by_rank = np.argsort(rank[items], kind="stable")
    items, test_ranks = items[by_rank], rank[items][by_rank]
    place = np.sort(corpus)
    first, past = np.searchsorted(test_ranks, rank[place], "left"), np.searchsorted(test_ranks, rank[place], "right")
    some = past > first
    place, first, number = place[some], first[some], (past - first)[some]
    run = np.searchsorted(stop, place)  # the break that ends the position's run
    cuts, done = [0], 0
    total = np.cumsum(number)
    ends = np.append(np.where(np.diff(run))[0] + 1, len(place))
    for end, following in zip(ends, np.append(ends[1:], len(place))):
        if end == len(place) or total[following - 1] - done > most:
            cuts.append(int(end))
            done = total[end - 1]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        p = np.repeat(place[a:b], number[a:b])
        ahead_of = np.cumsum(number[a:b]) - number[a:b]
        t = items[np.arange(len(p)) - np.repeat(ahead_of, number[a:b]) + np.repeat(first[a:b], number[a:b])]
        by = np.lexsort((p, p - t))
        p, t = p[by], t[by]
        new = np.ones(len(p), bool)
        new[1:] = ((p - t)[1:] != (p - t)[:-1]) | (np.diff(p) != 1)
        start = np.where(new)[0]
        out.append((p[start], t[start] - len(train) - 1, np.diff(np.append(start, len(p))) + least - 1))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else none


def _finder(items: list[tuple], least: int, shard_words: int):
    vocabulary: dict[str, int] = {}
    test, owner, offset = [], [], []
    for k, (_, text) in enumerate(items):
        for j, w in enumerate(words_of(text)):
            test.append(vocabulary.setdefault(w, len(vocabulary) + 1))
            owner.append(k)
            offset.append(j)
        test.append(0)
        owner.append(k)
        offset.append(0)
    test, owner, offset = np.array(test, np.int64), np.array(owner), np.array(offset)
    names = [i for i, _ in items]

    def shard(keys: list, docs: list[list[int]]) -> pd.DataFrame:
        starts = np.cumsum([0] + [len(d) + 1 for d in docs])
        train = np.fromiter((x for d in docs for x in (*d, 0)), np.int64, starts[-1])
        p, t, n = _shard_matches(train, test, least)
        d = np.searchsorted(starts, p, "right") - 1
        return pd.DataFrame({"__doc": [keys[i] for i in d], "__item": [names[owner[i]] for i in t], "words": n.astype(np.int64), "doc_word": (p - starts[d]).astype(np.int64), "item_word": offset[t].astype(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, docs, size = [], [], 0
        for pdf in batches:
            for key, text in zip(pdf["__doc"], pdf["__text"]):
                d = [vocabulary.get(w, 0) for w in words_of(text)]
                if size and size + len(d) > shard_words:
                    yield shard(keys, docs)
                    keys, docs, size = [], [], 0
                keys.append(key)
                docs.append(d)
                size += len(d)
        yield shard(keys, docs)

    return run


def find_leaks(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", least: int = MIN_WORDS, item_words: int = ITEM_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(key, item_key, words, doc_word, item_word): for each document and item that share a run of at least ``least`` words, the
    longest such run and where it starts in either (the first of several). NULL keys and texts, texts too short give no row;
    a repeated key counts once, a repeated item_key joins its texts. Items are taken in blocks of about ``item_words`` words, each with one pass."""
    docs = df.select(F.col(key).alias("__doc"), F.col(text).alias("__text")).where("__doc is not null and __text is not null")
    tests = items.select(F.col(item_key).alias("__item"), F.col(item_text).alias("__text")).where("__item is not null and __text is not null").distinct()
    characters = tests.agg(F.coalesce(F.sum(F.length("__text")), F.lit(0))).first()[0]
    blocks = max(1, -(-characters // (4 * item_words)))
    kinds = dict(docs.dtypes) | {"__item": dict(tests.dtypes)["__item"]}
    schema = f"__doc {kinds['__doc']}, __item {kinds['__item']}, words bigint, doc_word bigint, item_word bigint"
    found = None
    for b in range(blocks):
        block = tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("__item", "__text"), F.lit(blocks)) == b)
        rows = sorted(map(tuple, block.collect()))  # at most about item_words words
        part = docs.mapInPandas(_finder(rows, least, shard_words), schema)
        found = part if found is None else found.unionByName(part)
    best = F.max_by(F.struct("words", "doc_word", "item_word"), F.struct("words", -F.col("doc_word"), -F.col("item_word")))
    return found.groupBy("__doc", "__item").agg(best.alias("x")).select(F.col("__doc").alias(key), F.col("__item").alias(item_key), "x.*")


def without_leaks(df: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df`` whose document shares no such run with any item."""
    hit = find_leaks(df, items, key, **options).select(F.col(key).alias("__hit")).distinct()
    return df.join(hit, df[key] == F.col("__hit"), "left_anti")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of the documents that hold at least 12 consecutive words of an item."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")
