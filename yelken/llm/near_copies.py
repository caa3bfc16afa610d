"""Near-duplicate records with small edits (problem 7): prefix-filter join over globally ordered n-gram sets.

1. Every record becomes the set of its word n-grams; a digest of the set stands for all records that share it.
2. The global order is rare first. How often an n-gram occurs is read from a table of fixed size (counts by hash bucket over all
   records); any order that all records share keeps the join exact.
3. No trie is built: an inverted index from single n-grams to records is spread over shards. A record enters it under each
   n-gram of its prefix (beyond it the remaining length can't reach the threshold) with its position, size and a bitmap of its whole set.
   The rest of the set is not spelled out: the bitmap bounds what it can add.
4. Under each n-gram, pairs are kept only where the remaining lengths, then the bitmaps, can still reach the threshold.
   Both are upper bounds, so nothing is lost; the survivors are verified exactly on the full sets.

No pair of records with different sets and a similarity at or above the threshold is missed, whatever the order or table size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yelken.llm.main_body import BodyModel, train_body_model
from yelken.llm.plain import lower_tr, plain
from yelken.session import stored, table

WORDS, SIMILARITY = 5, 0.8  # defaults; p7 sets three words and one half
TABLE_BITS = 20  # hash buckets of the count table: at most 2 ** 20 numbers reach the driver and the tasks
BITMAP_WORDS = 6  # 64-bit words of a bitmap
SHARD_ROWS = 8_192  # one shard of the index for so many records
_WORD = re.compile(r"[^\W_]+")


def gram_hashes(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of n consecutive words; of a shorter text the hash of all its words."""
    words = _WORD.findall(lower_tr(plain(text)))
    if not words:
        return np.zeros(0, np.int64)
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    return np.unique(np.array([xxhash.xxh3_64_intdigest(g) for g in grams], np.uint64)).view(np.int64)


def _grams(n: int, model: BodyModel | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), 512):
                part = pdf.iloc[start : start + 512]
                texts = [t or "" for t in part["__text"]]
                if model is not None:
                    kept = []
                    for text, (numbers, p) in zip(texts, model.texts(texts)):
                        lines = text.split("\n")
                        kept.append("\n".join(lines[k - 1] for k, q in zip(numbers, p) if q >= 0.5))
                    texts = kept
                sets = [gram_hashes(f"{h or ''}\n{t}", n) for h, t in zip(part["__head"], texts)]
                yield pd.DataFrame({"key": part["__key"].to_numpy(), "grams": sets, "digest": [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in sets]})

    return run


def gram_sets(df: DataFrame, key: str, text: str, head: str | None = None, n: int = WORDS, model: BodyModel | None = None) -> DataFrame:
    """Stored (key, grams, digest), a row a delivery; records with the same set have the same digest. ``head`` is text put before it;
    with a ``model``, lines it calls furniture are left out. NULL keys and records without words give no row."""
    rows = df.select(F.col(key).cast("string").alias("__key"), F.col(text).alias("__text"), (F.col(head) if head else F.lit("")).alias("__head")).where("__key is not null")
    made = rows.mapInPandas(_grams(n, model), "key string, grams array<bigint>, digest bigint").where("size(grams) > 0")
    return stored(made, "grams")


def _needed(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """Least overlap of sets of sizes a and b whose Jaccard similarity is t."""
    return np.ceil((a.astype(np.int64) + b) * (t / (1 + t)) - 1e-9).astype(np.int64)


def _enter(counts: np.ndarray, shards: int, t: float):
    mask = len(counts) - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entered: set[int] = set()  # of this task: copies enter once
        for pdf in batches:
            out: list[tuple] = []
            for doc, grams in zip(pdf["digest"], pdf["grams"]):
                if doc in entered:
                    continue
                entered.add(doc)
                grams = np.asarray(grams, np.int64)
                n = len(grams)
                seen = counts[grams & mask]
                order = np.lexsort((grams, seen))[: n - int(np.ceil(t * n - 1e-9)) + 1]
                bits = (grams.view(np.uint64) >> np.uint64(20)) % np.uint64(64 * BITMAP_WORDS)
                bitmap = np.zeros(BITMAP_WORDS, np.uint64)
                np.bitwise_or.at(bitmap, (bits >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bits & np.uint64(63)))
                order_pos = np.arange(len(order))
                once = seen[order] == 1  # its bucket holds this occurrence alone: no other record has it
                prefix, order_pos = grams[order][~once], order_pos[~once]
                shard = (prefix.view(np.uint64) >> np.uint64(40)) % np.uint64(shards)
                for s in np.unique(shard):
                    at = shard == s
                    out.append((int(s), doc, n, bitmap.tobytes(), prefix[at].tobytes(), order_pos[at].astype(np.int32).tobytes()))
            yield pd.DataFrame(out, columns=["shard", "doc", "n", "bitmap", "grams", "places"])

    return run


def _below(t: float, most: int = 1_000_000):
    """All pairs of one shard of the index that the bounds let through."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        pdf = pdf.drop_duplicates("doc")
        if len(pdf) < 2:
            return none
        doc, size = pdf["doc"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        bitmap = np.frombuffer(b"".join(pdf["bitmap"]), np.uint64).reshape(len(pdf), -1)
        lengths = np.array([len(g) // 8 for g in pdf["grams"]])
        gram, place = np.frombuffer(b"".join(pdf["grams"]), np.int64), np.frombuffer(b"".join(pdf["places"]), np.int32).astype(np.int64)
        row = np.repeat(np.arange(len(pdf)), lengths)
        by = np.lexsort((size[row], gram))  # under an n-gram by size: partners end where sizes do
        gram, place, row = gram[by], place[by], row[by]
        n = size[row]
        left = n - place  # what the record can still share, this n-gram included
        end = np.append(np.where(np.diff(gram))[0] + 1, len(gram))
        edge_end = end[np.searchsorted(end, np.arange(len(gram)), "right")]
        # partners of i are the rows after it, up to size n / t
        limit = np.searchsorted(n + gram_rank(gram) * (int(n.max()) + 2), np.minimum(np.floor(n / t + 1e-9), n.max()) + gram_rank(gram) * (int(n.max()) + 2), "right")
        count = np.maximum(np.minimum(limit, edge_end) - np.arange(len(gram)) - 1, 0)
        found: list[np.ndarray] = []
        cuts = np.cumsum(count)
        start = 0
        while start < len(gram):
            stop = max(start + 1, int(np.searchsorted(cuts, (cuts[start - 1] if start else 0) + most, "right")))
            c = count[start:stop]
            i = np.repeat(np.arange(start, stop), c)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
            need = _needed(n[i], n[j], t)
            keep = np.minimum(left[i], left[j]) >= need
            i, j, need = i[keep], j[keep], need[keep]
            x, y = row[i], row[j]
            differ = np.bitwise_count(bitmap[x] ^ bitmap[y]).sum(1, dtype=np.int64)
            keep = (n[i] + n[j] - differ) // 2 >= need
            x, y = doc[x[keep]], doc[y[keep]]
            if len(x):
                found.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0))
            start = stop
        if not found:
            return none
        pairs = np.unique(np.concatenate(found), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def gram_rank(gram: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... over the runs of equal values of a sorted array."""
    return np.concatenate([[0], np.cumsum(np.diff(gram) != 0)]) if len(gram) else np.zeros(0, np.int64)


def similar_sets(sets: DataFrame, similarity: float = SIMILARITY, table_bits: int = TABLE_BITS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b, similarity): all pairs of different digests whose sets have a Jaccard similarity of at least ``similarity``."""
    buckets = sets.select(F.explode("grams").alias("g")).groupBy(F.col("g").bitwiseAND(F.lit((1 << table_bits) - 1)).alias("bucket")).agg(F.count("*").alias("n"))
    counted = buckets.toPandas()  # at most 2 ** table_bits rows
    counts = np.zeros(1 << table_bits, np.uint16)
    counts[counted["bucket"].to_numpy(np.int64)] = np.minimum(counted["n"].to_numpy(np.int64), 65535)
    del counted
    shards = max(12, -(-sets.count() // shard_rows))
    entered = sets.select("digest", "grams").mapInPandas(_enter(counts, shards, similarity), "shard int, doc bigint, n int, bitmap binary, grams binary, places binary")
    pairs = stored(entered.groupBy("shard").applyInPandas(_below(similarity), "a bigint, b bigint").distinct(), "candidates")
    used = pairs.select(F.col("a").alias("digest")).unionByName(pairs.select(F.col("b").alias("digest"))).distinct()
    some = stored(sets.groupBy("digest").agg(F.first("grams").alias("grams")).join(used, "digest", "left_semi"), "compared")
    left, right = some.select(F.col("digest").alias("a"), F.col("grams").alias("ga")), some.select(F.col("digest").alias("b"), F.col("grams").alias("gb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("o", F.size(F.array_intersect("ga", "gb")))
    exact = both.withColumn("similarity", F.col("o") / (F.size("ga") + F.size("gb") - F.col("o")))
    return exact.where(F.col("similarity") >= similarity - 1e-12).select("a", "b", "similarity")


def near_copies(df: DataFrame, key: str = "id", text: str = "content", head: str | None = "title", n: int = WORDS, similarity: float = SIMILARITY, model: BodyModel | None = None) -> tuple[DataFrame, DataFrame]:
    """(members: key, digest; links: a, b, similarity): every distinct key with the digest of its set, and all links between digests. Copies
    aren't expanded into pairs. Of several deliveries of a key the one with the smallest digest stands."""
    sets = gram_sets(df, key, text, head, n, model)
    members = stored(sets.groupBy("key").agg(F.min("digest").alias("digest")), "members")
    return members, similar_sets(sets, similarity)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows of news that tell the same story, copies expanded as TESTDATA.md asks."""
    news = table(spark, sf_dir, "news")
    members, links = near_copies(news, n=3, similarity=0.5, model=train_body_model(None, news))
    several = members.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("a"), F.col("digest").alias("b"))
    left, right = members.select(F.col("key").alias("x"), F.col("digest").alias("a")), members.select(F.col("key").alias("y"), F.col("digest").alias("b"))
    pairs = links.select("a", "b").unionByName(several).join(left, "a").join(right, "b").where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
