"""Similarity of vectors within a time or label window, and greedy merging in order."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yelken.session import stored


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; zero vectors give 0, different lengths NULL."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), dot(a, b) / F.greatest(norm, F.lit(1e-12)))


def cosine_pairs(df: DataFrame, key: str, vector: str, block: str, least: float, tile_rows: int = 2_000) -> DataFrame:
    """(key_a, key_b, similarity) of rows in the same ``block`` with a cosine of at least ``least``, key_a < key_b. Rows are made unit vectors once; a block is cut into
    tiles of about ``tile_rows`` rows, each pair of tiles is a task of its own and a matrix product, so no block is ever in one task. Vectors of another
    length, or NULL, give no pair; zero vectors are similar to nothing. All pairs of a block are compared: narrow it by time where there is one."""
    rows = df.select(F.col(key).alias("k"), F.col(vector).alias("v"), F.col(block).alias("b")).where("k is not null and v is not null and b is not null").withColumn("n", F.size("v"))
    tiles = rows.groupBy("b", "n").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("tiles"))  # a row a block
    placed = rows.join(tiles, ["b", "n"]).withColumn("tile", F.pmod(F.xxhash64("k"), F.col("tiles").cast("bigint")).cast("int"))
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    spread = placed.withColumn("other", F.explode(every)).select("b", "n", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), "tile", "k", "v")
    kind = dict(rows.dtypes)["k"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = int(pdf["x"].iloc[0]), int(pdf["y"].iloc[0])
        left, right = pdf[pdf["tile"] == x], pdf[pdf["tile"] == y]
        a, c = (np.stack(p["v"].map(lambda v: np.asarray(v, np.float64))) if len(p) else None for p in (left, right))
        if a is None or c is None:
            return pd.DataFrame({"key_a": [], "key_b": [], "similarity": []})
        a, c = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (a, c))
        s = a @ c.T
        i, j = np.nonzero(s >= least)
        ka, kb, s = left["k"].to_numpy()[i], right["k"].to_numpy()[j], s[i, j]
        keep = (ka < kb) if x == y else np.ones(len(s), bool)
        ka, kb, s = ka[keep], kb[keep], s[keep]
        low = ka < kb
        return pd.DataFrame({"key_a": np.where(low, ka, kb), "key_b": np.where(low, kb, ka), "similarity": s})

    return spread.groupBy("b", "n", "x", "y").applyInPandas(run, f"key_a {kind}, key_b {kind}, similarity double")


def best_match(pairs: DataFrame) -> DataFrame:
    """(key_b, key_a, similarity): the most similar earlier row of each row, the smaller key on ties."""
    best = F.max_by(F.struct("key_a", "similarity"), F.struct("similarity", -F.col("key_a"))).alias("x")
    return pairs.groupBy("key_b").agg(best).select("key_b", "x.key_a", "x.similarity")


def greedy_merge(rows: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """(key, leader): rows in order of key; a row joins the most similar of the earlier leaders it is linked to, the smallest of equally
    similar ones, else leads itself. ``links``: key_a, key_b, similarity; without similarity all count the same. Rounds of the
    lexicographically first independent set; every round is written to the shared folder."""
    similarity = F.col("similarity") if "similarity" in links.columns else F.lit(0.0)
    linked = stored(links.select("key_a", "key_b", similarity.alias("similarity")), "links")
    leaders, waiting, open_ = None, stored(rows.select(F.col(key).alias("k")).distinct(), "waiting"), linked.select("key_a", "key_b")
    every = waiting
    while True:
        now = stored(waiting.join(open_.select(F.col("key_b").alias("k")).distinct(), "k", "left_anti"), "leaders")
        leaders = now if leaders is None else leaders.unionByName(now)
        gone = open_.join(now.select(F.col("k").alias("key_a")), "key_a", "left_semi").select(F.col("key_b").alias("k")).distinct()
        waiting = stored(waiting.join(now, "k", "left_anti").join(gone, "k", "left_anti"), "waiting")
        if waiting.isEmpty():
            break
        keep = waiting.select(F.col("k").alias("key_a"))
        open_ = stored(open_.join(keep, "key_a", "left_semi").join(keep.withColumnRenamed("key_a", "key_b"), "key_b", "left_semi"), "open")
    nearest = F.min_by("key_a", F.struct(-F.col("similarity"), "key_a")).alias("joined")
    led = linked.join(leaders.select(F.col("k").alias("key_a")), "key_a", "left_semi").groupBy(F.col("key_b").alias("k")).agg(nearest)
    own = leaders.withColumn("own", F.col("k"))
    return every.join(own, "k", "left").join(led, "k", "left").select(F.col("k").alias(key), F.coalesce("own", "joined").alias("leader"))


def embedding_text(title: Column, content: Column, most: int = 1200) -> Column:
    """What a sentence encoder is given: the title and the beginning of the content, as the feature asks."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.left(F.coalesce(content, F.lit("")), F.lit(most)))


def hashed_words(texts: pd.Series, size: int = 256) -> pd.Series:
    """A stand-in for a sentence encoder: unit vectors of hashed word counts, the same in every process."""

    def one(text: str | None) -> list[float]:
        v = np.zeros(size)
        for w in re.findall(r"\w+", (text or "").lower()):
            v[zlib.crc32(w.encode()) % size] += 1
        n = np.linalg.norm(v)
        return (v / n if n else v).astype(np.float32).tolist()

    return texts.map(one)


def embed(df: DataFrame, text: str, out: str = "embedding", encoder: Callable[[pd.Series], pd.Series] = hashed_words) -> DataFrame:
    """``df`` with vectors of ``text`` (ARRAY<FLOAT>) by ``encoder``, which takes a batch of texts and is loaded once a worker."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield encoder(batch)

    return df.withColumn(out, run(F.col(text)))


def unit(vector: Column) -> Column:
    """The vector in double precision and of length 1, computed once a row; NULL for NULL, zero vectors stay."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.transform(F.array(norm), lambda n: F.transform(vector, lambda v: v.cast("double") / F.greatest(n, F.lit(1e-12)))).getItem(0)


def nearest_in_window(asked: DataFrame, held: DataFrame, seconds: int) -> DataFrame:
    """(key, best, similarity) for each row of ``asked``: the most similar row of ``held`` whose instant lies at most ``seconds`` away (both ends included) and whose
    vector is as long, the smaller key on ties; NULL and 0.0 where there is none. Both: key, at (seconds), vec. Time buckets make it an equi-join,
    salted on the asked side so that a crowded day isn't one task; only each row's best so far leaves a task."""
    q = asked.select("key", "at", unit(F.col("vec")).alias("q"), F.size("vec").alias("n"), F.pmod(F.xxhash64("key"), F.lit(8)).alias("salt")).where("at is not null and q is not null")
    q = q.withColumn("bucket", F.explode(F.array(*[F.floor(F.col("at") / seconds) + i for i in (-1, 0, 1)])))
    h = held.select(F.col("key").alias("other"), F.col("at").alias("t"), unit(F.col("vec")).alias("h"), F.size("vec").alias("n")).where("t is not null and h is not null")
    h = h.withColumn("bucket", F.floor(F.col("t") / seconds)).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(7).cast("bigint"))))
    dot = F.aggregate(F.zip_with("q", "h", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    met = q.join(h, ["bucket", "n", "salt"]).where(F.abs(F.col("at") - F.col("t")) <= seconds).select("key", "other", dot.alias("s"))
    best = met.groupBy("key").agg(F.min_by(F.struct("other", "s"), F.struct(-F.col("s"), "other")).alias("x"))
    return asked.select("key").distinct().join(best, "key", "left").select("key", F.col("x.other").alias("best"), F.coalesce("x.s", F.lit(0.0)).alias("similarity"))
