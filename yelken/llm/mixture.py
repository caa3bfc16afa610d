"""Mixing sources to target weights (problem 9): fixed-length token blocks drawn by index.

The texts of a source, in a pseudorandom order, form one stream of tokens that is cut into blocks. Slots of the output are shared
out among sources shard by shard; the k-th slot of a source takes block perm(k), a pseudorandom permutation, so that a block comes again
only when all blocks of its source have been used. Slots and blocks are joined by index. Counts per source, and per source and group of shards, reach the driver.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from yelken.session import stored, table

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"  # ranks of a public byte-level BPE
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # the usual pattern of such tokenizers
BLOCK_TOKENS, SHARD_BLOCKS, BUCKET_DOCS = 256, 512, 50_000
GROUPS = 1_000  # groups of shards that the driver deals slots to: at most so many rows, whatever the size of the mix
_encoders: dict[str, object] = {}


def _encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _encoders[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, source, n_tokens) of each distinct key with a source; NULL texts have no tokens."""
    rows = df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text")).where("key is not null and source is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(tokenizer).encode_ordinary
        for pdf in batches:
            yield pdf[["key", "source"]].assign(n_tokens=[len(encode(t)) if t else 0 for t in pdf["text"]])

    made = rows.mapInPandas(run, f"key {dict(rows.dtypes)['key']}, source string, n_tokens bigint")
    return made.groupBy("key").agg(F.min(F.struct("source", "n_tokens")).alias("x")).select("key", "x.*")


def pack_blocks(counted: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = 1) -> DataFrame:
    """(source, block, key, first_token, tokens): which tokens of which text stand in which block. Offsets are summed in two steps, over
    buckets of the pseudorandom order and within them, so no source is ever in one task."""
    buckets = max(16, -(-counted.count() // BUCKET_DOCS) * 4)
    h = F.xxhash64("key", F.lit(seed))
    rows = counted.where("n_tokens > 0").withColumn("h", h).withColumn("bucket", F.floor((F.shiftright("h", 33) + F.lit(1 << 30)) * F.lit(buckets) / F.lit(1 << 31)).cast("int"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)  # one row a bucket
    sums = sums.withColumn("start", F.coalesce(F.sum("in_bucket").over(before), F.lit(0))).drop("in_bucket")
    inside = W.partitionBy("source", "bucket").orderBy("h", "key").rowsBetween(W.unboundedPreceding, -1)
    at = rows.join(sums, ["source", "bucket"]).withColumn("at", F.col("start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    first, last = F.floor(F.col("at") / block_tokens), F.floor((F.col("at") + F.col("n_tokens") - 1) / block_tokens)
    pieces = at.withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("block") * block_tokens, F.col("at"))
    end = F.least((F.col("block") + 1) * block_tokens, F.col("at") + F.col("n_tokens"))
    return pieces.select("source", "block", "key", (begin - F.col("at")).alias("first_token"), (end - begin).alias("tokens"))


def quotas(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, float]:
    """Tokens each source is to give. Sources without texts or target give none and the other shares are scaled to one. Without ``total``
    the mix is the largest in which every source meets its share within its repeats; a larger one uses capped sources
    wholly and shares the rest out among the others."""
    open_ = {s: share for s, (share, repeats) in targets.items() if share and share > 0 and repeats and repeats > 0 and tokens.get(s, 0) > 0}
    if not open_:
        return {}
    most = {s: tokens[s] * targets[s][1] for s in open_}
    whole = sum(open_.values())
    if total is None:
        total = math.floor(min(most[s] * whole / open_[s] for s in open_))
    given: dict[str, float] = {}
    left = float(min(total, sum(most.values())))
    while open_:
        whole = sum(open_.values())
        full = [s for s in open_ if left * open_[s] / whole > most[s] * (1 + 1e-12)]
        if not full:
            return given | {s: left * share / whole for s, share in open_.items()}
        for s in full:
            given[s] = float(most[s])
            del open_[s]
        left = max(0.0, float(min(total, sum(most.values()))) - sum(given.values()))
    return given


def _deal(left: np.ndarray, sizes: list[int], rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Slots of each source for parts of the given sizes: multinomial draws, conditioned on each source's total so that the shares come out exact."""
    left = left.copy()
    for size in sizes:
        take = rng.multivariate_hypergeometric(left, min(size, int(left.sum())), method="marginals")
        left -= take
        yield take


def _shards(spark: SparkSession, slots: dict[str, int], shard_blocks: int, seed: int, groups: int = GROUPS) -> DataFrame:
    """(shard, source, start, n): which slots of which source stand in which shard. The driver deals slots to at most ``groups`` groups of shards;
    each group deals its own to its shards, in a task of its own."""
    names = sorted(slots)
    total = sum(slots.values())
    shards = -(-total // shard_blocks)
    each = max(1, -(-shards // groups))  # shards of a group
    start, rows = np.zeros(len(names), np.int64), []
    sizes = [min(each * shard_blocks, total - g * each * shard_blocks) for g in range(-(-shards // each))]
    for g, take in enumerate(_deal(np.array([slots[s] for s in names], np.int64), sizes, np.random.default_rng(seed))):
        rows.append((g, start.tolist(), take.tolist()))
        start = start + take
    schema = "shard bigint, source string, start bigint, n bigint"
    if not rows:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for g, begin, own in zip(pdf["g"], pdf["start"], pdf["own"]):
                at, own, out = np.array(begin, np.int64), np.array(own, np.int64), []
                for k, take in enumerate(_deal(own, [shard_blocks] * -(-int(own.sum()) // shard_blocks), np.random.default_rng([seed, int(g)]))):
                    out += [(int(g) * each + k, s, int(a), int(n)) for s, a, n in zip(names, at, take) if n]
                    at = at + take
                yield pd.DataFrame(out, columns=["shard", "source", "start", "n"])

    made = spark.createDataFrame(rows, "g bigint, start array<bigint>, own array<bigint>")
    return made.repartition(min(len(rows), 200), "g").mapInPandas(run, schema)


def mix_sources(df: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", total_tokens: int | None = None, tokenizer: str = TOKENIZER, block_tokens: int = BLOCK_TOKENS, shard_blocks: int = SHARD_BLOCKS, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chosen: key, source, n_tokens, repeats, used_tokens; shares: source, target_share, max_repeats, tokens, used_tokens, share;
    plan: shard, source, slot, block). Repeats is how often the most used part of a text is used, never more than max_repeats.
    NULL sources and keys are left out; of a repeated target the first by share counts. See ``quotas`` for the sizes."""
    spark = df.sparkSession
    counted = stored(count_tokens(df, key, text, source, tokenizer), "tokens")
    pieces = stored(pack_blocks(counted, block_tokens, seed), "pieces")
    supply = {r.source: (r.t, r.b) for r in pieces.groupBy("source").agg(F.sum("tokens").alias("t"), (F.max("block") + 1).alias("b")).collect()}  # a row a source
    wanted = {}
    for r in targets.where("source is not null").orderBy("target_share", "max_repeats").collect():  # a row a source
        wanted.setdefault(r.source, (r.target_share or 0.0, r.max_repeats or 0))
    quota = quotas({s: t for s, (t, _) in supply.items()}, wanted, total_tokens)
    slots = {s: min(round(q / block_tokens), supply[s][1] * wanted[s][1]) for s, q in quota.items()}
    rng = np.random.default_rng(seed + 1)
    steps = []
    for s in sorted(slots):
        n = supply[s][1]
        a = next((x for x in (int(v) for v in rng.integers(1, max(2, min(1 << 30, (1 << 62) // n)), 1000)) if math.gcd(x, n) == 1), 1)
        steps.append((s, n, a, int(rng.integers(0, n)), int(rng.integers(0, n))))
    drawn = _shards(spark, slots, shard_blocks, seed)
    perm = spark.createDataFrame(steps, "source string, blocks bigint, a bigint, b bigint, c bigint")
    slot = drawn.withColumn("slot", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1))).join(F.broadcast(perm), "source")  # a row a source
    again, k = F.floor(F.col("slot") / F.col("blocks")), F.col("slot") % F.col("blocks")
    plan = slot.select("shard", "source", "slot", ((F.col("a") * k + F.col("b") + again * F.col("c")) % F.col("blocks")).alias("block"))
    uses = plan.groupBy("source", "block").agg(F.count("*").alias("uses"))
    used = pieces.join(uses, ["source", "block"]).groupBy("key").agg(F.max("uses").cast("int").alias("repeats"), F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"))
    chosen = stored(counted.join(used, "key").select(F.col("key").alias(key), "source", "n_tokens", "repeats", "used_tokens"), "chosen")
    given = chosen.groupBy("source").agg(F.sum("used_tokens").alias("used_tokens"))
    all_of = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    goal = spark.createDataFrame([(s, float(x), int(r)) for s, (x, r) in wanted.items()] or [], "source string, target_share double, max_repeats int")
    whole = given.agg(F.sum("used_tokens").alias("whole"))
    shares = goal.join(all_of, "source", "full").join(given, "source", "left").join(F.broadcast(whole))  # one row
    shares = shares.select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.coalesce(F.col("used_tokens") / F.col("whole"), F.lit(0.0)).alias("share"))
    return chosen, shares, plan


def _tokenizer(spark: SparkSession) -> str:
    """Path of the tokenizer's ranks: the session's yelken.tokenizer, else TOKENIZER."""
    return spark.conf.get("yelken.tokenizer", TOKENIZER)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents with their repeats."""
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), tokenizer=_tokenizer(spark))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached, by source."""
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), tokenizer=_tokenizer(spark))[1]
