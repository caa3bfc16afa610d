"""Keyed state, ordered scans, ordered lookups and serving shapes as plain DataFrame operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from yelken.session import stored

def fold_latest(df: DataFrame, key: str, order: list[str], last: list[str], first: dict[str, str] | None = None) -> DataFrame:
    """One row per key: the fields ``last`` of its latest row (by ``order``), the smallest of each field in ``first``, the number of rows. A
    map-side combined aggregate, not a window: no key is sorted."""
    latest = F.max_by(F.struct(*last), F.struct(*order)).alias("__last")
    firsts = [F.min(c).alias(name) for name, c in (first or {}).items()]
    return df.groupBy(key).agg(latest, *firsts, F.count("*").alias("n_rows")).select(key, "__last.*", *(first or {}), "n_rows")


def ranked(df: DataFrame, group: str | list[str], order: list[Column], out: str, parts: int | None = None) -> DataFrame:
    """``df`` with the place of each row within its ``group``, from 1. Rows are range-partitioned by group and order, so a group that holds a third of all
    rows spans many tasks; a first pass counts each group in each task (a row a group and task), the second numbers the rows on from there. ``order`` must
    tell all rows apart. Stored, as both passes must see the same partitions."""
    keys = [group] if isinstance(group, str) else group
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(df.repartitionByRange(n, *keys, *order).withColumn("__part", F.spark_partition_id()), "ranked")
    w = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = placed.groupBy(*keys, "__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    before = before.select(*[F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), "__before")
    same = [F.col(k).eqNullSafe(F.col(f"__g{i}")) for i, k in enumerate(keys)]
    both = placed.join(before, [*same, F.col("__part") == F.col("__p")]).select(*placed.columns, "__before")
    inside = F.row_number().over(W.partitionBy(*keys, "__part").orderBy(*order))
    return both.withColumn(out, F.col("__before") + inside).drop("__part", "__before")


def early_stop(df: DataFrame, group: str, order: list[Column], fetched: Column, old: Column, fresh: Column, most: int = 150, most_old: int = 12, known: Column | None = None, old_hint: Column | None = None) -> DataFrame:
    """The rows of each group, in order, up to the first before which ``most`` were fetched or ``most_old`` in a row were old. A row that is ``known`` counts for
    nothing; one with an ``old_hint`` counts as old without being fetched; one that is neither old nor fresh is fetched but leaves the run of old ones as it
    is. NULL flags count as not so; rows that count for nothing aren't part of the result. Before the stop there are at most ``most`` fetched rows and fewer than
    ``most_old`` others between two of them, so each group is first cut to that many by place (see ranked): no window holds more, however large a group is."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    known, hint = flag(known if known is not None else F.lit(False)), flag(old_hint if old_hint is not None else F.lit(False))
    marked = df.withColumn("__old", ~known & (hint | flag(old))).withColumn("__fetched", ~known & ~hint & flag(fetched)).withColumn("__fresh", ~known & ~hint & flag(fresh))
    counted = marked.withColumn("__counts", F.col("__old") | F.col("__fetched"))
    bound = (most + 1) * (most_old + 1)
    rows = ranked(counted.where("__counts"), group, order, "__place").where(F.col("__place") <= bound)
    w = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    count = lambda c, over: F.coalesce(F.sum(F.col(c).cast("int")).over(over), F.lit(0))
    rows = rows.withColumn("__island", count("__fresh", w)).withColumn("__done", count("__fetched", w))
    inside = W.partitionBy(group, "__island").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__streak", count("__old", inside)).withColumn("__stop", (F.col("__done") >= most) | (F.col("__streak") >= most_old))
    upto = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("__stopped", F.max("__stop").over(upto)).where(~F.col("__stopped")).select(*df.columns)


def link_dedup(df: DataFrame, key: list[str], url: str, ordinal: str, hint: str | None = None) -> DataFrame:
    """One row per key: the shortest address (the earliest of equally short ones, then the first by name), the earliest ordinal, the earliest
    known hint where there is such a column, and how many rows there were (n)."""
    hints = [F.min_by(hint, F.when(F.col(hint).isNotNull(), F.struct(ordinal, hint))).alias(hint)] if hint else []
    return df.groupBy(*key).agg(F.min_by(url, F.struct(F.length(url), F.col(ordinal), F.col(url))).alias(url), *hints, F.min(ordinal).alias(ordinal), F.count("*").alias("n"))


def waterfall(queries: DataFrame, key: str, rank: str, found: Column) -> DataFrame:
    """(key, winner, attempts): the smallest rank that was found, NULL if none, and how many were tried up to it."""
    hit = F.min(F.when(found, F.col(rank))).alias("winner")
    tried = queries.groupBy(key).agg(hit, F.collect_list(rank).alias("__ranks"))
    return tried.select(key, "winner", F.size(F.filter("__ranks", lambda r: F.col("winner").isNull() | (r <= F.col("winner")))).alias("attempts"))


def box_reason(lat: Column, lng: Column, south: float, west: float, north: float, east: float) -> Column:
    """First reason to refuse a coordinate, NULL where it stands: missing, outside (bounds belong to the box)."""
    return F.when(lat.isNull() | lng.isNull(), "missing").when(~(lat.between(south, north) & lng.between(west, east)), "outside")


def spread_markers(df: DataFrame, lat: str, lng: str, order: list[Column], radius: float = 0.0011, angle: float = 2.399963) -> DataFrame:
    """Rows that share a rounded coordinate are moved along a spiral; the first stays. Many may share one, such as a district's centre: see ranked. ``order`` must
    tell all rows apart."""
    at = ranked(df.withColumn("__lat", F.round(lat, 5)).withColumn("__lng", F.round(lng, 5)), ["__lat", "__lng"], order, "__k").withColumn("__k", F.col("__k") - 1)
    r, a = F.sqrt(F.col("__k")) * radius, F.col("__k") * angle
    return at.withColumn("shown_lat", F.col(lat) + r * F.sin(a)).withColumn("shown_lng", F.col(lng) + r * F.cos(a) / F.cos(F.col(lat) * math.pi / 180)).drop("__k", "__lat", "__lng")


def range_pairs(df: DataFrame, key: str, at: str, window: int, same: list[str]) -> DataFrame:
    """(key_a, key_b): rows of equal ``same`` at most ``window`` units of ``at`` (a number) apart, key_a < key_b. Buckets make it an equi-join."""
    base = df.select(F.col(key).alias("k"), F.col(at).alias("t"), *same).where(F.col("t").isNotNull())
    left = base.select(F.col("k").alias("key_a"), F.col("t").alias("ta"), *same, F.explode(F.array(*[F.floor(F.col("t") / window) + i for i in (-1, 0, 1)])).alias("b"))
    right = base.select(F.col("k").alias("key_b"), F.col("t").alias("tb"), *same, F.floor(F.col("t") / window).alias("b"))
    return left.join(right, [*same, "b"]).where((F.abs(F.col("ta") - F.col("tb")) <= window) & (F.col("key_a") < F.col("key_b"))).select("key_a", "key_b")
