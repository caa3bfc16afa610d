"""Structured Streaming: incremental ledger, windowed counts, deduplicated arrivals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from yelken.operators.relational import fold_latest


def windowed_counts(stream: DataFrame, at: str, by: str, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, by, n): counts per (sliding) window; rows later than ``late`` are out of range. Works on batches too."""
    marked = stream.withWatermark(at, late) if stream.isStreaming else stream
    window = F.window(at, width, slide) if slide else F.window(at, width)
    return marked.groupBy(window.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def new_arrivals(stream: DataFrame, key: str, at: str, late: str = "3 days") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def _versions(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the whole versions of a kind, rising."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.split("-")[1]) for n in names if n.startswith(kind + "-") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def _fold(rows: DataFrame, key: str, order: list[str], last: list[str]) -> DataFrame:
    fields = list(dict.fromkeys([*order, *last]))
    return rows.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("x"), F.sum("n_rows").cast("bigint").alias("n_rows")).select(key, "x.*", "n_rows")


def read_ledger(spark: SparkSession, path: str, key: str, order: list[str], last: list[str], before: int | None = None) -> DataFrame | None:
    """The latest row of each key with its number of rows (n_rows): the newest base and the changes after it, folded. None where nothing was written.
    ``before``: only versions with smaller numbers."""
    upto = lambda kind: [v for v in _versions(spark, path, kind) if before is None or v < before]
    bases, changes = upto("base"), upto("delta")
    base = bases[-1:]
    parts = [f"{path}/base-{v}" for v in base] + [f"{path}/delta-{v}" for v in changes if not base or v > base[0]]
    return _fold(spark.read.parquet(*parts), key, order, last) if parts else None


def maintain_ledger(stream: DataFrame, path: str, checkpoint: str, key: str, order: list[str], last: list[str], then: Callable[[DataFrame, int], None] | None = None, every: int = 32) -> StreamingQuery:
    """Keeps the latest row of each key under ``path``: each micro-batch writes only its own folded rows (delta-<batch>), each ``every``-th folds all of them into
    a new base, so that history is not rewritten batch by batch. A batch that is run again writes the same version. ``then`` gets the batch's folded
    rows. Read it with read_ledger."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fields = list(dict.fromkeys([*order, *last]))
        change = _fold(batch.select(key, *fields, F.lit(1).cast("bigint").alias("n_rows")), key, order, last)
        change.write.mode("overwrite").parquet(f"{path}/delta-{number}")
        if (number + 1) % every == 0:
            read_ledger(spark, path, key, order, last, number + 1).write.mode("overwrite").parquet(f"{path}/base-{number}")
        if then:
            then(spark.read.parquet(f"{path}/delta-{number}"), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["fold_latest", "maintain_ledger", "new_arrivals", "read_ledger", "windowed_counts"]
