"""Deduplicating new batches against all history (problem 2): a persisted inverted file of vector cells.

The index lives in a folder as Parquet: full vectors with their cell and their angle to the cell's centre, laid out in slabs of
time; the centres; source addresses in a table of their own. A batch reads only the slabs its instants can reach. Rows meet within buckets as
long as the time window (a row asks its own bucket and both neighbours); a crowded bucket is cut into parts of whole cells, and a row is sent only to
parts with a cell whose angle bounds admit the threshold. Inside a part the bounds skip cells again, the rest is reranked exactly. Accepted
rows are appended to the cells. Rows of a batch with equal vector and instant are one class: they meet others once.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from yelken.operators.timestamps import normalise_timestamps
from yelken.session import shared_dir, stored, table

MIN_COSINE, WINDOW_DAYS = 0.90, 3
LEAST_CELLS = 16  # cells a vector length; they grow with the root of the rows, up to one for FIT_ROWS / 20 vectors of the fit
FIT_ROWS = 20_000  # vectors the cell centres are fitted on, at most; every row is indexed
CHUNK_ROWS = 8_192  # rows of one bucket that meet in one task
SLAB_BUCKETS = 10  # buckets a folder of the index
FILE_ROWS = 1_000_000  # rows of an append that one task writes, about
HANDED_BYTES = 32_000_000  # vectors of a batch, with their angles, that are handed to the tasks which scan history; beyond that both sides shuffle
BROADCAST_ROWS = 200_000  # addresses of a batch that are sent to all tasks; beyond that the join shuffles
IN_ORDER_ROWS, IN_ORDER_LINKS = 20_000, 1_000_000  # rows and links of one batch that are decided in order in one place; larger batches in rounds of joins


def url_key(url: Column) -> Column:
    """Host and path: scheme, user, www., doubled and final slashes, query and fragment don't count. NULL for NULL, empty or blank ones."""
    s = F.regexp_replace(F.trim(url), r"[?#].*$", "")
    s = F.regexp_replace(s, r"^(?i:[a-z][a-z0-9+.-]*:)?/*", "")
    s = F.regexp_replace(F.regexp_replace(s, "/{2,}", "/"), "/$", "")
    host = F.regexp_replace(F.lower(F.substring_index(s, "/", 1)), r"^www\.", "")
    path = F.when(F.instr(s, "/") > 0, F.regexp_replace(s, "^[^/]*", "")).otherwise("")
    return F.nullif(F.concat(host, path), F.lit(""))


def _unit(vectors: pd.Series) -> list[np.ndarray]:
    out = []
    for v in vectors:
        a = np.asarray(v, np.float64)
        norm = math.sqrt(float(a @ a)) if len(a) and not np.isnan(a).any() else 0.0
        out.append(a / norm if norm > 0 and math.isfinite(norm) else None)
    return out


def _fit(sample: list[list[float]], cells: int, seed: int = 7) -> dict[int, np.ndarray]:
    """Spherical k-means centres by vector length."""
    by: dict[int, list] = {}
    for v in _unit(pd.Series(sample, dtype=object)):
        if v is not None:
            by.setdefault(len(v), []).append(v)
    centres = {}
    for dim, rows in by.items():
        x = np.stack(rows)
        c = x[np.random.default_rng(seed).permutation(len(x))[: min(cells, len(x))]]
        for _ in range(8):
            near = np.argmax(x @ c.T, 1)
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c)
        centres[dim] = c
    return centres


def _assign(centres: dict[int, np.ndarray], ask: bool):
    """Cell and angle of each vector; with ``ask`` its angles to all centres as well."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            units = _unit(pdf["__vec"])
            keep = [i for i, u in enumerate(units) if u is not None]
            units, pdf = [units[i] for i in keep], pdf.iloc[keep]
            cell, angle, angles = [], [], []
            for u in units:
                c = centres.get(len(u))
                cos = c @ u if c is not None else np.ones(1)
                every = np.arccos(np.clip(cos, -1, 1)) if c is not None else np.zeros(0)
                cell.append(int(np.argmax(cos)) if c is not None else -1)
                angle.append(float(every.min()) if c is not None else 0.0)
                angles.append(every)
            out = pdf.drop(columns="__vec").assign(dim=[len(u) for u in units], cell=cell, angle=angle, vec=units)
            yield out.assign(angles=angles) if ask else out

    return run


def _probe(centres: dict[int, np.ndarray], min_cosine: float, window_us: int, links: bool):
    """links: all pairs; else of each asked one only its smallest match."""
    reach = math.acos(min_cosine) + 1e-6

    def run(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(asked) and len(held):
            q, h = np.stack(asked["vec"]), np.stack(held["vec"])
            q_at, h_at, cell, angle = asked["at"].to_numpy(), held["at"].to_numpy(), held["cell"].to_numpy(), held["angle"].to_numpy()
            q_id, h_id = asked["name"].to_numpy(), held["name"].to_numpy()
            c = centres.get(int(key[0]))
            q_angle = np.arccos(np.clip(q @ c.T, -1, 1)) if c is not None else None
            order = np.argsort(cell, kind="stable")
            for members in np.split(order, np.where(np.diff(cell[order]))[0] + 1):
                one = cell[members[0]]
                askers = np.arange(len(q))
                if one >= 0 and q_angle is not None:  # no member can be nearer than the gap between the angles
                    far = q_angle[:, one]
                    askers = np.where((far - angle[members].max() <= reach) & (angle[members].min() - far <= reach))[0]
                for part in range(0, len(askers), 2048):
                    some = askers[part : part + 2048]
                    near = (q[some] @ h[members].T >= min_cosine - 1e-9) & (np.abs(q_at[some][:, None] - h_at[members][None, :]) <= window_us)
                    i, j = np.nonzero(near)
                    if len(i):
                        found = pd.DataFrame({"name": q_id[some[i]], "other": h_id[members[j]]})
                        out.append(found if links else found.groupby("name", as_index=False)["other"].min())
        made = pd.concat(out) if out else pd.DataFrame({"name": [], "other": []}, dtype=object)
        return made if links else made.groupby("name", as_index=False)["other"].min()

    return run


def _scan(asked: pd.DataFrame, min_cosine: float, window_us: int, links: bool):
    """The same for held rows as they come from the cells, against all asked ones: nothing of the cells is shuffled."""
    reach = math.acos(min_cosine) + 1e-6
    groups = {}
    for (dim, bucket), part in asked.groupby(["dim", "bucket"]):
        groups[int(dim), int(bucket)] = (part["name"].to_numpy(), part["at"].to_numpy(np.int64), np.stack(part["vec"]), np.stack(part["angles"]))
    around: dict[tuple[int, int], tuple | None] = {}

    def askers(dim: int, bucket: int) -> tuple | None:
        if (dim, bucket) not in around:
            found = [groups[k] for i in (-1, 0, 1) if (k := (dim, bucket + i)) in groups]
            around[dim, bucket] = tuple(np.concatenate(x) for x in zip(*found)) if found else None
        return around[dim, bucket]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for (dim, bucket), held in pdf.groupby(["dim", "bucket"]):
                asking = askers(int(dim), int(bucket))
                if asking is None:
                    continue
                name, at, q, angles = asking
                h_name, h_at, cell, angle = held["name"].to_numpy(), held["at"].to_numpy(np.int64), held["cell"].to_numpy(), held["angle"].to_numpy()
                for start in range(0, len(name), 2048):
                    part = slice(start, start + 2048)
                    near = np.abs(at[part, None] - h_at[None, :]) <= window_us
                    if angles.shape[1]:  # no member can be nearer than the gap between the angles to its cell's centre
                        near &= (np.abs(angles[part][:, np.maximum(cell, 0)] - angle[None, :]) <= reach) | (cell < 0)[None, :]
                    some, members = np.where(near.any(1))[0], np.where(near.any(0))[0]
                    if len(some):
                        h = np.stack(held["vec"].to_numpy()[members])
                        i, j = np.nonzero(near[np.ix_(some, members)] & (q[part][some] @ h.T >= min_cosine - 1e-9))
                        if len(i):
                            out.append(pd.DataFrame({"name": name[part][some[i]], "other": h_name[members[j]]}))
            made = pd.concat(out) if out else pd.DataFrame({"name": [], "other": []}, dtype=object)
            yield made if links else made.groupby("name", as_index=False)["other"].min()

    return run


class History:
    """Index of accepted records in ``path``. Records: id STRING, urls ARRAY<STRING>, at BIGINT (epoch microseconds), vec ARRAY<FLOAT>."""

    def __init__(self, spark: SparkSession, path: str, min_cosine: float = MIN_COSINE, window_days: float = WINDOW_DAYS, chunk_rows: int = CHUNK_ROWS, handed_bytes: int = HANDED_BYTES, in_order_rows: int = IN_ORDER_ROWS):
        """Opens the index in ``path``, which ``create`` made."""
        self.handed_bytes, self.in_order_rows = handed_bytes, in_order_rows
        self.spark, self.path, self.min_cosine, self.chunk_rows = spark, path, min_cosine, chunk_rows
        self.window_us = int(window_days * 86_400_000_000)
        self.centres: dict[int, np.ndarray] = {}
        rows: dict[int, list] = {}
        for r in self._read("centres", "dim int, cell int, vec array<double>").orderBy("dim", "cell").collect():  # at most FIT_ROWS / 20 a length
            rows.setdefault(r.dim, []).append(r.vec)
        self.centres = {dim: np.array(c) for dim, c in rows.items()}

    @classmethod
    def create(cls, records: DataFrame, path: str | None = None, cells: int | None = None, fit_rows: int = FIT_ROWS, **options) -> History:
        """A new index of ``records``; NULL ids are left out, a repeated id joins its addresses and keeps one vector. ``cells``: 0 for none."""
        spark = records.sparkSession
        path = path or os.path.join(shared_dir(spark), f"history-{uuid.uuid4().hex}")
        with_vec = records.where("vec is not null")
        if cells is None:
            cells = min(max(LEAST_CELLS, int(math.sqrt(with_vec.count()) / 4)), max(LEAST_CELLS, fit_rows // 20))
        sample = with_vec.select("vec").orderBy(F.xxhash64("vec")).limit(fit_rows).collect() if cells > 0 else []
        rows = [(dim, i, c.tolist()) for dim, centres in _fit([r.vec for r in sample], cells).items() for i, c in enumerate(centres)]
        spark.createDataFrame(rows, "dim int, cell int, vec array<double>").coalesce(1).write.parquet(f"{path}/centres")
        made = cls(spark, path, **options)
        made.append(records)
        return made

    def _cells(self, records: DataFrame, ask: bool = False) -> DataFrame:
        rows = records.where("id is not null and at is not null and vec is not null").select("id", "at", F.col("vec").alias("__vec"))
        out = rows.mapInPandas(_assign(self.centres, ask), "id string, at bigint, dim int, cell int, angle double, vec array<double>" + (", angles array<double>" if ask else ""))
        return out.withColumn("bucket", F.floor(F.col("at") / self.window_us)).withColumn("slab", F.floor(F.col("bucket") / SLAB_BUCKETS))

    def append(self, records: DataFrame) -> None:
        """Add accepted records to the cells and addresses. One slab may hold most rows: it is written by as many tasks as its rows ask for."""
        addresses = records.where("id is not null").select("id", F.explode("urls").alias("url")).select("id", url_key(F.col("url")).alias("key")).where("key is not null").distinct()
        cells = stored(self._cells(records).dropDuplicates(["id"]), "appended")
        small = cells.count() <= FILE_ROWS
        (addresses.coalesce(1) if small else addresses).sortWithinPartitions("key").write.mode("append").parquet(f"{self.path}/urls")
        if small:
            spread = cells.coalesce(1)
        else:
            sizes = cells.groupBy("slab").agg(F.count("*").alias("n"))  # a row a slab
            spread = cells.join(sizes, "slab").withColumn("__task", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / FILE_ROWS))).drop("n")
            spread = spread.repartition("slab", "__task").drop("__task")
        spread.sortWithinPartitions("slab", "bucket", "cell").write.mode("append").partitionBy("slab").parquet(f"{self.path}/cells")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _meet(self, asked: DataFrame, held: DataFrame, links: bool = False) -> DataFrame:
        """(name, other): rows that agree in vector and time. asked: name, at, dim, angles, vec, bucket; held: name, at, dim, cell, angle, vec, bucket. A bucket of
        more than chunk_rows held rows is cut into chunks of neighbouring cells, a larger cell into parts; a row is sent to the chunks that hold a cell its angles admit. Asked rows of up to HANDED_BYTES are handed to
        the tasks that read the held ones instead, which then don't move; both ways give the same."""
        size = asked.agg(F.sum(8 * (F.size("vec") + F.size("angles")) + 100)).first()[0] or 0
        if size <= self.handed_bytes:  # a batch is small against history: its vectors go to the cells
            handed = asked.select("name", "at", "dim", "bucket", "vec", "angles").toPandas()
            return held.select("name", "at", "dim", "cell", "angle", "vec", "bucket").mapInPandas(_scan(handed, self.min_cosine, self.window_us, links), "name string, other string")
        reach = math.acos(self.min_cosine) + 1e-6
        held = held.select(*[F.col(c).alias(c) for c in ("name", "at", "dim", "cell", "angle", "vec", "bucket")])  # of its own, as a batch also meets itself
        sizes = held.groupBy("dim", "bucket", "cell").agg(F.count("*").alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi"))  # a row a cell of a bucket
        before = W.partitionBy("dim", "bucket").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
        sizes = sizes.withColumn("chunk", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / self.chunk_rows)).withColumn("one", F.struct("cell", "lo", "hi"))
        chunks = sizes.groupBy("dim", "bucket", "chunk").agg(F.collect_list("one").alias("cells"), F.ceil(F.sum("n") / self.chunk_rows).alias("parts"))
        wide = asked.withColumn("bucket", F.explode(F.array(*[F.col("bucket") + i for i in (-1, 0, 1)])))
        crowd = wide.groupBy("dim", "bucket").agg(F.ceil(F.count("*") / self.chunk_rows).alias("askers"))
        far = lambda c: F.get("angles", c["cell"])
        admits = F.exists("cells", lambda c: (c["cell"] < 0) | ((far(c) - c["hi"] <= reach) & (c["lo"] - far(c) <= reach)))
        ask = wide.join(chunks, ["dim", "bucket"]).where(admits).drop("angles", "cells").join(crowd, ["dim", "bucket"])
        ask = ask.withColumn("asker", F.pmod(F.xxhash64("name"), "askers")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        hold = held.join(sizes.select("dim", "bucket", "cell", "chunk"), ["dim", "bucket", "cell"]).join(chunks.select("dim", "bucket", "chunk", "parts"), ["dim", "bucket", "chunk"]).join(crowd, ["dim", "bucket"])
        hold = hold.withColumn("part", F.pmod(F.xxhash64("name"), "parts")).withColumn("asker", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("askers") - 1)))
        key = ["dim", "bucket", "chunk", "part", "asker"]
        own = lambda df, *cols: df.select(*[F.col(c).alias(c) for c in (*key, *cols)])
        q, h = own(ask, "name", "at", "vec"), own(hold, "name", "at", "cell", "angle", "vec")
        return q.groupBy(*key).cogroup(h.groupBy(*key)).applyInPandas(_probe(self.centres, self.min_cosine, self.window_us, links), "name string, other string")

    def check(self, batch: DataFrame) -> DataFrame:
        """(id, matched, accepted): one row per distinct id of ``batch``, taken in order of id; matched is the smallest accepted
        record with a smaller id that the row repeats, NULL where it is accepted itself. Larger ids arrive later, so a row delivered again gets the same
        answer. Nothing is appended; pass the accepted rows to append()."""
        batch = batch.where("id is not null")
        rows = self._cells(batch, ask=True).dropDuplicates(["id"])
        # equal vector and instant: one class, named by 128 bits of both
        rows = stored(rows.withColumn("class", F.concat_ws("-", F.hex(F.xxhash64("vec", "at")), F.hex(F.xxhash64("at", F.lit("class"), "vec")))), "batch")
        classes = rows.dropDuplicates(["class"]).withColumn("name", F.col("class"))
        urls = stored(batch.select("id", F.explode("urls").alias("url")).select("id", url_key(F.col("url")).alias("key")).where("key is not null").distinct(), "batch-urls")
        slabs = {r.s for r in rows.select(F.explode(F.array(*[F.floor((F.col("bucket") + i) / SLAB_BUCKETS) for i in (-1, 1)])).alias("s")).distinct().collect()}  # slabs of time
        kept = self._read("cells", "id string, at bigint, dim int, cell int, angle double, vec array<double>, bucket bigint, slab bigint").withColumnRenamed("id", "name")
        kept = kept.where(F.col("slab").isin(*slabs) if slabs else F.lit(False))
        old = self._read("urls", "id string, key string").withColumnRenamed("id", "other")
        asked_urls = F.broadcast(urls) if urls.count() <= BROADCAST_ROWS else urls
        of_class = rows.select("id", F.col("class").alias("name"))
        by_vector = self._meet(classes, kept).groupBy("name").agg(F.min("other").alias("other")).join(of_class, "name").select("id", "other")
        history = by_vector.unionByName(old.join(asked_urls, "key").select("id", "other")).where("other < id").groupBy("id").agg(F.min("other").alias("old"))
        ids = batch.select("id").distinct()
        if rows.count() <= self.in_order_rows and (made := self._in_order(ids, rows, classes, urls, history)) is not None:
            return made
        history = stored(history, "history-hits")
        free = stored(ids.join(history, "id", "left_anti").join(rows.select("id", "class"), "id", "left"), "free")
        open_classes = classes.join(free.select("class").distinct(), "class", "left_semi")
        links = self._meet(open_classes, open_classes, links=True).where("name <> other").select(F.col("name").alias("x"), F.col("other").alias("y")).distinct()
        # a class is near itself
        links = stored(links.unionByName(open_classes.select(F.col("class").alias("x"), F.col("class").alias("y"))), "links")
        accepted = self._greedy(free, links, urls)
        first_of = accepted.where("class is not null").groupBy(F.col("class").alias("y")).agg(F.min("id").alias("other"))
        near = links.join(first_of, "y").groupBy(F.col("x").alias("name")).agg(F.min("other").alias("other")).join(of_class, "name").select("id", "other")
        owner = urls.join(accepted.select("id"), "id", "left_semi").groupBy("key").agg(F.min("id").alias("other"))
        best = near.unionByName(urls.join(owner, "key").select("id", "other")).where("other < id").groupBy("id").agg(F.min("other").alias("new"))
        out = ids.join(history, "id", "left").join(best, "id", "left").select("id", F.least("old", "new").alias("matched"))
        return out.withColumn("accepted", F.col("matched").isNull())

    def _in_order(self, ids: DataFrame, rows: DataFrame, classes: DataFrame, urls: DataFrame, history: DataFrame) -> DataFrame | None:
        """The result of check() for a batch of proven size, its rows taken one after another; None where it has more rows or links than that."""
        names = [r.id for r in ids.limit(IN_ORDER_ROWS + 1).collect()]
        keys = [tuple(r) for r in urls.select("id", "key").limit(IN_ORDER_LINKS + 1).collect()]
        pairs = self._meet(classes, classes, links=True).where("name < other").select("name", "other").limit(IN_ORDER_LINKS + 1).collect()
        if len(names) > IN_ORDER_ROWS or max(len(keys), len(pairs)) > IN_ORDER_LINKS:
            return None
        old = {r.id: r.old for r in history.collect()}  # at most a row a name
        near: dict[str, list[str]] = {}
        for r in pairs:
            near.setdefault(r.name, []).append(r.other)
            near.setdefault(r.other, []).append(r.name)
        of: dict[str, list[tuple[str, str]]] = {}
        for i, c in rows.select("id", "class").collect():
            of.setdefault(i, []).append(("class", c))
        for i, k in keys:
            of.setdefault(i, []).append(("key", k))
        first: dict[tuple[str, str], str] = {}  # the first accepted row of each class and address
        out = []
        for i in sorted(names):
            groups = of.get(i, [])
            asked = [*groups, *(("class", y) for kind, c in groups if kind == "class" for y in near.get(c, []))]
            matched = min((m for m in (old.get(i), *(first.get(g) for g in asked)) if m is not None), default=None)
            if matched is None:
                for g in groups:
                    first.setdefault(g, i)
            out.append((i, matched, matched is None))
        return self.spark.createDataFrame(out, "id string, matched string, accepted boolean")

    @staticmethod
    def _greedy(free: DataFrame, links: DataFrame, urls: DataFrame) -> DataFrame:
        """The rows (id, class) that repeat no earlier accepted one: rounds of the lexicographically first maximal independent set. Rows of one class or address
        aren't paired: of a class, its neighbours and an address only the first waiting row can be accepted, and then all the others are refused."""
        accepted, waiting = None, free
        while True:
            mine = urls.join(waiting.select("id"), "id", "left_semi")
            first_key = mine.groupBy("key").agg(F.min("id").alias("first"))
            first_class = waiting.where("class is not null").groupBy(F.col("class").alias("y")).agg(F.min("id").alias("first"))
            ahead = links.join(first_class, "y").groupBy(F.col("x").alias("class")).agg(F.min("first").alias("first"))
            blocked = waiting.join(ahead, "class").where("first < id").select("id").unionByName(mine.join(first_key, "key").where("first < id").select("id")).distinct()
            now = stored(waiting.join(blocked, "id", "left_anti"), "accepted")
            accepted = now if accepted is None else accepted.unionByName(now)
            taken = mine.join(now.select("id"), "id", "left_semi").select("key").distinct()
            near = links.join(now.select(F.col("class").alias("y")).distinct(), "y", "left_semi").select(F.col("x").alias("class")).distinct()
            refused = waiting.join(near, "class", "left_semi").select("id").unionByName(mine.join(taken, "key", "left_semi").select("id")).distinct()
            waiting = stored(waiting.join(now.select("id"), "id", "left_anti").join(refused, "id", "left_anti").select(*free.columns), "waiting")
            if waiting.isEmpty():
                return accepted


def news_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of news as records, one a distinct id."""
    news = normalise_timestamps(table(spark, sf_dir, "news").select("id", "published_at", "site_name", "sources.url", "embedding"), table(spark, sf_dir, "sites"))
    return news.select("id", F.coalesce("url", F.array().cast("array<string>")).alias("urls"), (F.col("utc_sec") * 1_000_000).alias("at"), F.col("embedding").alias("vec"))


def incoming_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "news_incoming")
    at = F.unix_micros(F.col("published_at").cast("timestamp"))
    return rows.select("id", F.array("url").alias("urls"), at.alias("at"), F.col("embedding").alias("vec"), "batch_no")


def check_batches(history: History, batches: DataFrame, batch: str = "batch_no") -> DataFrame:
    """(id, matched, accepted, batch) of all rows of ``batches`` (records with a column ``batch``), taken batch by batch in order; the accepted rows of each are
    appended before the next is checked. A loop over batches, of which a run has few; rows never reach the driver."""
    numbers = [r[0] for r in batches.select(batch).where(F.col(batch).isNotNull()).distinct().orderBy(batch).collect()]
    out = None
    for n in numbers:
        rows = batches.where(F.col(batch) == n).drop(batch)
        checked = stored(history.check(rows), "checked")
        history.append(rows.join(checked.where("accepted").select("id"), "id", "left_semi"))
        checked = checked.withColumn(batch, F.lit(n))
        out = checked if out is None else out.unionByName(checked)
    if out is None:
        out = batches.select("id", F.col("id").alias("matched"), F.lit(True).alias("accepted"), batch).where("false")
    return out


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_a, id_b): the refused rows of news_incoming with the accepted record each repeats. The batches come in turn."""
    history = History.create(news_records(spark, sf_dir))
    checked = check_batches(history, incoming_records(spark, sf_dir))
    refused = checked.where("matched is not null").groupBy("id").agg(F.min("matched").alias("id_a"))
    return refused.select("id_a", F.col("id").alias("id_b"))
