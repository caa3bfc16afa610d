"""Lines repeated across one site's documents (problem 3): distributed suffix arrays over line identifiers.

Every line becomes a 64-bit identifier of its letters. A block can only span many documents if each of its lines does,
so identifiers below the threshold break the sequences into runs first (exact, and it bounds what is left: a site has at
most 10 x lines-per-document frequent identifiers). The suffixes of the runs, pre-aggregated with the number of documents,
are range-partitioned and sorted over all sites: a suffix array whose shards are even however large one site is. Common
prefixes of neighbours give the repeated blocks of each shard; blocks that touch a shard's edge are summed across shards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yelken.llm.plain import lower_tr, plain
from yelken.session import stored, table

_NOT_LETTER = re.compile(r"[\W\d_]+")
MIN_DOCS, MIN_SHARE = 5, 0.1
MOST_LINES = 256  # a longer block is told as one of so many lines; its lines are found all the same, as each begins a suffix
SALTS = 32  # tasks that one site's documents are spread over when they meet the site's list


def line_key(line: str) -> str:
    """The letters of a line: disguises undone, Turkish lower case."""
    return _NOT_LETTER.sub("", lower_tr(plain(line)))


def _line_ids(text: str) -> list[int]:
    """An identifier a line; 0 for a line without letters."""
    keys = lower_tr(plain(text)).split("\n")
    return [xxhash.xxh3_64_intdigest(k) - (1 << 63) or 1 if (k := _NOT_LETTER.sub("", line)) else 0 for line in keys]


def _identify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.drop(columns="__text").assign(__lines=[_line_ids(t) for t in pdf["__text"]])


def _suffixes_of(lines: list[int], frequent: set[int]) -> list[tuple[tuple[int, ...], int]]:
    """(suffix, documents it adds) of one document: all suffixes of its runs of frequent lines, each worth 1, and for every two neighbours among
    them in sorted order their common prefix, worth -1. A prefix that occurs m times has m - 1 such neighbours, so it sums up to one document."""
    suffixes, run = [], []
    for line in [*lines, 0]:
        if line in frequent:
            run.append(line)
        elif run:
            suffixes += [tuple(run[i : i + MOST_LINES]) for i in range(len(run))]
            run = []
    suffixes.sort()
    out = [(s, 1) for s in suffixes]
    for a, b in zip(suffixes, suffixes[1:]):
        common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        if common:
            out.append((a[:common], -1))
    return out


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(site, list(s), n) for site, lines, frequent in zip(pdf["__site"], pdf["__lines"], pdf["__list"]) for s, n in _suffixes_of(list(lines), set(frequent))]
        yield pd.DataFrame(rows, columns=["__site", "__suffix", "__n"])


def _with_lists(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """Each document with the list of its site. A site may hold a third of all documents: both sides are salted, so its documents stand in
    SALTS tasks; a list, whose length the share bounds, goes to each."""
    salted = lists.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return docs.withColumn("__salt", F.pmod(F.xxhash64("__key"), F.lit(SALTS)).cast("int")).join(salted, ["__site", "__salt"]).drop("__salt")


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of one sorted shard of the suffix array: (site, prefix, documents) of every prefix shared by neighbours, plus all prefixes
    of the suffixes at the shard's edges and of single suffixes; they are summed over shards afterwards."""
    stack: list[list] = []  # [length of the common prefix, documents so far, suffix it was opened with]
    out: list[tuple] = []
    last_site, last, last_n, first = None, [], 0, True

    def close(down_to: int, site: object) -> None:
        while stack and stack[-1][0] > down_to:
            length, n, suffix = stack.pop()
            out.append((site, suffix[:length], n))
            if stack and stack[-1][0] >= down_to:
                stack[-1][1] += n
            elif down_to > 0:
                stack.append([down_to, n, suffix])
            if stack and stack[-1][0] == down_to:
                break

    for pdf in batches:
        for site, suffix, n in zip(pdf["__site"], pdf["__suffix"], pdf["__docs"]):
            suffix = list(suffix)
            common = 0
            if site == last_site:
                while common < min(len(last), len(suffix)) and last[common] == suffix[common]:
                    common += 1
            close(common, last_site)
            # every prefix of a new suffix opens an interval of its own; the deeper they are the fewer documents they hold
            base = stack[-1][0] if stack else 0
            for length in range(base + 1, len(suffix) + 1):
                stack.append([length, 0, suffix])
            if stack:
                stack[-1][1] += int(n)
            last_site, last, last_n, first = site, suffix, n, False
        if len(out) > 50_000:
            yield pd.DataFrame(out, columns=["__site", "__block", "__docs"])
            out.clear()
    close(0, last_site)
    yield pd.DataFrame(out, columns=["__site", "__block", "__docs"])


def _covered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        lines_out, sizes = [], []
        for lines, blocks in zip(pdf["__lines"], pdf["__list"]):
            known = {tuple(b) for b in blocks}
            lines, hit, size, reach = list(lines), [], [], 0
            for i, line in enumerate(lines):
                length = 1
                if line and (line,) in known:
                    while i + length < len(lines) and tuple(lines[i : i + length + 1]) in known:
                        length += 1
                    reach = max(reach, i + length)
                    hit.append(i + 1)
                    size.append(length)
                elif i < reach:
                    hit.append(i + 1)
                    size.append(length)
            lines_out.append(hit)
            sizes.append(size)
        yield pdf[["__key"]].assign(__hit=lines_out, __size=sizes)


def repeated_lines(df: DataFrame, key: str = "id", text: str = "content", site: str = "site_name", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(key, line_no, block_lines): the lines of ``text`` (split at LF, counted from 1) that belong to a block of one or more lines
    found in at least ``min_docs`` and at least ``min_share`` of the distinct documents of their ``site``; block_lines is the length
    of the longest such block that starts there. Lines compare by their letters. NULL keys, texts and sites, lines without letters
    give no row; of several deliveries of one key the first by content counts. Documents are counted once per block, however often it stands in them."""
    docs = df.select(F.col(key).alias("__key"), F.col(site).alias("__site"), F.col(text).alias("__text")).where("__key is not null and __site is not null and __text is not null")
    ids = docs.mapInPandas(_identify, docs.drop("__text").schema.simpleString()[7:-1] + ", __lines array<bigint>")
    docs = stored(ids.groupBy("__key").agg(F.min(F.struct("__site", "__lines")).alias("x")).select("__key", "x.__site", "x.__lines"), "lines")
    total = docs.groupBy("__site").agg(F.count("*").alias("__all"))
    seen = docs.select("__site", F.explode(F.array_distinct("__lines")).alias("__line")).where("__line <> 0").groupBy("__site", "__line").agg(F.count("*").alias("__n"))
    need = F.greatest(F.lit(min_docs), F.col("__all") * F.lit(min_share) - 1e-9)
    # at most lines-per-document / min_share identifiers a site, whatever the number of documents
    frequent = seen.join(total, "__site").where(F.col("__n") >= need).groupBy("__site").agg(F.collect_list("__line").alias("__list"))
    suffixes = _with_lists(docs, frequent).select("__site", "__lines", "__list").mapInPandas(_runs, "__site string, __suffix array<bigint>, __n bigint")
    array = suffixes.groupBy("__site", "__suffix").agg(F.sum("__n").alias("__docs")).repartitionByRange("__site", "__suffix").sortWithinPartitions("__site", "__suffix")
    found = array.mapInPandas(_blocks, "__site string, __block array<bigint>, __docs bigint").groupBy("__site", "__block").agg(F.sum("__docs").alias("__n"))
    blocks = found.join(total, "__site").where(F.col("__n") >= need).groupBy("__site").agg(F.collect_list("__block").alias("__list"))
    hits = _with_lists(docs, blocks).select("__key", "__lines", "__list").mapInPandas(_covered, f"__key {dict(docs.dtypes)['__key']}, __hit array<int>, __size array<int>")
    return hits.select(F.col("__key").alias(key), F.explode(F.arrays_zip("__hit", "__size")).alias("x")).select(key, F.col("x.__hit").alias("line_no"), F.col("x.__size").alias("block_lines"))


def without_repeated_lines(df: DataFrame, key: str = "id", text: str = "content", site: str = "site_name", **options) -> DataFrame:
    """``df`` with the repeated lines taken out of ``text``; rows and other columns stay as they are."""
    lines = repeated_lines(df, key, text, site, **options).groupBy(F.col(key).alias("__key")).agg(F.collect_set("line_no").alias("__out"))
    kept = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(F.coalesce("__out", F.array().cast("array<int>")), i + 1)), "\n")
    return df.join(lines, df[key] == F.col("__key"), "left").withColumn(text, kept).drop("__key", "__out")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, line_no) of the lines to remove from news.content."""
    return repeated_lines(table(spark, sf_dir, "news")).select("id", "line_no")
