"""State of addresses and stories between runs: what to fetch, what a run found, sources added to stories, changes after a new classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Outcomes that are never tried again, and those that are tried again so many times.
FINAL = ("saved", "merged", "no_category", "not_local", "no_location", "geocode_failed", "no_date")
RETRIED, MOST_ATTEMPTS = ("fetch_failed", "parse_failed"), 3


def should_fetch(links: DataFrame, ledger: DataFrame, stories: DataFrame, since: Column, url: str = "url") -> DataFrame:
    """``links`` with a BOOLEAN ``fetch``. Not fetched: addresses that are a source of a story (``stories``: sources ARRAY<STRUCT<url>>), final ones,
    those out of range unless published (``published_at`` of the ledger) since, failed ones after MOST_ATTEMPTS. ``ledger`` holds one row an
    address. A NULL address isn't fetched. Two equi-joins; neither side is collected."""
    known = stories.select(F.explode("sources.url").alias("__u")).distinct().withColumn("__source", F.lit(True))
    state = ledger.select(F.col("url").alias("__l"), F.col("status").alias("__status"), F.col("attempts").alias("__attempts"), F.col("published_at").alias("__published"))
    both = links.join(known, F.col(url) == F.col("__u"), "left").join(state, F.col(url) == F.col("__l"), "left")
    status = F.col("__status")
    fetch = (
        F.when(F.col(url).isNull() | F.col("__source").isNotNull(), False)
        .when(status.isNull(), True)
        .when(status.isin(*FINAL), False)
        .when(status == "out_of_range", F.coalesce(F.col("__published") >= since, F.lit(False)))
        .when(status.isin(*RETRIED), F.coalesce("__attempts", F.lit(0)) < MOST_ATTEMPTS)
        .otherwise(True)
    )
    return both.withColumn("fetch", fetch).drop("__u", "__source", "__l", "__status", "__attempts", "__published")


def mark_both(rows: DataFrame, url: str = "url", discovered: str = "discovered_url") -> DataFrame:
    """Two ledger rows for a page that was found under another address: one for each (``marked``), the discovered one naming the page's (``canonical_url``)."""
    each = F.array_compact(F.array_distinct(F.array(F.col(url), F.col(discovered))))
    return rows.withColumn("marked", F.explode(each)).withColumn("canonical_url", F.when(F.col("marked") != F.col(url), F.col(url)))


def outcome(since: Column, published: Column, error: Column, length: Column, category: Column, local: Column, duplicate: Column, candidates: Column, unavailable: Column, geocoded: Column, least: int = 60) -> Column:
    """Outcome of a page, the first that holds. NULL flags count as not so."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(error.isNotNull(), error)
        .when(published < since, "out_of_range")
        .when(F.coalesce(length, F.lit(0)) < least, "parse_failed")
        .when(category.isNull(), "no_category")
        .when(no(local), "not_local")
        .when(duplicate, "merged")
        .when(F.coalesce(candidates, F.lit(0)) == 0, "no_location")
        .when(unavailable, "geocode_error")
        .when(no(geocoded), "geocode_failed")
        .otherwise("saved")
    )


def site_report(links: DataFrame, site: str, known: Column, old: Column, fetched: Column, failed: Column) -> DataFrame:
    """(site, links_found, skipped_known, skipped_old, fetched, errors) per site; NULL flags count as not so."""
    counts = {"links_found": F.lit(True), "skipped_known": known, "skipped_old": old, "fetched": fetched, "errors": failed}
    return links.groupBy(site).agg(*[F.count_if(c).alias(name) for name, c in counts.items()])


def new_sources(stories: DataFrame, found: DataFrame) -> DataFrame:
    """(id, added): sources to append to each story, ARRAY<STRUCT<site_name, url, similarity>> in order. ``stories``: id, sources; ``found``: id of the story a
    page repeats, site_name, url, similarity, ord. Left out: addresses and sites the story has already; of several pages of a site
    the first by ord is taken. Similarity is rounded to 4 places."""
    have = stories.select("id", F.col("sources.url").alias("__urls"), F.col("sources.site_name").alias("__sites"))
    fresh = found.join(have, "id").where(~F.coalesce(F.array_contains("__urls", F.col("url")), F.lit(False)) & ~F.coalesce(F.array_contains("__sites", F.col("site_name")), F.lit(False)))
    one = fresh.groupBy("id", "site_name").agg(F.min_by(F.struct("ord", "site_name", "url", F.round("similarity", 4).alias("similarity")), F.struct("ord", "url")).alias("x"))
    # a story gets at most one source a site
    ordered = F.transform(F.array_sort(F.collect_list("x")), lambda x: F.struct(x["site_name"].alias("site_name"), x["url"].alias("url"), x["similarity"].alias("similarity")))
    return one.groupBy("id").agg(ordered.alias("added"))


def with_sources(stories: DataFrame, added: DataFrame) -> DataFrame:
    """``stories`` with the sources of ``added`` (id, added of the same element type) behind their own."""
    both = stories.join(added.select(F.col("id").alias("__id"), "added"), F.col("id") == F.col("__id"), "left")
    return both.withColumn("sources", F.when(F.col("added").isNull(), F.col("sources")).otherwise(F.concat("sources", "added"))).drop("__id", "added")


def reclassified(stories: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stories: those that keep a type, with the new one and ``changed``; ledger: url, site_name of the sources of stories that lost theirs, to be marked
    no_category). ``new``: id, category, a row a story. Stories without a type are dropped from the first."""
    both = stories.join(new.select(F.col("id").alias("__id"), "category"), F.col("id") == F.col("__id")).drop("__id")
    kept = both.where("category is not null").withColumn("changed", ~F.col("type").eqNullSafe(F.col("category"))).withColumn("type", F.col("category")).drop("category")
    gone = both.where("category is null").select(F.explode("sources").alias("s")).select("s.url", "s.site_name").distinct()
    return kept, gone
