"""Lists, counts and reports over stored stories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yelken.operators.timestamps import day_range, iso_date

DEFAULT_LIMIT, MOST_ROWS = 500, 2_000


def clamped(value: object, default: int, least: int, most: int) -> int:
    """A whole number between the bounds; the default for anything that is none."""
    try:
        number = int(str(value).strip())
    except (TypeError, ValueError):
        return default
    return max(least, min(most, number))


def filtered(df: DataFrame, types: list[str] | None = None, district: str | None = None, start: str | None = None, end: str | None = None, *, all_types: tuple[str, ...], districts: tuple[str, ...], zone: str, at: str = "published_at") -> DataFrame:
    """Stories with coordinates. ``types`` None: all; else those of it that exist, none of them gives no row. A blank district is none, an unknown one gives
    no row. ``start`` and ``end`` are local days (texts, both included); what is no date is left out of account. Plain comparisons of columns, so they
    reach the scan."""
    out = df.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    if types is not None:
        out = out.where(F.col("type").isin(*[t for t in types if t in all_types]) if any(t in all_types for t in types) else F.lit(False))
    if district and district.strip():
        out = out.where(F.col("district") == district.strip()) if district.strip() in districts else out.where(F.lit(False))
    first, before = day_range(iso_date(F.lit(start).cast("string")), iso_date(F.lit(end).cast("string")), zone)
    for text, bound, keep in ((start, first, lambda c, b: c >= b), (end, before, lambda c, b: c < b)):
        if text is not None:
            out = out.where(bound.isNull() | F.coalesce(keep(F.col(at).cast("timestamp"), bound), F.lit(False)))
    return out


def latest(df: DataFrame, limit: object = None, at: str = "published_at", key: str = "id") -> DataFrame:
    """The newest stories, the smaller key first on ties, those without a time last; the limit is between 1 and MOST_ROWS."""
    return df.orderBy(F.col(at).desc_nulls_last(), key).limit(clamped(limit, DEFAULT_LIMIT, 1, MOST_ROWS))


def counts_by_type(df: DataFrame, types: DataFrame) -> DataFrame:
    """(type, n, total): a row for each of ``types`` (type), 0 where there is none; total counts all of them."""
    n = df.groupBy(F.col("type").alias("__t")).agg(F.count("*").alias("__n"))
    each = types.join(n, F.col("type") == F.col("__t"), "left").select("type", F.coalesce("__n", F.lit(0)).alias("n"))
    return each.crossJoin(F.broadcast(each.agg(F.sum("n").alias("total"))))  # one row


def point(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row of one key, none for a key that doesn't exist; a repeated key once."""
    return df.where(F.col(key) == F.lit(value)).dropDuplicates([key])


def last_of(df: DataFrame, group: list[str], at: str, *fields: str) -> DataFrame:
    """(group, fields) of the row with the latest ``at`` of each group; of equally late ones the one with the larger fields. NULL times count only where there are no
    others."""
    return df.groupBy(*group).agg(F.max_by(F.struct(*fields), F.struct(F.col(at).isNotNull(), at, *fields)).alias("x")).select(*group, "x.*")


def trace(df: DataFrame, limit: int, at: str = "created_at") -> DataFrame:
    """(id, type, title, sites, at_text, place, lat, lng): the newest stories that stand on the map, their sites as one line of text."""
    newest = df.where("lat is not null and lng is not null").orderBy(F.col(at).desc_nulls_last(), "id").limit(limit)
    return newest.select("id", "type", "title", F.array_join(F.transform("sources", lambda s: s["site_name"]), ", ").alias("sites"), F.date_format(at, "dd.MM.yyyy HH:mm").alias("at_text"), F.coalesce("location_text", F.lit("-")).alias("place"), "lat", "lng")


def last_days(today: Column, days: int) -> tuple[Column, Column]:
    """(first, last) of a range of ``days`` days that ends today."""
    return F.date_sub(today, days - 1), today


def without(df: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """``df`` without the rows whose key stands in ``gone``."""
    return df.join(gone.select(F.col(key).alias("__gone")).distinct(), F.col(key) == F.col("__gone"), "left_anti")


def invariant_breaks(stories: DataFrame, ledger: DataFrame, cache: DataFrame) -> DataFrame:
    """(rule, n): how many keys break what must be unique: an address in one story only, one ledger row an address, one cache row a provider and key."""
    shared = stories.select("id", F.explode("sources.url").alias("u")).distinct().groupBy("u").count().where("count > 1")
    twice = ledger.groupBy("url").count().where("count > 1")
    cached = cache.groupBy("provider", "key").count().where("count > 1")
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n") for rule, df in (("source_of_two_stories", shared), ("ledger_address_twice", twice), ("cache_key_twice", cached))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def latex_rows(keywords: DataFrame) -> DataFrame:
    """(category, line): the keyword table as rows of a LaTeX table, a row a category and weight. ``keywords``: category, keyword, weight, ord."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "keyword"))), lambda x: F.rtrim(x["keyword"], F.lit("$"))), ", ")
    line = F.concat(F.replace("category", F.lit("_"), F.lit("\\_")), F.lit(" & "), F.col("weight").cast("string"), F.lit(" & "), F.col("words"), F.lit(" \\\\"))
    return keywords.groupBy("category", "weight").agg(listed.alias("words")).select("category", "weight", line.alias("line"))
