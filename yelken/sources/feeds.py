"""Feeds, sitemaps and page metadata as DataFrames. Fetching is not part of the engine: pages arrive as rows or files."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from yelken.operators.timestamps import parse_instant


def read_rss(spark: SparkSession, path: str, zone: str = "Europe/Istanbul") -> DataFrame:
    """(link, published_sec) of the items of RSS files."""
    items = spark.read.format("xml").option("rowTag", "item").schema("link string, pubDate string, date string").load(path)
    return items.select(F.trim("link").alias("link"), parse_instant(F.coalesce("pubDate", "date"), F.lit(zone)).alias("published_sec"))


def read_atom(spark: SparkSession, path: str, zone: str = "Europe/Istanbul") -> DataFrame:
    """(link, published_sec) of the entries of Atom files."""
    rows = spark.read.format("xml").option("rowTag", "entry").schema("link struct<_href: string>, published string, updated string").load(path)
    return rows.select(F.col("link._href").alias("link"), parse_instant(F.coalesce("published", "updated"), F.lit(zone)).alias("published_sec"))


def read_sitemap(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(loc, lastmod) of the addresses of sitemap files."""
    return spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path).select(F.trim("loc").alias("loc"), "lastmod")


def read_sitemap_index(spark: SparkSession, path: str, most: int = 3) -> list[str]:
    """Addresses of at most ``most`` children of an index, those that look like news before the others, in order of the file; a plain sitemap has none."""
    rows = spark.read.format("xml").option("rowTag", "sitemap").schema("loc string").load(path)
    named = rows.select(F.trim("loc").alias("loc"), F.monotonically_increasing_id().alias("ord")).where("loc <> ''")
    return [r.loc for r in named.orderBy(~F.col("loc").rlike("news|haber"), "ord").limit(most).collect()]


def read_sitemaps(spark: SparkSession, path: str, local: Callable[[str], str] = str) -> DataFrame:
    """(loc, lastmod) of a sitemap, or of an index's children, one level deep. ``local`` tells where the file of an address is."""
    children = read_sitemap_index(spark, path)
    return read_sitemap(spark, [local(c) for c in children]) if children else read_sitemap(spark, path)


@F.pandas_udf(StringType())
def decoded(bodies: pd.Series, charsets: pd.Series) -> pd.Series:
    """Text of the bytes of a page: UTF-8 where that is what they are; else in the charset the server named, the Turkish one where it named none, one that doesn't
    exist or the default of servers (ISO-8859-1). Bytes without meaning become U+FFFD; NULL gives NULL."""

    def one(body: bytes | None, charset: str | None) -> str | None:
        if body is None:
            return None
        for name in ("utf-8", None if (charset or "").lower() in ("", "iso-8859-1") else charset):
            try:
                if name:
                    return bytes(body).decode(name)
            except (UnicodeDecodeError, LookupError):
                pass
        return bytes(body).decode("cp1254", "replace")

    return pd.Series([one(b, c) for b, c in zip(bodies, charsets)], dtype=object)


def links_of(page: Column) -> Column:
    """ARRAY<STRING> of the addresses of a page's anchors, in order."""
    return F.regexp_extract_all(page, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']?([^"'>\s]+)"""), F.lit(1))


def meta(page: Column, *names: str) -> Column:
    """Content of the first of the meta tags ``names`` (property, name or itemprop) that has any."""
    found = []
    for n in names:
        tag = rf"""(?is)<meta\b(?=[^>]*\b(?:property|name|itemprop)\s*=\s*["']{n}["'])[^>]*\bcontent\s*=\s*["']([^"']+)["']"""
        found.append(F.nullif(F.trim(F.regexp_extract(page, tag, 1)), F.lit("")))
    return F.coalesce(*found)


def ld_json(page: Column, field: str) -> Column:
    """A text field of the last NewsArticle of a page's JSON-LD scripts, else of the first script; NULL if none is readable."""
    scripts = F.regexp_extract_all(page, F.lit(r"""(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"""), F.lit(1))
    clean = F.transform(scripts, lambda s: F.regexp_replace(s, r"[\x00-\x1f]", " "))
    news = F.filter(clean, lambda s: F.get_json_object(s, "$.@type") == "NewsArticle")
    best = F.coalesce(F.try_element_at(news, F.lit(-1)), F.try_element_at(clean, F.lit(1)))
    return F.get_json_object(best, f"$.{field}")


def headline(page: Column) -> Column:
    """JSON-LD headline, og:title or twitter:title, h1."""
    h1 = F.regexp_replace(F.regexp_extract(page, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", "")
    return F.coalesce(*[F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit("")) for c in (ld_json(page, "headline"), meta(page, "og:title", "twitter:title"), h1)])
