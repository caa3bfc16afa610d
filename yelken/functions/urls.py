"""Address scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_url(href: Column, base: Column) -> Column:
    """Absolute address on the site of ``base`` (https://host) or NULL: other hosts, other schemes, script and mail links, NULL.
    Doubled and final slashes, parameters, query and fragment go; the host is compared without case and www."""
    host = F.regexp_extract(base, r"^(?i:https?)://([^/?#]+)", 1)
    bare = lambda h: F.regexp_replace(F.lower(h), r"^www\.", "")
    h = F.trim(href)
    absolute = (
        F.when(h.rlike(r"^(?i:javascript:|mailto:|tel:|#)") | (h == ""), None)
        .when(h.rlike(r"^(?i:https?)://"), h)
        .when(h.startswith("//"), F.concat(F.lit("https:"), h))
        .when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), None)
        .when(h.startswith("/"), F.concat(F.lit("https://"), host, h))
        .otherwise(F.concat(F.lit("https://"), host, F.lit("/"), h))
    )
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(absolute, r"^(?i:https?)://[^/?#]+", ""), r"[?#;].*$", ""), "/{2,}", "/")
    path = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/$", ""))
    own = bare(F.regexp_extract(absolute, r"^(?i:https?)://([^/?#]+)", 1)) == bare(host)
    return F.when(own, F.concat(F.lit("https://"), host, path))


def article_id(url: Column, pattern: str = r"/(?:haber|foto|video)/(\d{5,})") -> Column:
    """Number of an article: the pattern's group, else the first run of four digits or more in the path, else 0."""
    path = F.regexp_replace(url, r"^(?i:https?)://[^/?#]+", "")
    number = lambda p, g: F.regexp_extract(path, p, g).try_cast("bigint")
    return F.coalesce(number(pattern, 1), number(r"\d{4,}", 0), F.lit(0).cast("bigint"))


ARTICLE = r"^/(?:haber|foto|video)/\d{5,}/[a-z0-9-]+$"


def path_of(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^(?i:https?)://[^/?#]+", ""), r"[?#].*$", "")


def is_article(url: Column, pattern: str = ARTICLE) -> Column:
    """Whether the path of ``url`` matches a site's pattern; NULL for NULL."""
    return path_of(url).rlike(pattern)


def cache_key(query: Column) -> Column:
    """Key of a lookup: Turkish lower case, one blank."""
    return F.trim(F.regexp_replace(F.lower(F.translate(query, "Iİ", "ıi")), r"(?U)\s+", " "))
