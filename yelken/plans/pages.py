"""Queries on pages, addresses and text cleaning."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from yelken.functions import text, urls
from yelken.operators import timestamps
from yelken.plans.registry import CLEAN, EDGES, LOWER, NORMAL, ONE, PAGES, Registry, news
from yelken.session import table
from yelken.sources import feeds, pages

query = Registry()
PUBLISHERS = "gazete|haber|yaka|asayiş|son dakika|postası|ekspres|bülteni"
_CLEAN = CLEAN.format(NORMAL.format("line"))
_LOW = EDGES.format(LOWER.format("v"))
_KEY = EDGES.format(LOWER.format(NORMAL.format("coalesce(title, '')")))
_AGENCY = ", ".join(f"'{a}'" for a in text.AGENCIES)
_NOISE = f"(low = '' OR low IN ({_AGENCY}) OR (k <> '' AND low = k) OR regexp_matches(low, '{text.NOISE_LINE}') OR len(string_split_regex(low, '[\\s\\p{{Z}}]+')) < {text.LEAST_WORDS})"


def lines_sql(name: str, key: str, source: str, column: str) -> str:
    """CTEs <name>_n: (key, pos, v, lv, noise) of the cleaned lines of a text, and <name>: (key, cleaned)."""
    split = f"string_split_regex(regexp_replace(coalesce({column}, ''), '([.!?])\\s{{2,}}', '\\1' || chr(10), 'g'), '\\n+')"
    return f"""{name}_s AS (SELECT {key}, {_KEY} AS k, unnest({split}) AS line, generate_subscripts({split}, 1) AS pos FROM {source}),
 {name}_c AS (SELECT {key}, k, pos, {_CLEAN} AS v FROM {name}_s), {name}_l AS (SELECT *, {_LOW} AS low, {LOWER.format("v")} AS lv FROM {name}_c),
 {name}_n AS (SELECT *, {_NOISE} AS noise FROM {name}_l),
 {name}_f AS (SELECT *, row_number() OVER (PARTITION BY {key}, lv ORDER BY pos) AS again FROM {name}_n WHERE NOT noise),
 {name} AS (SELECT {key}, coalesce(string_agg(v, chr(10) ORDER BY pos) FILTER (WHERE again = 1), '') AS cleaned FROM {name}_f GROUP BY 1)"""


@query(f"WITH {lines_sql('c', 'id', ONE, 'content')} SELECT id, coalesce(cleaned, '') AS cleaned FROM (SELECT DISTINCT id FROM news) LEFT JOIN c USING (id)")
def clean_lines(spark, d):
    return news(spark, d, "title", "content").select("id", text.clean_lines(F.col("content"), F.col("title")).alias("cleaned"))


@query(f"WITH {lines_sql('c', 'id', ONE, 'content')} SELECT id, count(*) FILTER (WHERE noise) AS noise, count(*) FILTER (WHERE NOT noise) AS story FROM c_n GROUP BY 1")
def noise_line_stats(spark, d):
    lines = F.explode(F.split(text.normalize_unicode(F.coalesce("content", F.lit(""))), r"\n+|(?<=[.!?])\s{2,}"))
    rows = news(spark, d, "title", "content").select("id", text.title_key(F.col("title")).alias("k"), lines.alias("line"))
    noise = text.noise_line(F.trim(text.one_blank(text.allowed_characters(F.col("line")))), F.col("k"))
    return rows.groupBy("id").agg(F.count_if(noise).alias("noise"), F.count_if(~noise).alias("story"))


@query(f"WITH {lines_sql('c', 'id', ONE, 'content')} SELECT id, pos::INT AS pos, v AS line FROM c_f WHERE again > 1")
def dedup_lines(spark, d):
    """The repeats that cleaning drops."""
    lines = F.posexplode(F.split(text.normalize_unicode(F.coalesce("content", F.lit(""))), r"\n+|(?<=[.!?])\s{2,}")).alias("at", "line")
    rows = news(spark, d, "title", "content").select("id", text.title_key(F.col("title")).alias("k"), lines)
    v = F.trim(text.one_blank(text.allowed_characters(F.col("line"))))
    kept = rows.withColumn("line", v).where(~text.noise_line(F.col("line"), F.col("k"))).withColumn("lv", text.turkish_lower(F.col("line")))
    again = F.row_number().over(W.partitionBy("id", "lv").orderBy("at"))  # lines of one story
    return kept.withColumn("again", again).where("again > 1").select("id", (F.col("at") + 1).alias("pos"), "line")


_TEXT = f"""WITH {lines_sql('a', 'raw_id', PAGES, 'ld_body')}, {lines_sql('b', 'raw_id', PAGES, 'description')},
 t AS (SELECT raw_id, coalesce(a.cleaned, '') AS body, coalesce(b.cleaned, '') AS lead FROM (SELECT DISTINCT raw_id FROM raw_articles) LEFT JOIN a USING (raw_id) LEFT JOIN b USING (raw_id))
 SELECT raw_id, trim(CASE WHEN lead = '' OR contains({LOWER.format('body')}, left({LOWER.format('lead')}, {text.LEAD_SEEN})) THEN body WHEN body = '' THEN lead ELSE lead || chr(10) || body END) AS story,
 length(story) >= {text.LEAST_STORY} AS enough FROM t"""


@query(_TEXT)
def article_text(spark, d):
    """Stories of structured data and summary alone, and whether they are long enough; ``page_text`` takes the pages in."""
    rows = table(spark, d, "raw_articles").dropDuplicates(["raw_id"])
    made = text.article_text(F.col("title"), F.lit(None).cast("array<string>"), F.col("ld_body"), F.col("description"))
    return rows.select("raw_id", made.alias("story")).withColumn("enough", F.length("story") >= text.LEAST_STORY)


@query()
def page_text(spark, d):
    """Stories of whole pages; HTML trees are beyond SQL."""
    rows = table(spark, d, "raw_articles").dropDuplicates(["raw_id"])
    return rows.select("raw_id", text.article_text(F.col("title"), pages.lines_of(F.col("body_html")), F.col("ld_body"), F.col("description")).alias("story"))


@query()
def page_bodies(spark, d):
    rows = table(spark, d, "raw_articles").dropDuplicates(["raw_id"])
    return rows.select("raw_id", F.array_join(pages.body_lines(F.col("body_html")), "\n").alias("body"))


_TITLE_TAG = "trim(regexp_replace(regexp_replace(regexp_extract({0}, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))"
_CUT = "CASE WHEN len(string_split_regex(t, ' [-|–] ')) > 1 AND regexp_matches(string_split_regex(t, ' [-|–] ')[-1], '(?i)" + PUBLISHERS + "') THEN array_to_string(string_split_regex(t, ' [-|–] ')[:-2], ' - ') ELSE array_to_string(string_split_regex(t, ' [-|–] '), ' - ') END"


@query(
    f"""WITH h AS (SELECT raw_id, trim(regexp_replace(coalesce(nullif({_TITLE_TAG.format('body_html')}, ''), title), '\\s+', ' ', 'g')) AS t,
 len(regexp_extract_all(body_html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*["'']?([^"''>\\s]+)'))::INT AS n_links FROM {PAGES}) SELECT raw_id, {_CUT} AS title, n_links FROM h"""
)
def page_titles(spark, d):
    rows = table(spark, d, "raw_articles").dropDuplicates(["raw_id"])
    return rows.select("raw_id", text.clean_title(F.coalesce(feeds.headline(F.col("body_html")), "title"), PUBLISHERS).alias("title"), F.size(feeds.links_of(F.col("body_html"))).alias("n_links"))


@query(
    """SELECT id, title, content AS body, left(content, 80) AS description, coalesce(nullif(regexp_replace(url, '/$', ''), ''), url) AS address, CAST(floor(epoch(created_at)) AS BIGINT) AS utc_sec FROM (SELECT DISTINCT ON (id) * FROM news)
 WHERE title IS NOT NULL AND content IS NOT NULL AND NOT regexp_matches(title || left(content, 80), '["''<>&]') AND title = trim(regexp_replace(title, '\\s+', ' ', 'g')) AND trim(left(content, 80)) = left(content, 80)"""
)
def page_fields(spark, d):
    """Round trip: pages are made of stories, with structured data in a graph, metadata, canonical address and time, and read back."""
    plain = ~F.concat("title", F.left("content", F.lit(80))).rlike("[\"'<>&]") & (F.col("title") == F.trim(F.regexp_replace("title", r"\s+", " "))) & (F.trim(F.left("content", F.lit(80))) == F.left("content", F.lit(80)))
    rows = news(spark, d, "title", "content", "url", "created_at", "site_name").where("title is not null and content is not null").where(plain).join(table(spark, d, "sites").select("site_name", "base_url"), "site_name")
    story = F.struct(F.lit("NewsArticle").alias("@type"), F.col("title").alias("headline"), F.col("content").alias("articleBody"), timestamps.iso_text(F.col("created_at")).alias("datePublished"))
    graph = F.to_json(F.struct(F.array(F.struct(F.lit("Organization").alias("@type"), F.lit("x").alias("headline"), F.lit("").alias("articleBody"), F.lit("").alias("datePublished")), story).alias("@graph")))
    page = F.concat(
        F.lit("<html><head><link rel='canonical' href='"), "url", F.lit("/?utm=1'><meta content=\""), F.left("content", F.lit(80)), F.lit('" property="og:description"><script type="application/ld+json">'), graph, F.lit("</script></head><body><h1>other</h1></body></html>"),
    )
    made = rows.select("id", "url", "base_url", page.alias("page")).withColumn("ld", pages.story(F.col("page")))
    return made.select(
        "id", F.col("ld.headline").alias("title"), F.col("ld.articleBody").alias("body"), F.coalesce("ld.description", feeds.meta(F.col("page"), "og:description", "description")).alias("description"),
        pages.canonical(F.col("page"), F.col("base_url"), F.lit("none"), "^/").alias("address"), pages.published(F.col("page"), F.col("ld"), F.lit(None).cast("string"), F.lit("UTC")).alias("utc_sec"),
    )


_ART = "coalesce(try_cast(nullif(regexp_extract(url, '/(?:haber|foto|video)/(\\d{5,})', 1), '') AS BIGINT), try_cast(nullif(regexp_extract(regexp_replace(url, '^https?://[^/?#]+', ''), '\\d{4,}'), '') AS BIGINT), 0)"


@query(
    f"""WITH l AS (SELECT site_name, url, min(first_seen) AS seen FROM processed_urls WHERE site_name IS NOT NULL AND regexp_matches(regexp_replace(regexp_replace(url, '^https?://[^/?#]+', ''), '[?#].*$', ''), '^/(?:haber|foto|video)/\\d{{5,}}/[a-z0-9-]+$') GROUP BY 1, 2)
 SELECT site_name, url, {_ART} AS article, row_number() OVER (PARTITION BY site_name ORDER BY {_ART} DESC, seen, url) AS place FROM l"""
)
def latest_links(spark, d):
    """Article links of each site, the newest number first. The order is asked for, so every site is ranked; see ``relational.ranked`` for how."""
    from yelken.operators.relational import ranked

    rows = table(spark, d, "processed_urls").where(F.col("site_name").isNotNull() & urls.is_article(F.col("url")))
    one = rows.groupBy("site_name", "url").agg(F.min("first_seen").alias("seen")).withColumn("article", urls.article_id(F.col("url")))
    return ranked(one, "site_name", [F.desc("article"), F.col("seen"), F.col("url")], "place").select("site_name", "url", "article", "place")


@query("SELECT id, CASE WHEN regexp_matches(trim(published_at), '^\\d{4}-\\d{2}-\\d{2}$') THEN try_cast(trim(published_at) AS DATE) END AS day, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created FROM (SELECT DISTINCT ON (id) * FROM news)")
def lenient_dates(spark, d):
    return news(spark, d, "published_at", "created_at").select("id", timestamps.iso_date(F.col("published_at")).alias("day"), timestamps.iso_text(F.col("created_at")).alias("created"))


@query("SELECT id, coalesce(title, '') || '. ' || left(coalesce(content, ''), 1200) AS embedded FROM (SELECT DISTINCT ON (id) * FROM news)")
def embedding_texts(spark, d):
    from yelken.operators.nearest import embedding_text

    return news(spark, d, "title", "content").select("id", embedding_text(F.col("title"), F.col("content")).alias("embedded"))
