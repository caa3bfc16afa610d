"""Queries that serve lists, counts and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from yelken.operators import classify as C
from yelken.operators import serving
from yelken.plans.registry import ONE, Registry, news
from yelken.session import table

query = Registry()
ZONE = "Europe/Istanbul"
DISTRICTS = ("Akçasu", "Çamlıyaka", "Demirağaç", "Gökpınarlı", "Ihlamurcuk", "İncirözü", "Öztepeli", "Sarıköprü", "Şafakören", "Taşlıova", "Ulukışık", "Yeldere")
TYPES = tuple(C.PRIORITY)
#: Stories with the time they are listed by. Published times are texts in many forms here; the time of storing stands in for them.
_COLS = ("type", "title", "district", "lat", "lng", "created_at", "site_name", "sources", "location_text", "url")
_RANGE = "created_at >= CAST(timezone('UTC', timezone('Europe/Istanbul', TIMESTAMP '{0} 00:00:00')) AS TIMESTAMP) AND created_at < CAST(timezone('UTC', timezone('Europe/Istanbul', TIMESTAMP '{1} 00:00:00')) AS TIMESTAMP)"
_SHOWN = "lat IS NOT NULL AND lng IS NOT NULL"


def _filtered(spark, d, **args):
    return serving.filtered(news(spark, d, *_COLS), all_types=TYPES, districts=DISTRICTS, zone=ZONE, at="created_at", **args)


@query(f"SELECT id, type, district, title FROM {ONE} WHERE {_SHOWN} AND type IN ('yangin', 'hirsizlik') AND district = 'Yeldere' ORDER BY created_at DESC, id LIMIT 500")
def list_recent(spark, d):
    return serving.latest(_filtered(spark, d, types=["yangin", "hirsizlik", "unknown"], district=" Yeldere "), at="created_at").select("id", "type", "district", "title")


@query(f"SELECT id, type FROM {ONE} WHERE {_SHOWN} AND {_RANGE.format('2016-03-01', '2016-06-01')}")
def local_day_filter(spark, d):
    return _filtered(spark, d, start="2016-03-01", end="2016-05-31").select("id", "type")


@query(f"SELECT id FROM {ONE} WHERE {_SHOWN} AND created_at >= CAST(timezone('UTC', timezone('Europe/Istanbul', TIMESTAMP '2016-09-01 00:00:00')) AS TIMESTAMP)")
def open_range_filter(spark, d):
    """A bad end day is left out of account."""
    return _filtered(spark, d, start="2016-09-01", end="31.12.2016", district="").select("id")


@query(f"SELECT id FROM {ONE} WHERE false")
def empty_type_filter(spark, d):
    return _filtered(spark, d, types=["unknown"]).select("id")


@query(f"SELECT id, title, content FROM {ONE} WHERE id = (SELECT max(id) FROM news)")
def point_lookup(spark, d):
    newest = table(spark, d, "news").agg(F.max("id")).first()[0]  # one value
    return serving.point(table(spark, d, "news"), "id", newest).select("id", "title", "content")


_DIM = ", ".join(f"('{t}')" for t in TYPES)


@query(f"WITH t(type) AS (VALUES {_DIM}), n AS (SELECT type FROM {ONE} WHERE {_SHOWN} AND district = 'Yeldere' AND {_RANGE.format('2016-06-01', '2016-07-01')}) SELECT t.type, count(n.type) AS n, sum(count(n.type)) OVER ()::BIGINT AS total FROM t LEFT JOIN n USING (type) GROUP BY 1")
def stats_zero_filled(spark, d):
    dim = spark.createDataFrame([(t,) for t in TYPES], "type string")
    return serving.counts_by_type(_filtered(spark, d, district="Yeldere", start="2016-06-01", end="2016-06-30"), dim)


@query("SELECT site_name, unnest(arg_max({'updated_at': updated_at, 'status': status, 'url': url}, (updated_at, status, url))) FROM processed_urls WHERE updated_at IS NOT NULL AND status IS NOT NULL GROUP BY 1")
def last_run(spark, d):
    rows = table(spark, d, "processed_urls").where("updated_at is not null and status is not null")
    return serving.last_of(rows, ["site_name"], "updated_at", "updated_at", "status", "url")


@query(f"SELECT id, type, title, array_to_string([s.site_name for s in sources], ', ') AS sites, strftime(created_at, '%d.%m.%Y %H:%M') AS at_text, coalesce(location_text, '-') AS place, lat, lng FROM {ONE} WHERE {_SHOWN} ORDER BY created_at DESC, id LIMIT 20")
def recent_traces(spark, d):
    return serving.trace(news(spark, d, *_COLS), 20)


@query(f"SELECT id FROM {ONE} WHERE CAST(timezone('Europe/Istanbul', timezone('UTC', created_at)) AS DATE) BETWEEN DATE '2016-11-30' - 6 AND DATE '2016-11-30'")
def last_seven_days(spark, d):
    first, last = serving.last_days(F.lit("2016-11-30").cast("date"), 7)
    day = F.from_utc_timestamp(F.col("created_at").cast("timestamp"), ZONE).cast("date")
    return news(spark, d, "created_at").where(day.between(first, last)).select("id")


@query("SELECT n.id FROM (SELECT DISTINCT id FROM news) n WHERE NOT EXISTS (SELECT 1 FROM processed_urls p WHERE p.news_id = n.id AND p.status = 'saved')")
def stories_without_ledger(spark, d):
    saved = table(spark, d, "processed_urls").where("status = 'saved'").select(F.col("news_id").alias("id")).where("id is not null")
    return serving.without(news(spark, d), saved)


@query(
    """SELECT 'source_of_two_stories' AS rule, count(*) AS n FROM (SELECT u FROM (SELECT DISTINCT id, unnest(sources).url AS u FROM news) WHERE u IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
 UNION ALL SELECT 'ledger_address_twice', count(*) FROM (SELECT url FROM processed_urls GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'cache_key_twice', count(*) FROM (SELECT site_name, base_url FROM sites GROUP BY ALL HAVING count(*) > 1)"""
)
def invariants(spark, d):
    cache = table(spark, d, "sites").select(F.col("site_name").alias("provider"), F.col("base_url").alias("key"))
    return serving.invariant_breaks(table(spark, d, "news"), table(spark, d, "processed_urls"), cache)


_KW = ", ".join(f"('{c}', '{w}', {n}, {k})" for c, w, n, k in C.keyword_rows())


@query(f"WITH kw(category, keyword, weight, ord) AS (VALUES {_KW}) SELECT category, weight, replace(category, '_', '\\_') || ' & ' || weight || ' & ' || string_agg(rtrim(keyword, '$'), ', ' ORDER BY ord) || ' \\\\' AS line FROM kw GROUP BY category, weight")
def keyword_latex(spark, d):
    return serving.latex_rows(spark.createDataFrame(C.keyword_rows(), "category string, keyword string, weight int, ord int"))


@query(
    f"""SELECT id, title, type, site_name, url, district, location_text, lat, lng, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created, len(sources)::INT AS n_sources,
 array_to_string([coalesce(s.site_name, '') || '|' || coalesce(s.url, '') || '|' || printf('%.4f', s.similarity) for s in sources], ' ') AS source_list FROM {ONE}"""
)
def serialize_news(spark, d):
    """The list form: written as JSON and read back, so the check sees what a reader of the JSON sees."""
    rows = news(spark, d, *_COLS)
    stamp = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    item = F.struct("id", "title", "type", "site_name", "url", "district", "location_text", "lat", "lng", stamp.alias("created"), F.transform("sources", lambda s: F.struct(s["site_name"].alias("site_name"), s["url"].alias("url"), s["similarity"].alias("similarity"))).alias("sources"))
    schema = "id string, title string, type string, site_name string, url string, district string, location_text string, lat double, lng double, created string, sources array<struct<site_name:string,url:string,similarity:double>>"
    back = rows.select(F.from_json(F.to_json(item), schema).alias("x")).select("x.*")
    listed = F.array_join(F.transform("sources", lambda s: F.concat_ws("|", F.coalesce(s["site_name"], F.lit("")), F.coalesce(s["url"], F.lit("")), F.format_string("%.4f", s["similarity"]))), " ")
    return back.withColumn("n_sources", F.size("sources")).withColumn("source_list", listed).drop("sources")
