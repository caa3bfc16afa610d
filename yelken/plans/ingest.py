"""Queries on the state between runs, on merging and on geocoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from yelken.functions import urls
from yelken.lexicon import COMPONENT_LEVELS, MAP_LEVELS
from yelken.operators import geocoding, ingest, nearest
from yelken.plans.registry import ONE, Registry, news
from yelken.session import table

query = Registry()
_SINCE = "2016-06-01"
_LEDGER = "(SELECT url, arg_max(status, (updated_at, attempts, status)) AS status, max(attempts) AS attempts, min(first_seen) AS published_at FROM processed_urls WHERE url IS NOT NULL AND status IS NOT NULL GROUP BY 1)"


def _ledger(spark, d):
    rows = table(spark, d, "processed_urls").where("url is not null and status is not null")
    return rows.groupBy("url").agg(F.max_by("status", F.struct("updated_at", "attempts", "status")).alias("status"), F.max("attempts").alias("attempts"), F.min("first_seen").alias("published_at"))


_LINKS = "(SELECT DISTINCT url FROM news_incoming UNION SELECT DISTINCT url FROM processed_urls UNION SELECT DISTINCT unnest(sources).url FROM news)"


@query(
    f"""SELECT l.url, CASE WHEN l.url IS NULL OR l.url IN (SELECT unnest(sources).url FROM news WHERE sources IS NOT NULL) THEN false WHEN p.status IS NULL THEN true
 WHEN p.status IN ('saved', 'merged', 'no_category', 'not_local', 'no_location', 'geocode_failed', 'no_date') THEN false WHEN p.status = 'out_of_range' THEN coalesce(p.published_at >= TIMESTAMP '{_SINCE}', false)
 WHEN p.status IN ('fetch_failed', 'parse_failed') THEN coalesce(p.attempts, 0) < 3 ELSE true END AS fetch FROM {_LINKS} l LEFT JOIN {_LEDGER} p ON p.url = l.url"""
)
def should_fetch(spark, d):
    links = table(spark, d, "news_incoming").select("url").union(table(spark, d, "processed_urls").select("url")).union(table(spark, d, "news").select(F.explode("sources.url"))).distinct()
    return ingest.should_fetch(links, _ledger(spark, d), table(spark, d, "news").select("sources"), F.lit(_SINCE).cast("timestamp_ntz")).select("url", "fetch")


_P = "(SELECT DISTINCT raw_id, url, discovered_url FROM raw_articles)"


@query(f"SELECT raw_id, url AS marked, NULL::VARCHAR AS canonical_url FROM {_P} WHERE url IS NOT NULL UNION ALL SELECT raw_id, discovered_url, url FROM {_P} WHERE discovered_url IS NOT NULL AND (url IS NULL OR discovered_url <> url)")
def marked_addresses(spark, d):
    rows = table(spark, d, "raw_articles").select("raw_id", "url", "discovered_url").distinct()
    return ingest.mark_both(rows).select("raw_id", "marked", "canonical_url")


@query(
    """SELECT url, CASE WHEN status IN ('fetch_failed', 'no_date') THEN status WHEN first_seen < TIMESTAMP '2015-06-01' THEN 'out_of_range' WHEN length(url) < 60 THEN 'parse_failed' WHEN type IS NULL THEN 'no_category'
 WHEN NOT coalesce(local_score >= foreign_score, false) THEN 'not_local' WHEN status = 'merged' THEN 'merged' WHEN local_score = 0 THEN 'no_location' WHEN status = 'geocode_error' THEN 'geocode_error' WHEN news_id IS NULL THEN 'geocode_failed' ELSE 'saved' END AS decided, count(*) AS n
 FROM processed_urls WHERE local_score IS NOT NULL GROUP BY ALL"""
)
def decision_status(spark, d):
    rows = table(spark, d, "processed_urls").where("local_score is not null")
    c, s = F.col, F.col("status")
    decided = ingest.outcome(F.lit("2015-06-01").cast("timestamp_ntz"), c("first_seen"), F.when(s.isin("fetch_failed", "no_date"), s), F.length("url"), c("type"), c("local_score") >= c("foreign_score"), s == "merged", c("local_score"), s == "geocode_error", c("news_id").isNotNull())
    return rows.groupBy("url", decided.alias("decided")).agg(F.count("*").alias("n"))


@query(
    """SELECT site_name, count(*) AS links_found, count(*) FILTER (WHERE attempts > 1) AS skipped_known, count(*) FILTER (WHERE status = 'out_of_range') AS skipped_old, count(*) FILTER (WHERE status NOT IN ('out_of_range', 'fetch_failed')) AS fetched,
 count(*) FILTER (WHERE status IN ('fetch_failed', 'parse_failed')) AS errors FROM processed_urls GROUP BY 1"""
)
def site_report(spark, d):
    s = F.col("status")
    return ingest.site_report(table(spark, d, "processed_urls"), "site_name", F.col("attempts") > 1, s == "out_of_range", ~s.isin("out_of_range", "fetch_failed"), s.isin("fetch_failed", "parse_failed"))


_NEAR = """q AS (SELECT id, any_value(epoch(published_at)) AS t, any_value(embedding)::DOUBLE[] AS v, any_value(site_name) AS site_name, any_value(url) AS url FROM news_incoming GROUP BY 1),
 h AS (SELECT id, any_value(epoch(created_at)) AS t, any_value(embedding)::DOUBLE[] AS v FROM news GROUP BY 1),
 m AS (SELECT q.id, h.id AS other, list_cosine_similarity(q.v, h.v) AS s FROM q JOIN h ON len(q.v) = len(h.v) AND abs(q.t - h.t) <= 259200),
 best AS (SELECT id, min_by(other, (-s, other)) AS best, max(s) AS s FROM m GROUP BY 1)"""


def _nearest(spark, d):
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    asked = table(spark, d, "news_incoming").dropDuplicates(["id"]).select(F.col("id").alias("key"), seconds("published_at").alias("at"), F.col("embedding").alias("vec"))
    held = news(spark, d, "created_at", "embedding").select(F.col("id").alias("key"), seconds("created_at").alias("at"), F.col("embedding").alias("vec"))
    return nearest.nearest_in_window(asked, held, 3 * 86_400)


@query(f"WITH {_NEAR} SELECT q.id AS key, CASE WHEN s >= 0.9 THEN best END AS duplicate_of, round(coalesce(s, 0), 4) AS similarity FROM q LEFT JOIN best USING (id)")
def find_duplicates(spark, d):
    """Window and best match together: the stored story a new one repeats, else NULL with the best similarity there was."""
    return _nearest(spark, d).select("key", F.when(F.col("similarity") >= 0.9, F.col("best")).alias("duplicate_of"), F.round("similarity", 4).alias("similarity"))


@query(
    f"""WITH {_NEAR}, f AS (SELECT best.best AS id, q.site_name, q.url, round(s, 4) AS sim, q.id AS ord FROM q JOIN best USING (id) WHERE s >= 0.6), n AS (SELECT DISTINCT ON (id) id, sources FROM news),
 g AS (SELECT f.*, row_number() OVER (PARTITION BY f.id, f.site_name ORDER BY ord, f.url) AS r FROM f JOIN n USING (id) WHERE NOT coalesce(list_contains([s.url for s in n.sources], f.url), false) AND NOT coalesce(list_contains([s.site_name for s in n.sources], f.site_name), false))
 SELECT id, string_agg(site_name || '|' || url || '|' || printf('%.4f', sim), ' ' ORDER BY ord) AS added, count(*)::INT AS n_added FROM g WHERE r = 1 GROUP BY 1"""
)
def merge_sources(spark, d):
    """Sources that near stories add; the threshold is lower than that of duplicates, so that small tables have some."""
    incoming = table(spark, d, "news_incoming").dropDuplicates(["id"]).select(F.col("id").alias("ord"), "site_name", "url")
    found = _nearest(spark, d).where("similarity >= 0.6").select(F.col("key").alias("ord"), F.col("best").alias("id"), "similarity").join(incoming, "ord")
    added = ingest.new_sources(news(spark, d, "sources"), found)
    text = F.array_join(F.transform("added", lambda x: F.concat_ws("|", x["site_name"], x["url"], F.format_string("%.4f", x["similarity"]))), " ")
    return added.select("id", text.alias("added"), F.size("added").alias("n_added"))


def _reclassified(spark, d):
    from yelken.operators import classify as C

    stories = news(spark, d, "type", "title", "content", "sources", "site_name")
    # stories whose text says nothing of a category lose their type
    new = C.classify(stories, "id", "title", "content").select("id", "category")
    return ingest.reclassified(stories, new)


def register_scores(scores: str) -> None:
    """Queries whose SQL builds on the SQL of keyword scores."""

    @query(scores + "SELECT coalesce(category, '-') AS category, count(*) AS n FROM cls GROUP BY 1")
    def type_distribution(spark, d):
        from yelken.operators import classify as C

        return C.classify(news(spark, d, "title", "content"), "id", "title", "content").groupBy(F.coalesce("category", F.lit("-")).alias("category")).agg(F.count("*").alias("n"))

    @query(scores + f"SELECT n.id, cls.category AS type, n.type IS DISTINCT FROM cls.category AS changed FROM {ONE} n JOIN cls USING (id) WHERE cls.category IS NOT NULL")
    def reclassify_apply(spark, d):
        return _reclassified(spark, d)[0].select("id", "type", "changed")

    @query(scores + f"SELECT DISTINCT s.url, s.site_name FROM (SELECT unnest(n.sources) AS s FROM {ONE} n JOIN cls USING (id) WHERE cls.category IS NULL)")
    def reclassify_ledger(spark, d):
        return _reclassified(spark, d)[1]


_OWN = "Kartalya"
_LEVEL = "(length(coalesce(location_text, '')) % 6)"


@query(
    f"""SELECT id, CASE WHEN lat IS NULL OR lng IS NULL THEN 'none' WHEN NOT (lat BETWEEN 39.0 AND 39.3 AND lng BETWEEN 31.0 AND 31.4) THEN 'outside' WHEN type = 'yangin' AND length(title) % 7 = 0 THEN 'province'
 WHEN trim(district) <> '' AND length(title) % 5 = 0 THEN 'district' WHEN length(title) % 4 >= 2 AND {_LEVEL} < 2 THEN 'general' WHEN {_LEVEL} < 1 THEN 'province_level' END AS reason FROM {ONE}"""
)
def geocode_validate(spark, d):
    """All reasons to refuse an answer, over answers made of stories."""
    rows = news(spark, d, "lat", "lng", "type", "title", "district", "location_text")
    n = F.length("title")
    province = F.when((F.col("type") == "yangin") & (n % 7 == 0), "Bursa").otherwise("KARTALYA")
    other = F.when(n % 5 == 0, "Başka").otherwise(F.upper("district"))
    same = F.when(n % 5 == 0, F.trim("district")).otherwise(F.lit(None))
    level = F.length(F.coalesce("location_text", F.lit(""))) % 6
    reason = geocoding.refusal(F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.col("lat"), F.col("lng"), province, other, level, n % 4, same, (39.0, 31.0, 39.3, 31.4), _OWN)
    return rows.select("id", reason.alias("reason"))


_KEY = "trim(regexp_replace(lower(replace(replace(location_text, 'I', 'ı'), 'İ', 'i')), '[\\s\\p{Z}]+', ' ', 'g'))"


@query(
    f"""WITH c AS (SELECT {_KEY} AS key, min(id) AS answer FROM {ONE} WHERE location_text IS NOT NULL AND length({_KEY}) % 3 < 2 GROUP BY 1)
 SELECT n.id, c.key IS NOT NULL AS cached, CASE WHEN length(c.key) % 3 = 0 THEN c.answer END AS answer FROM {ONE} n LEFT JOIN c ON c.key = {_KEY} WHERE n.location_text IS NOT NULL"""
)
def cached_lookup(spark, d):
    """Lookups with known misses: a third of the keys are answered, a third are known to have no answer, the rest isn't cached."""
    rows = news(spark, d, "location_text").where("location_text is not null")
    key = urls.cache_key(F.col("location_text"))
    cache = rows.withColumn("key", key).where(F.length("key") % 3 < 2).groupBy("key").agg(F.min("id").alias("first"))
    cache = cache.select(F.lit("map").alias("provider"), "key", F.when(F.length("key") % 3 == 0, F.col("first")).alias("answer"))
    return geocoding.looked_up(rows.withColumnRenamed("location_text", "query"), cache, "map").select("id", "cached", "answer")


_TYPES = [t for kinds in COMPONENT_LEVELS.values() for t in kinds.split()]
_MAP_TYPES = [t for kinds in MAP_LEVELS.values() for t in kinds.split()]
_case = lambda levels, c: "CASE " + " ".join(f"WHEN {c} IN ({', '.join(repr(k) for k in kinds.split())}) THEN {level}" for level, kinds in levels.items())


@query(
    f"""SELECT id, CASE WHEN length(title) % 11 = 0 THEN 'none' WHEN length(title) % 13 = 0 THEN 'unavailable' ELSE 'ok' END AS state, CASE WHEN length(title) % 11 = 0 OR length(title) % 13 = 0 THEN 0 ELSE {_case(COMPONENT_LEVELS, f"([{', '.join(repr(t) for t in _TYPES)}])[1 + length(title) % {len(_TYPES)}]")} END END AS level,
 CASE WHEN length(title) % 11 <> 0 AND length(title) % 13 <> 0 THEN district END AS district FROM {ONE} WHERE title IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL"""
)
def component_answers(spark, d):
    """Replies in JSON made of stories and read back."""
    rows = news(spark, d, "title", "district", "lat", "lng").where("title is not null and lat is not null and lng is not null")
    n = F.length("title")
    types = F.array(F.lit("political"), F.get(F.array(*[F.lit(t) for t in _TYPES]), n % len(_TYPES)))
    part = lambda v, k: F.struct(v.alias("long_name"), F.array(F.lit(k)).alias("types"))
    result = F.struct(types.alias("types"), F.struct(F.struct("lat", "lng").alias("location")).alias("geometry"), F.array(part(F.lit(_OWN), "administrative_area_level_1"), part(F.col("district"), "administrative_area_level_2")).alias("address_components"))
    status = F.when(n % 11 == 0, "ZERO_RESULTS").when(n % 13 == 0, "OVER_QUERY_LIMIT").otherwise("OK")
    reply = F.to_json(F.struct(status.alias("status"), F.when(status == "OK", F.array(result)).alias("results")))
    return rows.select("id", geocoding.component_answer(reply).alias("x")).select("id", "x.state", "x.level", "x.district")


@query(
    f"""SELECT id, {_case(MAP_LEVELS, f"([{', '.join(repr(t) for t in [*_MAP_TYPES, 'fountain'])}])[1 + length(title) % {len(_MAP_TYPES) + 1}]")} ELSE 4 END AS level, CASE WHEN length(title) % 2 = 0 THEN '{_OWN}' ELSE 'Elsewhere' END AS province,
 coalesce(nullif(trim(district), ''), 'Ilçe') AS district FROM {ONE} WHERE title IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL AND district IN ('Yeldere', 'Akçasu', 'Taşlıova')"""
)
def map_answers(spark, d):
    rows = news(spark, d, "title", "district", "lat", "lng").where("title is not null and lat is not null and lng is not null and district in ('Yeldere', 'Akçasu', 'Taşlıova')")
    n, kinds = F.length("title"), [*_MAP_TYPES, "fountain"]
    address = F.struct(F.upper("district").alias("county"), F.lit("Merkez").alias("town"), F.when(n % 2 == 0, "TR-99").alias("ISO3166-2-lvl4"), F.lit("Elsewhere").alias("province"))
    item = F.to_json(F.struct(F.col("lat").cast("string").alias("lat"), F.col("lng").cast("string").alias("lon"), F.get(F.array(*[F.lit(k) for k in kinds]), n % len(kinds)).alias("addresstype"), address.alias("address")))
    answer = geocoding.map_answer(item, ("Yeldere", "Akçasu", "Taşlıova"), _OWN, "TR-99")
    return rows.select("id", answer.alias("x")).select("id", "x.level", "x.province", "x.district")


@query(
    """WITH q AS (SELECT o_orderkey AS k, l_linenumber AS r, l_returnflag = 'R' AS ok, l_linestatus = 'F' AND l_returnflag = 'N' AS bad FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
 w AS (SELECT k, min(r) FILTER (WHERE ok AND NOT bad) AS winner, min(r) FILTER (WHERE bad) AS broken FROM q GROUP BY 1)
 SELECT q.k AS o_orderkey, any_value(CASE WHEN broken IS NOT NULL AND (winner IS NULL OR broken < winner) THEN NULL ELSE winner END) AS winner, count(*) FILTER (WHERE least(winner, broken) IS NULL OR r <= least(winner, broken))::INT AS attempts,
 any_value(CASE WHEN broken IS NOT NULL AND (winner IS NULL OR broken < winner) THEN 'geocode_error' WHEN winner IS NULL THEN 'geocode_failed' ELSE 'saved' END) AS status FROM q JOIN w USING (k) GROUP BY 1"""
)
def geocode_outcomes(spark, d):
    q = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    bad = (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "N")
    state, reason = F.when(bad, "unavailable").otherwise("ok"), F.when(F.col("l_returnflag") != "R", "none")
    return geocoding.first_standing(q, "o_orderkey", "l_linenumber", state, reason)
