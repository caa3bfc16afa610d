"""Registry of the core queries and of the SQL they are checked with. Both sides read whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yelken.functions import text, urls
from yelken.operators import classify as C
from yelken.operators import geocoding, nearest, places, relational, serving
from yelken.plans import ingest, instants, pages
from yelken.plans import serving as served
from yelken.plans.registry import LOWER, NORMAL, Query, Registry
from yelken.plans.registry import news as _news
from yelken.session import table
from yelken.streaming import ledger

_query = Registry()

_VALUES = ", ".join(f"('{c}', '{w}', {n}, {k})" for c, w, n, k in C.keyword_rows())
_RANKS = ", ".join(f"('{c}', {p})" for c, p in C.PRIORITY.items())
_MATCH = (
    "trim(regexp_replace(replace(translate(lower(replace(replace(regexp_replace(translate(nfc_normalize(coalesce({0}, '')), "
    "'’‘ʼ`´' || chr(160) || chr(8201) || chr(8239), '''''''''''' || '   '), '[​-‏⁠﻿]', '', 'g'), 'I', 'ı'), 'İ', 'i')), 'âîû', 'aiu'), '''', ''), '[^0-9a-zçğıöşü]+', ' ', 'g'))"
)
_SCORES = f"""WITH kw(category, keyword, weight, ord) AS (VALUES {_VALUES}), ranks(category, rnk) AS (VALUES {_RANKS}),
 d AS (SELECT DISTINCT ON (id) id, ' ' || replace({_MATCH.format("title")}, ' ', '  ') || ' ' AS t, ' ' || replace({_MATCH.format("content")}, ' ', '  ') || ' ' AS b FROM news),
 k AS (SELECT *, CASE WHEN keyword LIKE '%$' THEN ' ' || replace(rtrim(keyword, '$'), ' ', '  ') || ' ' ELSE ' ' || replace(keyword, ' ', '  ') END AS f FROM kw),
 h AS (SELECT id, category, keyword, weight, least(3, (length(t) - length(replace(t, f, ''))) // length(f)) AS ht, least(3, (length(b) - length(replace(b, f, ''))) // length(f)) AS hb FROM d, k),
 s AS (SELECT id, category, sum(weight * (2 * ht + hb)) AS score, bool_or(weight >= 3 AND ht + hb > 0) AS anchored FROM h WHERE ht + hb > 0 GROUP BY 1, 2),
 e AS (SELECT *, max(score) OVER (PARTITION BY id) AS top FROM s WHERE anchored AND score >= 4),
 c AS (SELECT e.*, rnk, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY rnk) AS r FROM e JOIN ranks USING (category) WHERE score >= 0.6 * top),
 cls AS (SELECT d.id, c.category, c.score, c.n AS n_candidates FROM d LEFT JOIN c ON c.id = d.id AND r = 1)
"""


_ONE = "(SELECT DISTINCT ON (id) * FROM news)"


@_query(f"SELECT id, {_MATCH.format('title')} AS matching FROM {_ONE}")
def normalize_titles(spark, d):
    return _news(spark, d, "title").select("id", text.for_matching(F.col("title")).alias("matching"))


@_query(f"SELECT id, trim(translate({LOWER.format(NORMAL.format('content'))}, 'çğıöşüâîû', 'cgiosuaiu')) AS folded FROM {_ONE} WHERE content IS NOT NULL")
def ascii_fold_news(spark, d):
    return _news(spark, d, "content").where("content is not null").select("id", text.ascii_fold(F.col("content")).alias("folded"))


def _hits(spark, d):
    return C.keyword_hits(_news(spark, d, "title", "content"), "id", "title", "content")


@_query(_SCORES + "SELECT category, keyword, sum(hits)::BIGINT AS hits, count(DISTINCT id) AS stories FROM (SELECT id, category, rtrim(keyword, '$') AS keyword, ht + hb AS hits FROM h) WHERE hits > 0 GROUP BY 1, 2")
def keyword_matches(spark, d):
    return _hits(spark, d).groupBy("category", "keyword").agg(F.sum("hits").alias("hits"), F.countDistinct("id").alias("stories"))


@_query(_SCORES + "SELECT id, category, score::BIGINT AS score, anchored FROM s")
def keyword_scores(spark, d):
    return C.category_scores(_news(spark, d, "title", "content"), "id", "title", "content")


def _classified(spark, d):
    return C.classify(table(spark, d, "news").select("id", "title", "content"), "id", "title", "content")


@_query(_SCORES + "SELECT id, category, score::BIGINT AS score, n_candidates::INT AS n_candidates FROM cls")
def classify_news(spark, d):
    return _classified(spark, d)


@_query(_SCORES + "SELECT r.category, count(cls.id) AS n, sum(count(cls.id)) OVER ()::BIGINT AS total FROM ranks r LEFT JOIN cls USING (category) GROUP BY 1")
def category_stats(spark, d):
    dim = spark.createDataFrame(list(C.PRIORITY.items()), "type string, rnk int").select("type")
    found = _classified(spark, d).select(F.col("category").alias("type"))
    return serving.counts_by_type(found, dim).withColumnRenamed("type", "category")


_LABELS = """, w AS (SELECT d.id, k.category, rtrim(keyword, '$') AS word, ord, (length(t) - length(replace(t, f, ''))) // length(f) AS ht, (length(b) - length(replace(b, f, ''))) // length(f) AS hb FROM d, k),
 w1 AS (SELECT id, category, word, min(CASE WHEN ht > 0 THEN ord ELSE 1000 + ord END) AS o FROM w WHERE ht + hb > 0 GROUP BY 1, 2, 3), w2 AS (SELECT id, category, category || ': ' || string_agg(word, ', ' ORDER BY o) AS line FROM w1 GROUP BY 1, 2),
 w3 AS (SELECT id, string_agg(line, '; ' ORDER BY category) AS matched FROM w2 GROUP BY 1), s3 AS (SELECT d.id, string_agg(r.category || '=' || coalesce(s.score, 0), ' ' ORDER BY r.category) AS scores FROM d CROSS JOIN ranks r LEFT JOIN s ON s.id = d.id AND s.category = r.category GROUP BY 1)
"""


@_query(_SCORES + _LABELS + "SELECT s3.id, scores, coalesce(matched, '') AS matched FROM s3 LEFT JOIN w3 USING (id)")
def explain_news(spark, d):
    """The whole explanation: every category's score and the keywords found."""
    made = C.explain(_news(spark, d, "title", "content"), "id", "title", "content")
    scores = F.array_join(F.array_sort(F.transform("scores", lambda s: F.concat_ws("=", s["category"], s["score"].cast("string")))), " ")
    lines = F.array_sort(F.transform("matched", lambda m: F.concat(m["category"], F.lit(": "), F.array_join(m["keywords"], ", "))))
    return made.select("id", scores.alias("scores"), F.array_join(lines, "; ").alias("matched"))


@_query(_SCORES + "SELECT n.type AS old_type, cls.category AS new_type, count(*) AS n FROM (SELECT DISTINCT ON (id) id, type FROM news) n JOIN cls USING (id) WHERE n.type IS DISTINCT FROM cls.category GROUP BY 1, 2")
def reclassify_diff(spark, d):
    both = _news(spark, d, "type").join(_classified(spark, d), "id")
    return both.where(~F.col("type").eqNullSafe(F.col("category"))).groupBy(F.col("type").alias("old_type"), F.col("category").alias("new_type")).agg(F.count("*").alias("n"))


@_query(f"WITH kw(category, keyword, weight, ord) AS (VALUES {_VALUES}) SELECT category, weight, string_agg(rtrim(keyword, '$'), ', ' ORDER BY ord) AS keywords FROM kw GROUP BY 1, 2")
def keyword_report(spark, d):
    kw = spark.createDataFrame(C.keyword_rows(), "category string, keyword string, weight int, ord int")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "keyword"))), lambda x: F.rtrim(x["keyword"], F.lit("$")))
    return kw.groupBy("category", "weight").agg(F.array_join(ordered, ", ").alias("keywords"))


@_query(
    f"""WITH l AS (SELECT id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS pos FROM {_ONE}),
 c AS (SELECT id, pos, trim(regexp_replace(regexp_replace(regexp_replace(line, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Z}}\\s\\x{{200C}}\\x{{200D}}.,;:!?''"()\\-/%&+₺]', ' ', 'g'), '(!{{3,}}|\\?{{3,}}|\\.{{3,}}|,{{3,}}|;{{3,}}|:{{3,}})', '!', 'g'), '[ \\t]+', ' ', 'g')) AS v FROM l)
 SELECT id, count(*) FILTER (WHERE len(string_split_regex(v, ' +')) >= 3) AS long_lines FROM c GROUP BY 1"""
)
def clean_line_stats(spark, d):
    lines = _news(spark, d, "content").select("id", F.explode(F.split("content", "\n")).alias("line"))
    v = F.trim(text.one_blank(text.allowed_characters(F.col("line"))))
    return lines.groupBy("id").agg(F.count_if(F.size(F.split(v, " +")) >= 3).alias("long_lines"))


_URL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '^https?://[^/?#]+', ''), '[?#;].*$', ''), '/{{2,}}', '/', 'g'), '/$', '')"


@_query(
    f"""SELECT url, CASE WHEN regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', '') = regexp_replace(lower(regexp_extract(base_url, '^https?://([^/?#]+)', 1)), '^www\\.', '')
 THEN 'https://' || regexp_extract(base_url, '^https?://([^/?#]+)', 1) || coalesce(nullif({_URL.format('url')}, ''), '/') END AS normal,
 coalesce(try_cast(nullif(regexp_extract(url, '/(?:haber|foto|video)/(\\d{{5,}})', 1), '') AS BIGINT), try_cast(nullif(regexp_extract(regexp_replace(url, '^https?://[^/?#]+', ''), '\\d{{4,}}'), '') AS BIGINT), 0) AS article
 FROM (SELECT DISTINCT url, site_name FROM processed_urls) JOIN sites USING (site_name)"""
)
def normalize_urls(spark, d):
    rows = table(spark, d, "processed_urls").select("url", "site_name").distinct().join(table(spark, d, "sites").select("site_name", "base_url"), "site_name")
    return rows.select("url", urls.normalize_url(F.col("url"), F.col("base_url")).alias("normal"), urls.article_id(F.col("url")).alias("article"))


@_query(
    """WITH p AS (SELECT site_name, url, first_seen, updated_at, coalesce(try_cast(nullif(regexp_extract(url, '/(?:haber|foto|video)/(\\d{5,})', 1), '') AS BIGINT), try_cast(nullif(regexp_extract(regexp_replace(url, '^https?://[^/?#]+', ''), '\\d{4,}'), '') AS BIGINT), 0) AS a FROM processed_urls WHERE site_name IS NOT NULL)
 SELECT site_name, a AS article, arg_min(url, (length(url), first_seen, url)) AS url, arg_min(updated_at, (first_seen, updated_at)) FILTER (WHERE updated_at IS NOT NULL) AS hint, count(*) AS n FROM p GROUP BY site_name, a, CASE WHEN a = 0 THEN url END"""
)
def link_dedup(spark, d):
    return _link_dedup(table(spark, d, "processed_urls").where("site_name is not null")).withColumnRenamed("updated_at", "hint")


def _link_dedup(rows: DataFrame) -> DataFrame:
    """Articles by site and number; an address without a number is an article of its own. The time of the last change stands for the hint of a date."""
    numbered = rows.withColumn("article", urls.article_id(F.col("url"))).withColumn("alone", F.when(F.col("article") == 0, F.col("url")))
    return relational.link_dedup(numbered, ["site_name", "article", "alone"], "url", "first_seen", "updated_at").select("site_name", "article", "url", "updated_at", "n")


@_query("SELECT url, arg_max(status, (updated_at, attempts, status)) AS status, max(updated_at) AS updated_at, min(first_seen) AS first_seen, count(*) AS n_rows FROM processed_urls GROUP BY 1")
def ledger_fold(spark, d):
    return relational.fold_latest(table(spark, d, "processed_urls"), "url", ["updated_at", "attempts", "status"], ["status", "updated_at"], {"first_seen": "first_seen"})


@_query("SELECT site_name, status, count(*) AS n FROM processed_urls GROUP BY ROLLUP (site_name, status)")
def status_rollup(spark, d):
    return table(spark, d, "processed_urls").rollup("site_name", "status").agg(F.count("*").alias("n"))


@_query("SELECT site_name, count(*) FILTER (WHERE status = 'saved') AS saved, count(*) FILTER (WHERE status = 'merged') AS merged, count(*) FILTER (WHERE status NOT IN ('saved', 'merged')) AS skipped FROM processed_urls GROUP BY 1")
def run_summary(spark, d):
    s = F.col("status")
    return table(spark, d, "processed_urls").groupBy("site_name").agg(F.count_if(s == "saved").alias("saved"), F.count_if(s == "merged").alias("merged"), F.count_if(~s.isin("saved", "merged")).alias("skipped"))


@_query("SELECT status, count(*) AS n, min(first_seen) AS earliest FROM processed_urls GROUP BY 1")
def status_histogram(spark, d):
    return table(spark, d, "processed_urls").groupBy("status").agg(F.count("*").alias("n"), F.min("first_seen").alias("earliest"))


@_query("SELECT url, status, updated_at FROM processed_urls WHERE status NOT IN ('saved', 'merged') ORDER BY updated_at DESC, url, status LIMIT 60")
def skipped_recent(spark, d):
    return table(spark, d, "processed_urls").where("status not in ('saved', 'merged')").orderBy(F.desc("updated_at"), "url", "status").limit(60).select("url", "status", "updated_at")


_EARLY = """WITH p AS (SELECT site_name, url, first_seen, status = 'saved' AS fresh, status <> 'saved' AS old FROM processed_urls WHERE site_name IS NOT NULL AND status IS NOT NULL),
 a AS (SELECT *, coalesce(sum(fresh::INT) OVER w, 0) AS island, coalesce(count(*) OVER w, 0) AS done FROM p WINDOW w AS (PARTITION BY site_name ORDER BY first_seen DESC, url, fresh ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 b AS (SELECT *, coalesce(sum(old::INT) OVER (PARTITION BY site_name, island ORDER BY first_seen DESC, url, fresh ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS streak FROM a),
 c AS (SELECT *, max((done >= 150 OR streak >= 12)::INT) OVER (PARTITION BY site_name ORDER BY first_seen DESC, url, fresh ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM b)
 SELECT site_name, count(*) AS scanned, sum(fresh::INT)::BIGINT AS fresh FROM c WHERE stop = 0 GROUP BY 1"""


@_query(_EARLY)
def early_stop(spark, d):
    rows = table(spark, d, "processed_urls").where("site_name is not null and status is not null").select("site_name", "url", "first_seen", (F.col("status") == "saved").alias("fresh"))
    kept = relational.early_stop(rows, "site_name", [F.desc("first_seen"), F.col("url"), F.col("fresh")], F.lit(True), ~F.col("fresh"), F.col("fresh"))
    return kept.groupBy("site_name").agg(F.count("*").alias("scanned"), F.sum(F.col("fresh").cast("int")).alias("fresh"))


@_query("SELECT type, district, count(*) AS n FROM (SELECT DISTINCT ON (id) * FROM news) WHERE lat IS NOT NULL AND lng IS NOT NULL GROUP BY ALL")
def stats_by_type(spark, d):
    return _news(spark, d, "type", "district", "lat", "lng").where("lat is not null and lng is not null").groupBy("type", "district").agg(F.count("*").alias("n"))


@_query("SELECT id, len(sources) AS n_sources, array_to_string([s.site_name for s in sources], ', ') AS sites FROM (SELECT DISTINCT ON (id) * FROM news) WHERE len(sources) > 1")
def multi_source(spark, d):
    return _news(spark, d, "sources").where(F.size("sources") > 1).select("id", F.size("sources").cast("bigint").alias("n_sources"), F.array_join(F.transform("sources", lambda s: s["site_name"]), ", ").alias("sites"))


_BARE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[?#;].*$', ''), '^https?://(www\\.)?', ''), '/{{2,}}', '/', 'g'), '/$', '')"


@_query(f"SELECT DISTINCT i.id FROM news_incoming i WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(sources).url AS u FROM news) s WHERE {_BARE.format('s.u')} = {_BARE.format('i.url')})")
def new_urls(spark, d):
    """Stories whose address is no source yet, addresses compared in their normal form."""
    normal = lambda c: urls.normalize_url(F.col(c), F.col(c))
    bare = lambda c: F.regexp_replace(normal(c), r"^https://(www\.)?", "")
    known = table(spark, d, "news").select(F.explode("sources.url").alias("u")).select(bare("u").alias("k")).where("k is not null")
    return table(spark, d, "news_incoming").withColumn("k", bare("url")).join(known, "k", "left_anti").select("id").distinct()


@_query(
    """SELECT id, round(lat + 0.0011 * sqrt(k) * sin(k * 2.399963), 6) AS shown_lat, round(lng + 0.0011 * sqrt(k) * cos(k * 2.399963) / cos(lat * pi() / 180), 6) AS shown_lng
 FROM (SELECT id, lat, lng, row_number() OVER (PARTITION BY round(lat, 5), round(lng, 5) ORDER BY created_at DESC, id) - 1 AS k FROM (SELECT DISTINCT ON (id) * FROM news) WHERE lat IS NOT NULL AND lng IS NOT NULL)"""
)
def marker_spread(spark, d):
    rows = _news(spark, d, "lat", "lng", "created_at").where("lat is not null and lng is not null")
    shown = relational.spread_markers(rows, "lat", "lng", [F.desc("created_at"), F.col("id")])
    return shown.select("id", F.round("shown_lat", 6).alias("shown_lat"), F.round("shown_lng", 6).alias("shown_lng"))


@_query("SELECT CASE WHEN lat IS NULL OR lng IS NULL THEN 'missing' WHEN NOT (lat BETWEEN 39.0 AND 39.3 AND lng BETWEEN 31.0 AND 31.4) THEN 'outside' END AS reason, count(*) AS n FROM (SELECT DISTINCT ON (id) * FROM news) GROUP BY 1")
def bbox_validate(spark, d):
    reason = relational.box_reason(F.col("lat"), F.col("lng"), 39.0, 31.0, 39.3, 31.4)
    return _news(spark, d, "lat", "lng").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@_query(
    """WITH q AS (SELECT o_orderkey AS k, l_linenumber AS r, l_returnflag = 'R' AS ok FROM orders JOIN lineitem ON o_orderkey = l_orderkey), w AS (SELECT k, min(r) FILTER (WHERE ok) AS winner FROM q GROUP BY 1)
 SELECT q.k AS o_orderkey, any_value(winner) AS winner, count(*) FILTER (WHERE winner IS NULL OR r <= winner)::INT AS attempts FROM q JOIN w USING (k) GROUP BY 1"""
)
def geocode_waterfall(spark, d):
    q = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return relational.waterfall(q, "o_orderkey", "l_linenumber", F.col("l_returnflag") == "R")


@_query("SELECT a.event_id AS key_a, b.event_id AS key_b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND abs(epoch(a.ts) - epoch(b.ts)) <= 3600 AND a.event_id < b.event_id")
def window_pairs(spark, d):
    rows = table(spark, d, "events").withColumn("sec", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return relational.range_pairs(rows, "event_id", "sec", 3600, ["user_id", "event_type"])


_COS = "SELECT a.vec_id AS key_a, b.vec_id AS key_b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id"


@_query(f"SELECT key_a, key_b, round(s, 6) AS similarity FROM ({_COS}) WHERE s >= 0.4")
def cosine_pairs(spark, d):
    return nearest.cosine_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", "label", 0.4).withColumn("similarity", F.round("similarity", 6))


@_query(f"SELECT key_b, arg_max(key_a, (s, -key_a)) AS key_a, round(max(s), 6) AS similarity FROM ({_COS}) WHERE s >= 0.3 GROUP BY 1")
def best_match(spark, d):
    return nearest.best_match(nearest.cosine_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", "label", 0.3)).withColumn("similarity", F.round("similarity", 6))


@_query(
    f"""WITH RECURSIVE l AS MATERIALIZED (SELECT key_a, key_b, s FROM ({_COS}) WHERE s >= 0.3), e AS MATERIALIZED (SELECT v.vec_id, row_number() OVER (ORDER BY v.vec_id) AS n, coalesce(list(l.key_a) FILTER (WHERE l.key_a IS NOT NULL), []) AS near
 FROM (SELECT DISTINCT vec_id FROM embeddings) v LEFT JOIN l ON l.key_b = v.vec_id GROUP BY 1),
 r AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS leaders UNION ALL SELECT r.n + 1, CASE WHEN list_has_any(r.leaders, e.near) THEN r.leaders ELSE list_append(r.leaders, e.vec_id) END FROM r JOIN e ON e.n = r.n + 1),
 f AS (SELECT unnest(leaders) AS leader FROM (SELECT leaders FROM r ORDER BY n DESC LIMIT 1))
 SELECT e.vec_id, coalesce(f.leader, (SELECT arg_max(l.key_a, (l.s, -l.key_a)) FROM l JOIN f ON f.leader = l.key_a WHERE l.key_b = e.vec_id)) AS leader FROM e LEFT JOIN f ON f.leader = e.vec_id"""
)
def greedy_merge(spark, d):
    rows = table(spark, d, "embeddings")
    return nearest.greedy_merge(rows, "vec_id", nearest.cosine_pairs(rows, "vec_id", "embedding", "label", 0.3))


@_query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return ledger.windowed_counts(table(spark, d, "events"), "ts", "event_type", "1 day").withColumn("start", F.col("start").cast("timestamp_ntz"))


@_query("SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def json_props(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"), F.count("*").alias("n"))


@_query("SELECT md5(text) AS digest, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_text_dups(spark, d):
    return table(spark, d, "documents").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).where("copies > 1")


@_query("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1")
def segment_totals(spark, d):
    joined = table(spark, d, "orders").where("o_orderdate >= timestamp_ntz '1996-01-01'").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def _scores(spark, d):
    names = table(spark, d, "news").where("district is not null").select(F.trim("district").alias("name")).where("name <> ''").distinct()
    return places.place_scores(_news(spark, d, "title", "content"), "id", "title", "content", names)


@_query()
def place_mentions(spark, d):
    return _scores(spark, d)


_PROVINCE, _DISTRICTS = "Kartalya", list(served.DISTRICTS)


def _locality(stories: DataFrame) -> DataFrame:
    rules = [(_PROVINCE, "province")] + [(n, None) for n in _DISTRICTS] + [(n, "marked" if n in places.MARKED_ONLY else None) for n in places.FOREIGN]
    scores = places.place_scores(stories, "id", "title", "content", stories.sparkSession.createDataFrame(rules, "name string, rule string"))
    return places.locality(scores, "id", F.col("name").isin(_DISTRICTS), F.col("name") == _PROVINCE, stories)


@_query()
def locality(spark, d):
    return _locality(_news(spark, d, "title", "content"))


@_query()
def address_candidates(spark, d):
    return _address_candidates(_news(spark, d, "title", "content"))


def _address_candidates(stories: DataFrame) -> DataFrame:
    local = stories.join(_locality(stories).where("is_local").select("id", "district"), "id")
    return places.address_candidates(local, "id", "content", "title", "district", tuple(_DISTRICTS), _PROVINCE)


@_query()
def geocode_queries(spark, d):
    """What a geocoder would be asked for each local story, from specific to general."""
    local = _locality(_news(spark, d, "title", "content")).where("is_local").select("id", "district")
    return geocoding.build_queries(_address_candidates(_news(spark, d, "title", "content")).join(local, "id"), "id", _PROVINCE)


@_query("SELECT DISTINCT district FROM news INTERSECT SELECT DISTINCT trim(district) FROM news WHERE type = 'yangin'")
def districts_with_fires(spark, d):
    rows = table(spark, d, "news")
    return rows.select("district").intersect(rows.where("type = 'yangin'").select(F.trim("district").alias("district")))


ingest.register_scores(_SCORES)
_ALL = (_query, pages.query, served.query, ingest.query, instants.query)


def queries() -> dict[str, Query]:
    return {name: q for r in _ALL for name, q in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for r in _ALL for name, sql in r.sql.items()}
