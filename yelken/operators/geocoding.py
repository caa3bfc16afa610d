"""Queries to a geocoder, its answers and which of them stands. Asking is left to a function that is given; all else is DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yelken.functions.text import ascii_fold
from yelken.functions.urls import cache_key
from yelken.lexicon import COMPONENT_LEVELS, DISTRICT_FIELDS, MAP_LEVELS, UNKNOWN_LEVEL

MOST_QUARTERS = 3


def build_queries(found: DataFrame, key: str, province: str, district: str = "district") -> DataFrame:
    """(key, pos, query, level, label): what to ask for each story, from specific to general, each text once. ``found``: key, text, kind, rank (see
    places.address_candidates) and the story's district. First the first lane with the first wider street and the first quarter, then each of the two with
    the quarter; every spot; at most MOST_QUARTERS quarters and villages; roads; the district. All end in district and province. One group
    a story, whose candidates its text bounds."""
    item = F.struct("rank", "text", "kind")
    per = found.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("all"), F.max(district).alias("d"))
    of = lambda *kinds: F.transform(F.filter("all", lambda x: x["kind"].isin(*kinds)), lambda x: x["text"])
    lane = lambda s: s.endswith("Sokak")
    per = per.select(key, "d", of("quarter", "village").alias("quarters"), of("street").alias("streets"), of("spot").alias("spots"), of("road").alias("roads"))
    per = per.select("*", F.slice(F.filter("streets", lane), 1, 1).alias("lanes"), F.slice(F.filter("streets", lambda s: ~lane(s)), 1, 1).alias("wide"))
    one = lambda parts, level, label: F.struct(F.array_join(F.array_compact(parts), ", ").alias("query"), F.lit(level).alias("level"), label.alias("label"))
    where, quarter = F.concat_ws(", ", "d", F.lit(province)), F.get("quarters", F.lit(0))
    both = F.concat("lanes", "wide")
    asked = F.concat(
        F.when(F.size("streets") > 0, F.array(one(F.concat(both, F.array(quarter, where)), 5, F.array_join(both, " / ")))).otherwise(F.array().cast("array<struct<query:string,level:int,label:string>>")),
        F.transform(F.concat("wide", "lanes"), lambda s: one(F.array(s, quarter, where), 5, s)),
        F.transform("spots", lambda s: one(F.array(s, where), 4, s)),
        F.transform(F.slice("quarters", 1, MOST_QUARTERS), lambda s: one(F.array(s, where), 3, s)),
        F.transform("roads", lambda s: one(F.array(s, where), 2, s)),
        F.when(F.col("d").isNotNull(), F.array(one(F.array(where), 1, F.col("d")))).otherwise(F.array().cast("array<struct<query:string,level:int,label:string>>")),
    )
    texts = F.transform("asked", lambda x: x["query"])
    return per.select(key, asked.alias("asked")).select(key, F.posexplode(F.filter("asked", lambda x, i: F.array_position(texts, x["query"]) == i + 1)).alias("pos", "x")).select(key, F.col("pos") + 1, "x.*").toDF(key, "pos", "query", "level", "label")


def looked_up(queries: DataFrame, cache: DataFrame, provider: str, ask: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``queries`` (query) with ``cached`` and ``answer`` of the cache (provider, key, answer; a NULL answer is a known miss). Queries the cache lacks are asked
    once each, spellings of one key together, where ``ask`` is given: (key, query) -> (key, answer), rows it leaves out being unavailable."""
    known = cache.where(F.col("provider") == provider).groupBy(F.col("key").alias("__key")).agg(F.first("answer").alias("answer"), F.lit(True).alias("cached"))
    keyed = queries.withColumn("__k", cache_key(F.col("query")))
    if ask is not None:
        missing = keyed.join(known, F.col("__k") == F.col("__key"), "left_anti").groupBy(F.col("__k").alias("key")).agg(F.min("query").alias("query"))
        known = known.unionByName(ask(missing).select(F.col("key").alias("__key"), "answer", F.lit(True).alias("cached")))
    return keyed.join(known, F.col("__k") == F.col("__key"), "left").withColumn("cached", F.coalesce("cached", F.lit(False))).drop("__k", "__key")


def _level_map(levels: dict[int, str]) -> Column:
    return F.create_map(*[F.lit(x) for level, kinds in levels.items() for k in kinds.split() for x in (k, level)])


_COMPONENT_REPLY = "struct<status:string,results:array<struct<formatted_address:string,types:array<string>,place_id:string,geometry:struct<location:struct<lat:double,lng:double>>,address_components:array<struct<long_name:string,types:array<string>>>>>>"


def component_answer(reply: Column) -> Column:
    """STRUCT<state, lat, lng, level, province, district, address> of a reply in JSON that lists address components: state is 'ok', 'none' (a known miss) or
    'unavailable'. The level is the highest of the result's types; 0 without a known one."""
    r = F.from_json(reply, _COMPONENT_REPLY)
    best = F.get(r["results"], F.lit(0))
    part = lambda kind: F.get(F.transform(F.filter(best["address_components"], lambda c: F.array_contains(c["types"], kind)), lambda c: c["long_name"]), F.lit(0))
    level = F.coalesce(F.array_max(F.transform(best["types"], lambda t: F.coalesce(F.try_element_at(_level_map(COMPONENT_LEVELS), t), F.lit(0)))), F.lit(0))
    state = F.when(r["status"] == "ZERO_RESULTS", "none").when((r["status"] == "OK") & best.isNotNull(), "ok").otherwise("unavailable")
    fields = F.struct(
        state.alias("state"), best["geometry"]["location"]["lat"].alias("lat"), best["geometry"]["location"]["lng"].alias("lng"), level.alias("level"),
        part("administrative_area_level_1").alias("province"), part("administrative_area_level_2").alias("district"), best["formatted_address"].alias("address"),
    )
    return fields


def map_answer(item: Column, districts: tuple[str, ...], province: str, iso_code: str) -> Column:
    """The same of one item of a reply of map data: the level by its addresstype, else type; the district by the first field that names one of ``districts``,
    else town or county; the province by its ISO code, else by name. A NULL item is a known miss."""
    field = lambda name: F.get_json_object(item, f"$.{name}")
    kind = F.coalesce(F.nullif(field("addresstype"), F.lit("")), field("type"), F.lit(""))
    level = F.coalesce(F.try_element_at(_level_map(MAP_LEVELS), kind), F.lit(UNKNOWN_LEVEL))
    own = F.create_map(*[x for d in districts for x in (ascii_fold(F.lit(d)), F.lit(d))]) if districts else F.create_map(F.lit(""), F.lit(""))
    named = [F.try_element_at(own, ascii_fold(field(f"address.{f}"))) for f in DISTRICT_FIELDS]
    district = F.coalesce(*named, field("address.town"), field("address.county"))
    where = F.when(field("address['ISO3166-2-lvl4']") == iso_code, F.lit(province)).otherwise(F.coalesce(field("address.province"), field("address.state")))
    return F.struct(
        F.when(item.isNull(), "none").otherwise("ok").alias("state"), field("lat").try_cast("double").alias("lat"), field("lon").try_cast("double").alias("lng"), level.alias("level"),
        where.alias("province"), district.alias("district"), field("display_name").alias("address"),
    )


def refusal(found: Column, lat: Column, lng: Column, province: Column, district: Column, level: Column, asked_level: Column, asked_district: Column, box: tuple[float, float, float, float], own_province: str) -> Column:
    """First reason to refuse an answer, NULL where it stands: none, outside (of south, west, north, east; bounds belong to the box), province, district (only
    where both are known), general (a spot or finer was asked, only a district found), province_level."""
    south, west, north, east = box
    fold = ascii_fold
    return (
        F.when(~F.coalesce(found, F.lit(False)), "none")
        .when(~F.coalesce(lat.between(south, north) & lng.between(west, east), F.lit(False)), "outside")
        .when(fold(province) != fold(F.lit(own_province)), "province")
        .when((asked_district != "") & (district != "") & (fold(district) != fold(asked_district)), "district")
        .when((asked_level >= 2) & (level < 2), "general")
        .when(F.coalesce(level, F.lit(0)) < 1, "province_level")
    )


def first_standing(tried: DataFrame, key: str, pos: str, state: Column, reason: Column) -> DataFrame:
    """(key, winner, attempts, status): the smallest pos whose answer stands, how many were tried up to it, and saved, geocode_failed, or geocode_error where an
    unavailable answer comes before the first that stands (or there is none that does). ``state``: see component_answer."""
    bad = state == "unavailable"
    ok = F.min(F.when(~bad & reason.isNull(), F.col(pos))).alias("winner")
    out = tried.groupBy(key).agg(ok, F.min(F.when(bad, F.col(pos))).alias("broken"), F.collect_list(pos).alias("__all"))  # a story's queries
    last = F.least("winner", "broken")
    error = F.col("broken").isNotNull() & (F.col("winner").isNull() | (F.col("broken") < F.col("winner")))
    return out.select(
        key, F.when(~error, F.col("winner")).alias("winner"), F.size(F.filter("__all", lambda p: last.isNull() | (p <= last))).alias("attempts"),
        F.when(error, "geocode_error").when(F.col("winner").isNull(), "geocode_failed").otherwise("saved").alias("status"),
    )
