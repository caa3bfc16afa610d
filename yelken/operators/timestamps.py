"""Mixed timestamp formats and zones -> one UTC instant (problem 6).

An ordered cascade of anchored patterns rewrites each value into one canonical string
``year~month~day~hour~minute~second~fraction~zone~half``; strict parsing then decides.
All of it is built-in expressions: no Python, no shuffle; the zone table is joined by broadcast
only where Spark's own size check allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yelken.session import table

# Month names and their usual short forms, folded to lower-case ASCII.
MONTHS = {
    1: "ocak oca january jan", 2: "subat sub february feb", 3: "mart mar march", 4: "nisan nis april apr",
    5: "mayis may", 6: "haziran haz june jun", 7: "temmuz tem july jul", 8: "agustos agu august aug",
    9: "eylul eyl september sep sept", 10: "ekim eki october oct", 11: "kasim kas november nov", 12: "aralik ara december dec",
}
# Zone abbreviations and their offsets in seconds.
ZONES = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 3600, "BST": 3600, "CET": 3600, "MEZ": 3600, "CEST": 7200,
    "MESZ": 7200, "EET": 7200, "EEST": 10800, "TRT": 10800, "MSK": 10800,
}
HOME_ZONE = "Europe/Istanbul"  # what "TSİ" (Turkish time) names

_ZONE = r"(Z|z|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Z]{2,5}|\(?TS[İI]\)?)?"
_DAYNAME = r"(?:\p{L}+\.?)"
#: (pattern, canonical form), tried in this order.
CASCADE = [
    (rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[T ](\d{{2}}):(\d{{2}})(?::(\d{{2}})(?:[.,](\d{{1,9}}))?)? ?{_ZONE}$", "$1~$2~$3~$4~$5~$6~$7~$8~"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})?{_ZONE}$", "$1~$2~$3~$4~$5~$6~~$7~"),
    (r"^(\d{4})[-/](\d{2})[-/](\d{2})$", "$1~$2~$3~~~~~~"),
    (rf"^(?:{_DAYNAME},? )?(\d{{1,2}}) (\p{{L}}{{3,9}})\.? (\d{{4}}),? (\d{{1,2}}):(\d{{2}}):(\d{{2}}) ?{_ZONE}$", "$3~$2~$1~$4~$5~$6~~$7~"),
    (r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4}|\d{2})(?:,? ?[-|]? ?(\d{1,2})[:.](\d{2})(?:[:.](\d{2}))? ?(\(?TS[İI]\)?)?(ÖÖ|ÖS)?)?$", "$3~$2~$1~$4~$5~$6~~$7~$8"),
    (rf"^(?:{_DAYNAME},? )?(\d{{1,2}}) (\p{{L}}{{3,9}})\.? (\d{{4}})(?:,? {_DAYNAME})?(?:,? ?(?:saat)? ?[-|]? ?(\d{{1,2}})[:.](\d{{2}})(?:[:.](\d{{2}}))? ?(\(?TS[İI]\)?)?(ÖÖ|ÖS)?)?$", "$3~$2~$1~$4~$5~$6~~$7~$8"),
]


def trimmed(value: Column) -> Column:
    """Outer blanks of any kind removed, inner runs made one space, separate accents composed for the letters dates use."""
    plain = F.regexp_replace(value, r"[\s  ᠎ -‏  ⁠　﻿]+", " ")
    for pair, one in (("Ü", "Ü"), ("ü", "ü"), ("Ö", "Ö"), ("ö", "ö"), ("Ş", "Ş"), ("ş", "ş"), ("Ğ", "Ğ"), ("ğ", "ğ"), ("İ", "İ"), ("i̇", "i")):
        plain = F.replace(plain, F.lit(pair), F.lit(one))
    return F.trim(plain)


def find_date(text: Column) -> Column:
    """The first written date inside a text, with the clock time that follows it within 25 characters other than digits, in a form that parse_instant
    reads; NULL where there is none. A date in words goes before one in numbers."""
    names = "|".join(sorted({w for words in MONTHS.values() for w in words.split()}, key=len, reverse=True))
    folded, out = _folded(text), []
    for date in (rf"(\d{{1,2}})\s+({names})\.?\s+(\d{{4}})", r"(\d{1,2})[./](\d{1,2})[./](\d{4})"):
        hit = F.nullif(F.regexp_extract(folded, rf"(?<!\d){date}(?!\d)(?:[^0-9]{{0,25}}?(?<!\d)(\d{{1,2}})[:.](\d{{2}}))?", 0), F.lit(""))
        day = F.regexp_extract(hit, date, 0)
        clock = F.regexp_extract(F.substr(hit, F.length(day) + 1), r"(\d{1,2})[:.](\d{2})", 0)
        out.append(F.when(hit.isNotNull(), F.trim(F.concat_ws(" ", F.regexp_replace(F.regexp_replace(day, r"\s+", " "), r"([a-z])\. ", "$1 "), clock))))
    return F.coalesce(*out)


def iso_date(value: Column) -> Column:
    """DATE of a text YYYY-MM-DD, NULL for anything else."""
    return F.when(F.trim(value).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.trim(value).try_cast("date"))


def iso_text(at: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SSZ of a TIMESTAMP, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def day_range(start: Column, end: Column, zone: str) -> tuple[Column, Column]:
    """(from, before): UTC wall clock of the beginning of the local day ``start`` and of the day after ``end`` (DATEs)."""
    return F.to_utc_timestamp(start.cast("timestamp_ntz"), zone), F.to_utc_timestamp(F.date_add(end, 1).cast("timestamp_ntz"), zone)


def _folded(value: Column) -> Column:
    return F.lower(F.translate(value, "İIıŞşĞğÜüÖöÇç", "iiissgguuoocc"))


def parse_instant(value: Column, zone: Column, ambiguous: str = "earlier", nonexistent: str = "shift") -> Column:
    """BIGINT seconds since 1970-01-01 UTC, rounded down, or NULL.

    ``zone`` is the IANA zone of a value that names none; where it is NULL too, such a value gives NULL.
    A zone in the value wins. A date alone is its midnight; the day comes before the month; two-digit years are 20yy.
    ``ambiguous`` (hour repeated in autumn): 'earlier', 'later' or 'null'. ``nonexistent`` (hour skipped in spring):
    'shift' moves forward by the gap, 'null' refuses. NULL, empty, relative, impossible values, and times without a date give NULL.
    """
    return _let(trimmed(value), lambda s: F.coalesce(_epoch(s), _let(F.split(_canonical(s), "~"), lambda p: _resolve(p, zone, ambiguous, nonexistent)))).cast("bigint")


def _let(value: Column, body) -> Column:
    """``body`` with ``value`` bound once: a plain Column would be copied into every place that uses it."""
    return F.transform(F.array(value), body).getItem(0)


def _canonical(s: Column) -> Column:
    canon = F.lit(None).cast("string")
    for pattern, form in reversed(CASCADE):
        canon = F.when(s.rlike(pattern), F.regexp_replace(s, pattern, form)).otherwise(canon)
    return canon


def _epoch(s: Column) -> Column:
    whole = s.try_cast("bigint")
    return F.when(s.rlike(r"^\d{9,10}$"), whole).when(s.rlike(r"^\d{12,13}$"), F.floor(whole / 1000)).when(s.rlike(r"^\d{15,16}$"), F.floor(whole / 1000000))


def _resolve(p: Column, zone: Column, ambiguous: str, nonexistent: str) -> Column:
    part = lambda i: p.getItem(i)
    number = lambda i: F.when(part(i) == "", F.lit(0)).otherwise(part(i).try_cast("int"))
    names = F.create_map(*[F.lit(x) for m, words in MONTHS.items() for w in words.split() for x in (w, m)])
    zones = F.create_map(*[F.lit(x) for k, v in ZONES.items() for x in (k, v)])
    year = part(0).try_cast("int") + F.when(F.length(part(0)) == 2, 2000).otherwise(0)
    month = F.coalesce(part(1).try_cast("int"), F.try_element_at(names, _folded(part(1))))
    half, hour0 = part(8), number(3)
    hour = F.when(half == "", hour0).when(hour0.between(1, 12), hour0 % 12 + F.when(half == "ÖS", 12).otherwise(0))
    day = F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, part(2).try_cast("int")), "yyyy-MM-dd")
    fields = F.struct(day.alias("day"), year.alias("year"), hour.alias("h"), number(4).alias("m"), number(5).alias("s"))
    # plain arithmetic: independent of the session's zone
    wall = _let(
        fields,
        lambda f: F.when(
            (f["year"] >= 1900) & f["h"].between(0, 23) & f["m"].between(0, 59) & f["s"].between(0, 59),
            F.datediff(f["day"], F.lit("1970-01-01").cast("date")).cast("bigint") * 86400 + f["h"] * 3600 + f["m"] * 60 + f["s"],
        ),
    )
    named = F.upper(F.regexp_replace(part(7), r"[()]", ""))
    digits = F.regexp_replace(part(7), r"[^0-9]", "")

    def shifted(f: Column) -> Column:
        h, m = F.substring(f["digits"], 1, 2).try_cast("int"), F.coalesce(F.substring(f["digits"], 3, 2).try_cast("int"), F.lit(0))
        numeric = F.when((h <= 14) & (m < 60), (h * 3600 + m * 60) * F.when(part(7).startswith("-"), -1).otherwise(1))
        home = f["named"].isin("TSİ", "TSI")
        offset = F.when(f["digits"] != "", numeric).otherwise(F.try_element_at(zones, f["named"]))
        local = _local(f["wall"], F.when(home, F.lit(HOME_ZONE)).otherwise(zone), ambiguous, nonexistent)
        return F.when((f["named"] == "") | home, local).otherwise(f["wall"] - offset)

    return _let(F.struct(wall.alias("wall"), named.alias("named"), digits.alias("digits")), shifted)


def _local(wall: Column, zone: Column, ambiguous: str, nonexistent: str) -> Column:
    local = F.timestamp_seconds(wall)
    first = F.to_utc_timestamp(local, zone)
    at = F.unix_seconds(first)
    if ambiguous != "earlier":
        again = F.from_utc_timestamp(F.timestamp_seconds(at + 3600), zone) == local
        at = F.when(again, at + 3600 if ambiguous == "later" else F.lit(None)).otherwise(at)
    if nonexistent == "null":
        at = F.when(F.from_utc_timestamp(first, zone) == local, at)
    return at


def normalise_timestamps(df: DataFrame, sites: DataFrame, value: str = "published_at", site: str = "site_name", out: str = "utc_sec", **policy: str) -> DataFrame:
    """``df`` with a BIGINT column ``out``. ``sites`` (site_name, tz) gives the zone of values that name none; a repeated
    site_name uses the smallest tz, an unknown site has none. All columns of ``df`` stay, whatever their names; an
    existing column ``out`` is replaced. Rows are never dropped or doubled."""
    zones = sites.where(F.col("site_name").isNotNull()).groupBy(F.col("site_name").alias("__site")).agg(F.min("tz").alias("__tz"))
    joined = df.join(zones, df[site] == F.col("__site"), "left")
    # an unknown zone name would raise: only names of the usual form are passed on
    zone = F.when(F.col("__tz").rlike(r"^[A-Za-z_]+(/[A-Za-z_+-]+[0-9]*)*$"), F.col("__tz"))
    return joined.withColumn(out, parse_instant(df[value], zone, **policy)).drop("__site", "__tz")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, rec_id, utc_sec): one row per distinct raw_id / id whose published_at fixes an instant."""
    sites = table(spark, sf_dir, "sites")
    parts = [
        normalise_timestamps(table(spark, sf_dir, t).select(F.lit(src).alias("src"), F.col(key).cast("string").alias("rec_id"), "published_at", "site_name"), sites)
        for src, t, key in (("raw", "raw_articles", "raw_id"), ("news", "news", "id"))
    ]
    found = parts[0].unionByName(parts[1]).where(F.col("utc_sec").isNotNull() & F.col("rec_id").isNotNull())
    # deliveries of one record that disagree would give several rows: the smallest instant stands
    return found.groupBy("src", "rec_id").agg(F.min("utc_sec").alias("utc_sec"))
