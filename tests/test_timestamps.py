from datetime import datetime
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from yelken.operators.timestamps import normalise_timestamps, parse_instant


def sec(y, mo, d, h=0, mi=0, s=0, tz="UTC"):
    return int(datetime(y, mo, d, h, mi, s, tzinfo=ZoneInfo(tz)).timestamp())


IST = "Europe/Istanbul"
CASES = [
    ("2016-06-29T21:39:08Z", sec(2016, 6, 29, 21, 39, 8)), ("2016-03-03T04:54:31+02:00", sec(2016, 3, 3, 2, 54, 31)), ("2016-01-02T21:27:09-0400", sec(2016, 1, 3, 1, 27, 9)),
    ("20160301T132737Z", sec(2016, 3, 1, 13, 27, 37)), ("1450367619603", 1450367619), ("1463739902", 1463739902), ("Mon, 25 Jul 2016 21:42:05 +0300", sec(2016, 7, 25, 18, 42, 5)),
    ("Fri, 2 Oct 2015 11:27:22 UT", sec(2015, 10, 2, 11, 27, 22)), ("31 Ocak 2015", sec(2015, 1, 31, tz=IST)), ("29 AĞUSTOS 2015 Cumartesi 10:46", sec(2015, 8, 29, 10, 46, tz=IST)),
    ("28 Eylül 2016 Çarşamba, saat 06:23", sec(2016, 9, 28, 6, 23, tz=IST)), ("04 Eyl. 2015 | 20.11", sec(2015, 9, 4, 20, 11, tz=IST)), ("3/10/2016 06:50", sec(2016, 10, 3, 6, 50, tz=IST)),
    ("28.11.15 01:54", sec(2015, 11, 28, 1, 54, tz=IST)), ("22.05.2016 01:07 ÖS ", sec(2016, 5, 22, 13, 7, tz=IST)), ("15.08.2015 12:33 ÖÖ", sec(2015, 8, 15, 0, 33, tz=IST)),
    ("12.05.2016 01:07 (TSİ)", sec(2016, 5, 12, 1, 7, tz=IST)), ("2016-04-22 10:20:52 EEST", sec(2016, 4, 22, 7, 20, 52)), ("2016-06-08 22:24:18,454", sec(2016, 6, 8, 22, 24, 18, IST)),
    (" 2015-08-15\xa0", sec(2015, 8, 15, tz=IST)), ("1969-12-31T23:59:59.500Z", -1),
    ("31 Şubat 2016 14:10", None), ("0000-00-00 00:00:00", None), ("04.13.2015 09:15", None), ("dün 16:18", None), ("18:52", None), ("13 saat önce", None), ("N/A", None), ("", None), (None, None),
    ("2016-06-08 25:00:00", None), ("2016-06-08 10:00:00 XYZ", None), ("x" * 100_000, None),
]


def test_cascade(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(CASES)], "i int, v string")
    got = {r.i: r.t for r in df.select("i", parse_instant(F.col("v"), F.lit(IST)).alias("t")).collect()}
    assert [got[i] for i in range(len(CASES))] == [w for _, w in CASES]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_local_times_and_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([("2015-10-25 02:30", "Europe/Berlin"), ("2016-03-27 02:30", "Europe/Berlin"), ("2015-10-25 02:30", None)], "v string, z string")
        get = lambda **p: [r[0] for r in df.select(parse_instant(F.col("v"), F.col("z"), **p)).collect()]
        assert get() == [sec(2015, 10, 25, 0, 30), sec(2016, 3, 27, 1, 30), None]
        assert get(ambiguous="later")[0] == sec(2015, 10, 25, 1, 30)
        assert get(ambiguous="null", nonexistent="null") == [None, None, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_tables(spark):
    sites = spark.createDataFrame([("a", IST), ("a", "UTC"), (None, IST), ("bad", "no zone!")], "site_name string, tz string")
    df = spark.createDataFrame([("a", "2016-01-01 02:00", 1), ("a", "2016-01-01 02:00", 1), ("bad", "2016-01-01 02:00", 2), (None, "2016-01-01T00:00:00Z", 3)], "site_name string, published_at string, tz int")
    rows = normalise_timestamps(df, sites).collect()
    assert len(rows) == 4 and rows[0].tz == 1
    assert sorted((r.utc_sec for r in rows), key=str) == sorted([sec(2016, 1, 1, 2, tz=IST)] * 2 + [None, sec(2016, 1, 1)], key=str)
    assert normalise_timestamps(df.limit(0), sites).count() == 0
