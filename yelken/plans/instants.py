"""The query of timestamp normalisation and its SQL."""

from __future__ import annotations

import re

from yelken.operators import timestamps as T
from yelken.plans.registry import Registry

query = Registry()
_FOLD = "lower(translate({0}, 'İIıŞşĞğÜüÖöÇç', 'iiissgguuoocc'))"
_MONTH = "CASE " + " ".join(f"WHEN {_FOLD.format('p[2]')} IN ({', '.join(repr(w) for w in words.split())}) THEN {m}" for m, words in T.MONTHS.items()) + " END"
_OFFSET = "CASE " + " ".join(f"WHEN named = '{k}' THEN {v}" for k, v in T.ZONES.items()) + " END"
_CANON = "CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN regexp_replace(s, '{p}', '{re.sub(r'[$](\d)', r'\\\1', form)}')" for p, form in T.CASCADE) + " END"
_BLANKS = "[\\s\\x{00A0}\\x{1680}\\x{180E}\\x{2000}-\\x{200F}\\x{2028}-\\x{202F}\\x{205F}\\x{2060}\\x{3000}\\x{FEFF}]+"
_N = "CASE WHEN p[{0}] = '' THEN 0 ELSE try_cast(p[{0}] AS INT) END"
_AT = "epoch(timezone({0}, make_timestamp(wall * 1000000)))::BIGINT"

SQL = f"""WITH z AS (SELECT site_name, min(tz) AS tz FROM sites WHERE site_name IS NOT NULL GROUP BY 1),
 r AS (SELECT 'raw' AS src, raw_id::VARCHAR AS rec_id, published_at, site_name FROM raw_articles UNION ALL SELECT 'news', id, published_at, site_name FROM news),
 a AS (SELECT src, rec_id, tz, trim(regexp_replace(nfc_normalize(published_at), '{_BLANKS}', ' ', 'g')) AS s FROM r LEFT JOIN z USING (site_name) WHERE published_at IS NOT NULL AND rec_id IS NOT NULL),
 b AS (SELECT *, string_split({_CANON}, '~') AS p FROM a),
 c AS (SELECT *, try_cast(p[1] AS INT) + CASE WHEN length(p[1]) = 2 THEN 2000 ELSE 0 END AS y, coalesce(try_cast(p[2] AS INT), {_MONTH}) AS mo, try_cast(p[3] AS INT) AS dy, {_N.format(4)} AS h0, {_N.format(5)} AS mi, {_N.format(6)} AS se,
  upper(regexp_replace(p[8], '[()]', '', 'g')) AS named, regexp_replace(p[8], '[^0-9]', '', 'g') AS digits FROM b),
 d AS (SELECT *, CASE WHEN p[9] = '' THEN h0 WHEN h0 BETWEEN 1 AND 12 THEN h0 % 12 + CASE WHEN p[9] = 'ÖS' THEN 12 ELSE 0 END END AS h, try_cast(printf('%04d-%02d-%02d', y, mo, dy) AS DATE) AS day FROM c),
 e AS (SELECT *, CASE WHEN y >= 1900 AND h BETWEEN 0 AND 23 AND mi BETWEEN 0 AND 59 AND se BETWEEN 0 AND 59 THEN epoch(day)::BIGINT + h * 3600 + mi * 60 + se END AS wall,
  CASE WHEN named IN ('TSİ', 'TSI') THEN '{T.HOME_ZONE}' ELSE tz END AS zone FROM d),
 f AS (SELECT *, CASE WHEN digits <> '' THEN CASE WHEN try_cast(digits[1:2] AS INT) <= 14 AND coalesce(try_cast(nullif(digits[3:4], '') AS INT), 0) < 60
   THEN (try_cast(digits[1:2] AS INT) * 3600 + coalesce(try_cast(nullif(digits[3:4], '') AS INT), 0) * 60) * CASE WHEN p[8][1] = '-' THEN -1 ELSE 1 END END ELSE {_OFFSET} END AS shift, {_AT.format('zone')} AS late FROM e),
 g AS (SELECT src, rec_id, CASE WHEN regexp_matches(s, '^\\d{{9,10}}$') THEN try_cast(s AS BIGINT) WHEN regexp_matches(s, '^\\d{{12,13}}$') THEN try_cast(s AS BIGINT) // 1000 WHEN regexp_matches(s, '^\\d{{15,16}}$') THEN try_cast(s AS BIGINT) // 1000000
  WHEN named IN ('', 'TSİ', 'TSI') THEN CASE WHEN timezone(zone, to_timestamp(late - 3600)) = make_timestamp(wall * 1000000) THEN late - 3600 ELSE late END ELSE wall - shift END AS utc_sec FROM f)
 SELECT src, rec_id, min(utc_sec)::BIGINT AS utc_sec FROM g WHERE utc_sec IS NOT NULL GROUP BY 1, 2"""


@query(SQL)
def p6_found(spark, d):
    """(src, rec_id, utc_sec), see timestamps.p6_found. The SQL takes the earlier of repeated hours and moves skipped ones forward, as the operator's defaults do."""
    return T.p6_found(spark, d)
