"""Registry of named queries and of the SQL they are checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from yelken.session import table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def news(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """One row per story: deliveries of an id hold the same fields."""
    return table(spark, d, "news").select("id", *cols).dropDuplicates(["id"])


#: The same in SQL.
ONE = "(SELECT DISTINCT ON (id) * FROM news)"
PAGES = "(SELECT DISTINCT ON (raw_id) * FROM raw_articles)"

#: Unicode step of text cleaning in SQL, {0} being the value.
NORMAL = (
    "regexp_replace(translate(nfc_normalize({0}), '’‘ʼ`´“”„«»–—−' || chr(160) || chr(8201) || chr(8239), "
    "'''''''''''\"\"\"\"\"---   '), '[\\x{{200B}}-\\x{{200F}}\\x{{2060}}\\x{{FEFF}}]', '', 'g')"
)
LOWER = "lower(replace(replace({0}, 'I', 'ı'), 'İ', 'i'))"
_ALLOWED = "regexp_replace({0}, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Z}}\\s\\x{{200C}}\\x{{200D}}.,;:!?''\"()\\-/%&+₺]', ' ', 'g')"
CLEAN = "trim(regexp_replace(" + (
    "regexp_replace(" * 6 + _ALLOWED + "".join(f", '{p}{{{{3,}}}}', '{m}', 'g')" for p, m in (("!", "!"), ("\\?", "?"), ("\\.", "."), (",", ","), (";", ";"), (":", ":")))
) + ", '[ \\t\\r\\f\\v]+', ' ', 'g'))"
EDGES = "regexp_replace({0}, '^[ .:\\-!?]+|[ .:\\-!?]+$', '', 'g')"
