"""Queries of this subpackage and the SQL to check them with; SQL is given where it is quick on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from yelken.llm import abuse, addresses, disguise, history, leaks, main_body, mixture, near_copies, repeated_lines


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": disguise.p1_found,
        "p2_found": history.p2_found,
        "p3_found": repeated_lines.p3_found,
        "p4_found": main_body.p4_found,
        "p5_found": addresses.p5_found,
        "p7_found": near_copies.p7_found,
        "p8_found": leaks.p8_found,
        "p9_mix": mixture.p9_mix,
        "p9_shares": mixture.p9_shares,
        "p10_found": abuse.p10_found,
        "p10_rates": abuse.p10_rates,
    }


def oracle_sql() -> dict[str, str]:
    return {}
