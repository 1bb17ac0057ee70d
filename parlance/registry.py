"""Names of the queries over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parlance.plans import library, more, scalars, streams, timers  # noqa: F401  (they add their queries)
from parlance.plans import queries as plans

FLAGSHIP = "top_1_lexical"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(plans.SQL)
