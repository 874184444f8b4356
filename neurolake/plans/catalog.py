"""The queries of the library over the driver's tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from neurolake.plans import features, signals, sleeping

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = signals.QUERIES | sleeping.QUERIES | features.QUERIES
SQL: dict[str, str] = signals.SQL | sleeping.SQL | features.SQL
