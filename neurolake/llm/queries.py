"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from neurolake.llm import bpe, chats, decontaminate, hpylm, licenses, lines, quality, sharding, simhash, spotsigs

_MODULES = (decontaminate, spotsigs, licenses, quality, hpylm, simhash, lines, sharding, bpe, chats)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
SQL: dict[str, str] = {k: q for m in _MODULES for k, q in m.SQL.items()}
