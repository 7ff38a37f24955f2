"""All registered queries of the engine with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.plans import content, flows, more, relational, scalar

_ALL = scalar.CATALOG | relational.CATALOG | more.CATALOG | content.CATALOG | flows.CATALOG
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: build for name, (build, _) in _ALL.items()}
SQL: dict[str, str] = {name: sql for name, (_, sql) in _ALL.items() if sql}
