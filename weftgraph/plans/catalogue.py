"""Every query over the given tables outside the subpackage for training text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import graph_queries, problems, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**graph_queries.QUERIES, **text_queries.QUERIES, **problems.QUERIES}
SQL: dict[str, str] = {**graph_queries.SQL, **text_queries.SQL, **problems.SQL}
FLAGSHIP = "candidates_type_name"
