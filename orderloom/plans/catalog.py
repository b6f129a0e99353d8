"""All queries of the library with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderloom.plans import alike, diffs, documents, items, labels, records, sequences, sheets, stores, streams, texts

GROUPS = [alike, diffs, sequences, texts, documents, items, labels, records, sheets, stores, streams]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for group in GROUPS for name, (run, _) in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, (_, sql) in group.QUERIES.items() if sql}
