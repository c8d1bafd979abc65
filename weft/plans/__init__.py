"""Registered queries: each family module holds QUERIES and ORACLE under the same names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.plans import alignment, bleu, datasets, files, metrics, preparation, selection, trees, vocabulary

FAMILIES = [selection, vocabulary, alignment, bleu, trees, datasets, metrics, preparation, files]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for family in FAMILIES for name, query in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.ORACLE.items()}
