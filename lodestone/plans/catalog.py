"""All queries of the engine by name, and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.logical import duck
from . import retrieval
from .relational import QUERIES as RELATIONAL


def _plain(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: retrieval.corpus(spark, sf_dir).sql(text)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _plain(text) for name, text in RELATIONAL.items()} | retrieval.QUERIES
ORACLE_SQL: dict[str, str] = {name: duck(text) for name, text in RELATIONAL.items()} | retrieval.ORACLE_SQL
