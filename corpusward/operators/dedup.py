"""First-wins de-duplication and top-k over rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

PLACE = ['rule_ord', 'match_ord']


def top_k(rows: DataFrame, keys: list[str], order: list, k: int, rank: str = 'rank') -> DataFrame:
    """First ``k`` rows per key.  Spark keeps at most ``k`` per key before it shuffles."""
    by_key = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(by_key)).where(F.col(rank) <= k)


def dedup_first(rows: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    return top_k(rows, keys, order or PLACE, 1, '_rank').drop('_rank')


def dedup_first_findings(rows: DataFrame) -> DataFrame:
    return dedup_first(rows, ['file_id', 'line', 'match', 'type'])


def dedup_first_endpoints(rows: DataFrame) -> DataFrame:
    return dedup_first(rows, ['file_id', 'path', 'line'])


def dedup_first_params(rows: DataFrame) -> DataFrame:
    return dedup_first(rows, ['file_id', 'name', 'line', 'type'])


def dedup_first_paths(rows: DataFrame) -> DataFrame:
    return dedup_first(rows, ['file_id', 'path', 'line', 'type'])


def dedup_first_candidates(rows: DataFrame) -> DataFrame:
    return dedup_first(rows, ['file_id', 'match'])


def dedup_recommendations(rows: DataFrame) -> DataFrame:
    return dedup_first(rows, ['file_id', 'title'], ['ord'])
