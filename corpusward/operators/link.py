"""Links between findings of one file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..catalog import words as W

_ORDER = ['part', 'rule_ord', 'match_ord']


def near_endpoints(keys: DataFrame, endpoints: DataFrame, lines: int = W.LINK_LINES, k: int = W.LINK_ENDPOINTS) -> DataFrame:
    """First ``k`` endpoints within ``lines`` lines of every line that holds a key.

    Works on lines and not on pairs of findings: only the first ``k`` endpoints of
    a line can count, and keys on one line share the answer.  Lines meet by
    equality of a line bucket, so no group of pairs is ever built, however many
    keys and endpoints one line holds.
    """
    width = 2 * lines + 1
    on_line = Window.partitionBy('file_id', 'line').orderBy('rule_ord', 'match_ord')
    candidates = (endpoints.select('file_id', 'line', 'rule_ord', 'match_ord', 'method', 'path')
                  .withColumn('_rank', F.row_number().over(on_line)).where(F.col('_rank') <= k).drop('_rank')
                  .withColumn('_bucket', F.floor(F.col('line') / width)))
    key_lines = (keys.select('file_id', F.col('line').alias('key_line')).distinct()
                 .withColumn('_bucket', F.explode(F.array_distinct(F.array(
                     F.floor((F.col('key_line') - lines) / width), F.floor((F.col('key_line') + lines) / width))))))
    near = key_lines.join(candidates, ['file_id', '_bucket']).where(F.abs(F.col('line') - F.col('key_line')) <= lines)
    by_key_line = Window.partitionBy('file_id', 'key_line').orderBy('rule_ord', 'match_ord')
    first = near.withColumn('_rank', F.row_number().over(by_key_line)).where(F.col('_rank') <= k)
    ranked = F.array_sort(F.collect_list(F.struct('_rank', 'method', 'path', 'line')))
    return first.groupBy('file_id', 'key_line').agg(F.transform(ranked, lambda e: F.struct(
        e['method'].alias('method'), e['path'].alias('path'), e['line'].alias('line'))).alias('related_endpoints'))


def join_keys_endpoints(findings: DataFrame, lines: int = W.LINK_LINES, k: int = W.LINK_ENDPOINTS) -> DataFrame:
    """Key findings with ``related_endpoints``.

    Empty for keys without a near endpoint; null in files without any endpoint.
    """
    keys = findings.where(F.col('category') == 'api_keys')
    endpoints = findings.where(F.col('category') == 'api_endpoints')
    near = near_endpoints(keys, endpoints, lines, k).withColumnRenamed('key_line', 'line')
    with_endpoints = endpoints.select('file_id').distinct().withColumn('_any', F.lit(True))
    empty = F.array().cast('array<struct<method:string,path:string,line:int>>')
    return (keys.join(near, ['file_id', 'line'], 'left').join(with_endpoints, 'file_id', 'left')
            .withColumn('related_endpoints', F.coalesce('related_endpoints', F.when(F.col('_any'), empty)))
            .drop('_any'))


def topk_examples(linked: DataFrame, k: int = 3) -> DataFrame:
    """First ``k`` "METHOD path" examples per file, over keys in order and their endpoints in order."""
    calls = linked.select('file_id', *_ORDER, F.posexplode('related_endpoints').alias('_pos', '_call')) \
        .where(F.coalesce('_call.path', F.lit('')) != '')
    order = Window.partitionBy('file_id').orderBy(*_ORDER, '_pos')
    return (calls.withColumn('rank', F.row_number().over(order)).where(F.col('rank') <= k)
            .select('file_id', 'rank', F.trim(F.concat_ws(' ', '_call.method', '_call.path')).alias('example')))
