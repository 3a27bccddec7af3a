"""The whole analysis: a corpus and its responses to one result per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.link import join_keys_endpoints
from ..operators.recommend import recommendations
from ..operators.relevance import gate_skipped_files, score_relevance, union_errors
from ..operators.report import agg_collect_result
from ..operators.responses import (analyze_headers, cap_body_size, join_findings_responses, join_local_fallback,
                                   join_root_csp, with_fetch_errors, with_status_errors)
from ..operators.scan import scan_files


def files_of(responses: DataFrame, cap_bodies: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files, analysed responses) of a crawl with file ids.

    A response without a body is a file without content and an error.
    ``cap_bodies`` rejects or cuts bodies over the size limit first.
    """
    responses = cap_body_size(responses) if cap_bodies else responses.withColumn('fetch_error', F.lit(None).cast('string'))
    prepared = with_fetch_errors(join_local_fallback(with_status_errors(responses)))
    analyzed = join_root_csp(analyze_headers(prepared))
    files = prepared.select('file_id', 'url', F.col('body').alias('content'))
    return files, analyzed


def link_findings(findings: DataFrame) -> DataFrame:
    """All findings, key findings with their related endpoints."""
    linked = join_keys_endpoints(findings)
    return findings.where(F.col('category') != 'api_keys').unionByName(linked, allowMissingColumns=True)


def analyze(files: DataFrame, analyzed_responses: DataFrame | None = None, model=None, findings: DataFrame | None = None,
            size_limits: bool = False) -> DataFrame:
    """Nested results per file with header columns, errors and recommendations.

    A file with very many findings has several rows, numbered by ``part_no``; what
    is not a finding stands in the first of them.

    Pass ``findings`` read back from a written table to keep the scan from being
    repeated by the several consumers; on large inputs do write it first.
    The model decides files of any size; ``size_limits`` lets the size decide first.
    Findings of other files than these are not looked at.
    """
    scored = gate_skipped_files(score_relevance(files, model, size_limits))
    relevant = scored.where(~F.col('skipped')).select('file_id', 'url', 'content')
    if findings is None:
        found = scan_files(relevant)
    else:  # a skipped file has no findings, wherever they come from
        found = findings.join(relevant.select('file_id'), 'file_id', 'left_semi')
    headers = None if analyzed_responses is None else join_findings_responses(files, analyzed_responses)
    advice = recommendations(files, found, headers)
    nested_advice = advice.groupBy('file_id').agg(F.array_sort(F.collect_list(
        F.struct('ord', 'priority', 'category', 'title', 'description'))).alias('recommendations'))
    lines = [scored.select('file_id', F.explode('errors').alias('error'))]
    if analyzed_responses is not None:
        lines += [analyzed_responses.select('file_id', F.col(c).alias('error'))
                  for c in ('status_error', 'error') if c in analyzed_responses.columns]
    errors = union_errors(*lines)
    result = agg_collect_result(files, link_findings(found))
    more = [scored.select('file_id', 'skipped', 'relevance_score'), errors, nested_advice]
    if headers is not None:
        more.append(headers.drop('url', 'file_size'))
    for part in more:
        result = result.join(part.withColumn('part_no', F.lit(0)), ['file_id', 'part_no'], 'left')
    return result.withColumn('analysis_timestamp', F.current_timestamp())
