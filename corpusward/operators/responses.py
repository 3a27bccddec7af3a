"""Crawled responses: body limits, fallbacks, header columns, referenced scripts.

``responses(url, status, headers MAP, body, ip [, file_id])``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..catalog import family_rules, rules as R, words as W
from ..functions.headers import (analyze_cdn, analyze_csp, analyze_rate_headers, analyze_server, csp_of_policy,
                                 fetch_error_message, header_get, http_status_message)
from ..functions.regex import java_regex
from ..functions.text import fold_case, head
from ..functions.url import resolve_url, root_url


def cap_body_size(responses: DataFrame) -> DataFrame:
    """Reject bodies announced over the limit, cut the others to the limit in characters."""
    announced = F.try_to_number(header_get(F.col('headers'), 'Content-Length'), F.lit('9' * 18)).cast('double') / (1024 * 1024)
    too_large = F.coalesce(announced > W.MAX_BODY_MB, F.lit(False))
    message = F.format_string('File too large (%.1fMB). Max limit is 10MB.', announced)
    return responses.withColumns({
        'fetch_error': F.when(too_large, message),
        'body': F.when(~too_large, head(F.col('body'), W.MAX_BODY_CHARS))})


def with_status_errors(responses: DataFrame) -> DataFrame:
    return responses.withColumn('status_error', http_status_message(F.col('status')))


def join_local_fallback(responses: DataFrame) -> DataFrame:
    """A localhost URL without a body takes the 127.0.0.1 response, if that has one."""
    columns = [c for c in responses.columns if c not in ('url', 'file_id')]
    ids = [c for c in ['file_id'] if c in responses.columns]
    other = (one_per_url(responses.where(F.contains('url', F.lit('127.0.0.1')) & (F.coalesce('body', F.lit('')) != '')))
             .select(F.col('url').alias('_alt'), F.struct(F.col('url'), *columns).alias('_other')))
    wants = F.coalesce(F.col('body').isNull() & F.contains('url', F.lit('localhost')), F.lit(False))
    # only responses that want another one take part in the join; the rest stays where it is
    waiting = responses.where(wants).withColumn('_alt', F.replace('url', F.lit('localhost'), F.lit('127.0.0.1')))
    found = F.col('_other').isNotNull()
    filled = waiting.join(other, '_alt', 'left').select(
        *ids, F.col('url').alias('original_url'),
        *[F.when(found, F.col('_other')[c]).otherwise(F.col(c)).alias(c) for c in ['url', *columns]])
    return responses.where(~wants).select(*ids, F.col('url').alias('original_url'), 'url', *columns).unionByName(filled)


def one_per_url(responses: DataFrame) -> DataFrame:
    """One response per URL: of several, the one with the highest file id, then by status and a hash of the body."""
    order = [F.desc(c) for c in ('file_id', 'status') if c in responses.columns]
    order += [F.xxhash64(c) for c in ('body',) if c in responses.columns]
    rank = F.row_number().over(Window.partitionBy('url').orderBy(*order))
    return responses.withColumn('_rank', rank).where('_rank = 1').drop('_rank')


def with_fetch_errors(responses: DataFrame) -> DataFrame:
    reason = F.coalesce(F.col('fetch_error'), F.when(F.col('body') == '', F.lit('Empty response received.')))
    return responses.withColumn('error', F.when(F.coalesce('body', F.lit('')) == '', fetch_error_message(F.col('url'), reason)))


def analyze_headers(responses: DataFrame) -> DataFrame:
    headers = F.col('headers')
    return responses.withColumns({
        'server_info': analyze_server(headers), 'csp_info': analyze_csp(headers),
        'cdn_info': analyze_cdn(headers), 'rate_limit_info': analyze_rate_headers(headers)})


def join_root_csp(analyzed: DataFrame) -> DataFrame:
    """A script response without a policy takes the policy of its site's root page.

    Roots are few per site and only rows that need one take part; the join key
    is null for all others, so they are not shuffled onto one key.
    """
    kind = F.lower(F.coalesce(header_get(F.col('headers'), 'Content-Type'), F.lit('')))
    is_script = F.contains(kind, F.lit('javascript')) | F.endswith(kind, F.lit('/js'))
    needs = ~F.coalesce(F.col('csp_info.is_present'), F.lit(False)) & F.col('csp_info').isNotNull() & is_script
    roots = (analyzed.where((F.col('url') == root_url(F.col('url'))) & F.col('csp_info.is_present'))
             .select('url', 'csp_info', *[c for c in ('file_id', 'status') if c in analyzed.columns])
             .transform(one_per_url).select(F.col('url').alias('_root'), F.col('csp_info').alias('_root_csp')))
    waiting = analyzed.where(needs & root_url(F.col('url')).isNotNull())
    settled = analyzed.where(~(needs & root_url(F.col('url')).isNotNull()))
    filled = (waiting.withColumn('_root', root_url(F.col('url'))).join(roots, '_root', 'left')
              .withColumn('csp_info', F.coalesce('_root_csp', 'csp_info')).drop('_root', '_root_csp'))
    return settled.unionByName(filled)


def meta_csp(content: Column) -> Column:
    """Policy text of the first policy meta tag (attributes in the usual order), else null."""
    return F.nullif(F.regexp_extract(content, java_regex(R.META_CSP), 1), F.lit(''))


def scan_meta_csp(files: DataFrame) -> DataFrame:
    with_policy = files.where(F.contains(F.lower('content'), F.lit('content-security-policy'))) \
        .select('file_id', 'url', meta_csp(F.col('content')).alias('policy')).where(F.col('policy').isNotNull())
    return with_policy.withColumn('csp_info', csp_of_policy(F.col('policy')))


def join_findings_responses(files: DataFrame, analyzed: DataFrame) -> DataFrame:
    """Header columns per file; a policy in the text counts only without a response."""
    key = 'file_id' if 'file_id' in analyzed.columns else 'url'
    headers = analyzed.select(key, (F.size('headers') > 0).alias('_has_response'), 'server_info', 'csp_info',
                              'cdn_info', 'rate_limit_info', F.col('ip').alias('ip_address'))
    texts = files.select('file_id', 'url', F.length('content').alias('file_size'),
                         csp_of_policy(meta_csp(F.col('content'))).alias('_meta'))
    return (texts.join(headers, key, 'left')
            .withColumn('csp_info', F.when(F.coalesce('_has_response', F.lit(False)), F.col('csp_info'))
                        .when(F.col('_meta.is_present'), F.col('_meta')))
            .drop('_meta', '_has_response'))


def resolve_script_refs(files: DataFrame) -> DataFrame:
    """Referenced scripts as absolute URLs, distinct per page."""
    rule = family_rules('script_refs')[0]
    refs = F.regexp_extract_all('content', F.lit(rule.java), F.lit(1))
    return (files.where(F.contains(fold_case(F.col('content')), F.lit('<script')))
            .select('file_id', 'url', F.explode(F.array_distinct(F.transform(
                F.array_distinct(refs), lambda ref: resolve_url(F.col('url'), ref)))).alias('script_url')))


def distinct_script_urls(files: DataFrame) -> DataFrame:
    """Every referenced script once."""
    return resolve_script_refs(files).select('script_url').distinct()
