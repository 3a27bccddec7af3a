"""Registry: every operator as a query over the given tables, with SQL that must agree.

``QUERIES[name]`` is a function of (spark, sf_dir); ``ORACLE[name]`` a function
that returns the SQL.  Both sides read whole tables and whole texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalog import (FAMILIES, LEGACY_FAMILIES, css_properties, family_rules, legacy_rule_catalog, risk_catalog,
                       rule_catalog, words as W)
from ..functions import filters as P, headers as H, url as U
from ..functions.text import base64_text, fold_case, strip_quotes
from ..operators import dedup as D, link as L, relevance as V, report as T, responses as S
from ..operators.scan import PATTERN_FAMILIES, raw_matches, scan_endpoints_legacy, scan_files, scan_patterns_legacy
from ..operators.sinks import triggers
from ..sources.files import in_short_tasks, scan_code_files, scan_crawl_responses, spread
from ..sources.urls import route_inputs, scan_request_payloads, scan_url_list
from . import oracle as O
from .corpus import code_corpus, responses, table
from .shared import materialize, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, Callable[[], str]] = {}


def query(name: str, sql: Callable[[], str] | str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql if callable(sql) else (lambda: sql)
        return build
    return register


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    # dealt out as they are read: a task that reads a row group, which Spark does not cut, does nothing else
    return code_corpus(spark, sf_dir, pages=in_short_tasks(table(spark, sf_dir, 'pages'), 'page_id', 'html'))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, 'pages'), 'page_id')


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, 'documents'), 'doc_id')


def findings_sql(families: list[str], body: str, extra: str = '', shortened: bool = False) -> str:
    return O.with_findings(families, body, False, extra, shortened)


def raw_sql(families: list[str], body: str, profile: str = 'current') -> str:
    return O.with_matches({f: family_rules(f, profile) for f in families}, body, False)


KEY = ['file_id', 'rule_ord', 'match_ord']
PATTERN_COLUMNS = ['file_id', 'url', 'category', 'part', 'rule_ord', 'match_ord', 'type', 'match', 'line', 'line_content', 'context',
                   'context_start_line', 'context_end_line', 'confidence', 'technique', 'severity', 'detection_logic']
ENDPOINT_COLUMNS = ['file_id', 'url', 'rule_ord', 'match_ord', 'method', 'path', 'full_match', 'line', 'line_content', 'detection_logic']
PARAMETER_COLUMNS = ['file_id', 'url', 'rule_ord', 'match_ord', 'type', 'name', 'match', 'line', 'line_content', 'detection_logic']
PATH_COLUMNS = ['file_id', 'url', 'part', 'rule_ord', 'match_ord', 'type', 'path', 'match', 'line', 'line_content', 'detection_logic']
SINK_COLUMNS = ['file_id', 'url', 'category', 'match_ord', 'type', 'match', 'line', 'confidence', 'technique', 'severity', 'cwe',
                'owasp', 'detection_logic']


def _scan(name: str, families: list[str], columns: list[str]) -> None:
    with_text = not {'line_content', 'context', 'context_start_line', 'context_end_line'}.isdisjoint(columns)
    QUERIES[name] = lambda spark, d: scan_files(corpus(spark, d), families, with_text=with_text).select(*columns)
    ORACLE[name] = lambda: findings_sql(families, f"SELECT {', '.join(columns)} FROM findings")


# --- scans and unions --------------------------------------------------------------

for _name, _families, _columns in [
    ('scan_patterns', PATTERN_FAMILIES, PATTERN_COLUMNS),
    ('scan_api_keys', ['api_keys'], PATTERN_COLUMNS),
    ('scan_credentials', ['credentials'], PATTERN_COLUMNS),
    ('scan_emails', ['emails'], PATTERN_COLUMNS),
    ('scan_ip_addresses', ['ip_addresses'], PATTERN_COLUMNS),
    ('scan_comments', ['comments'], PATTERN_COLUMNS),
    ('scan_xss_sinks', ['xss_sinks'], PATTERN_COLUMNS),
    ('scan_xss_functions', ['xss_functions'], PATTERN_COLUMNS),
    ('scan_libraries', ['libraries'], PATTERN_COLUMNS),
    ('scan_obfuscation', ['obfuscation'], PATTERN_COLUMNS),
    ('scan_server_banners', ['server_banners'], PATTERN_COLUMNS),
    ('scan_high_entropy', ['entropy'], PATTERN_COLUMNS),
    ('scan_base64_secrets', ['base64'], PATTERN_COLUMNS),
    ('scan_endpoints', ['endpoints'], ENDPOINT_COLUMNS),
    ('scan_parameters', ['parameters'], PARAMETER_COLUMNS),
    ('scan_paths', ['paths'], PATH_COLUMNS),
    ('scan_script_refs', ['script_refs'], PATH_COLUMNS),
    ('scan_sink_calls', ['sink_calls'], SINK_COLUMNS),
    ('union_api_keys', ['api_keys', 'entropy'], PATTERN_COLUMNS),
    ('union_emails_ips', ['emails', 'ip_addresses'], PATTERN_COLUMNS),
    ('union_obfuscation', ['obfuscation', 'base64'], PATTERN_COLUMNS),
    ('union_sinks', ['xss_sinks', 'xss_functions', 'sink_calls'], ['part', 'rule_ord', *SINK_COLUMNS]),
    ('union_paths_scripts', ['paths', 'script_refs'], PATH_COLUMNS),
]:
    _scan(_name, _families, _columns)

EVERY = [*FAMILIES, 'script_refs', 'entropy', 'base64', 'sink_calls']
ALL_COLUMNS = ['file_id', 'category', 'part', 'rule_ord', 'match_ord', 'type', 'method', 'path', 'name', 'match', 'line',
               'confidence', 'technique', 'severity', 'cwe', 'detection_logic']
_scan('union_all_findings', EVERY, ALL_COLUMNS)


@query('scan_documents', lambda: _documents_sql())
def scan_documents(spark, d):
    """Plain-text corpus: tokens, addresses and e-mails in the documents."""
    files = in_short_tasks(table(spark, d, 'documents'), 'doc_id', 'text').select(
        F.col('doc_id').alias('file_id'), F.lit('local').alias('url'), F.col('text').alias('content'))
    return scan_files(files, ['api_keys', 'credentials', 'emails', 'ip_addresses']).select(*PATTERN_COLUMNS)


def _documents_sql():
    families = ['api_keys', 'credentials', 'emails', 'ip_addresses']
    source = "corpus AS (SELECT doc_id AS file_id, 'local' AS url, text AS content FROM documents)"
    ctes = [source] + [O.family_cte(f) for f in families]
    union = ' UNION ALL '.join(f'SELECT * FROM f_{f}' for f in families)
    return f"WITH {', '.join(ctes)} SELECT {', '.join(PATTERN_COLUMNS)} FROM ({union})"


LEGACY_PATTERN_FAMILIES = ['api_keys', 'credentials', 'comments', 'xss_sinks']


@query('scan_patterns_legacy', lambda: raw_sql(LEGACY_PATTERN_FAMILIES, f"""
    SELECT file_id, family, CAST(ord AS INTEGER) AS rule_ord, match_ord, label AS type, match, line, severity,
        {O.context('greatest(0, line - 3)', 'least(len(lines), line + 2)')} AS context FROM raw""", 'legacy'))
def _legacy(spark, d):
    return scan_patterns_legacy(corpus(spark, d)).select(
        'file_id', 'family', 'rule_ord', 'match_ord', 'type', 'match', 'line', 'severity', 'context')


@query('scan_endpoints_legacy', lambda: f"""WITH {O.corpus(False)}, {O._endpoints('endpoints', 'found', filtered=False)}
    SELECT file_id, rule_ord, match_ord, method, path, full_match, line FROM found""")
def _legacy_endpoints(spark, d):
    return scan_endpoints_legacy(corpus(spark, d)).select('file_id', 'rule_ord', 'match_ord', 'method', 'path', 'full_match', 'line')


@query('resolve_script_refs', lambda: f"""WITH {O.corpus(False)}, {O.matches('m', O._rule_values(family_rules('script_refs')))},
    {_resolved('m', O._group(1))} SELECT DISTINCT file_id, script_url FROM resolved""")
def _resolve(spark, d):
    return S.resolve_script_refs(corpus(spark, d)).select('file_id', 'script_url')


def _resolved(source: str, ref: str) -> str:
    """References of the tables are absolute, host-relative or root-relative."""
    return f"""resolved AS (SELECT file_id, CASE WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN ref
        WHEN starts_with(ref, '//') THEN regexp_extract(url, '^([^:]+:)', 1) || ref
        WHEN starts_with(ref, '/') THEN regexp_extract(url, '^([^:]+://[^/?#]*)', 1) || ref END AS script_url
        FROM (SELECT file_id, url, {ref} AS ref FROM {source}))"""


@query('distinct_script_urls', lambda: f"""WITH {O.corpus(False)}, {O.matches('m', O._rule_values(family_rules('script_refs')))},
    {_resolved('m', O._group(1))} SELECT DISTINCT script_url FROM resolved""")
def _distinct_scripts(spark, d):
    return S.distinct_script_urls(corpus(spark, d))


@query('scan_meta_csp', lambda: f"""WITH {O.corpus(False)}, metas AS (SELECT file_id, nullif(regexp_extract(content,
    {O.q(O.re2(O.R.META_CSP))}, 1), '') AS policy FROM corpus) SELECT file_id, policy AS raw, {O.csp_weaknesses('policy')} AS weaknesses
    FROM metas WHERE policy IS NOT NULL""")
def _meta(spark, d):
    return S.scan_meta_csp(corpus(spark, d)).select('file_id', F.col('csp_info.raw').alias('raw'),
                                                    F.array_join('csp_info.weaknesses', '|').alias('weaknesses'))


# --- sources ---------------------------------------------------------------------------

_FOLDERS = 256  # of the tree of files


@query('scan_code_files', 'SELECT page_id, length(html) + 1 AS n_chars, md5(html || chr(10)) AS digest FROM pages')
def _code_files(spark, d):
    """Every page written as a file of its own, every fifth with bytes that are not UTF-8, and read as a tree of files."""
    path = f'{shared_folder(spark)}/tree-{uuid.uuid4().hex}'
    noise = F.when(F.col('page_id') % 5 == 0, F.lit(bytearray(b'\xff\xfe')).cast('string')).otherwise(F.lit(''))
    found = table(spark, d, 'pages')
    texts = found.select('page_id', F.concat(noise, 'html', noise).alias('text'),
                         F.pmod(F.xxhash64('page_id'), F.lit(_FOLDERS)).alias('folder'))
    # a folder is one task's: it is moved to its place and listed as a whole, not file by file in the driver
    tasks = max(64, 4 * spark.sparkContext.defaultParallelism, found.rdd.getNumPartitions())
    texts.repartition(tasks, 'folder').write.partitionBy('folder', 'page_id').text(path)
    files = scan_code_files(spark, path)
    return files.select(F.regexp_extract('url', 'page_id=([0-9]+)', 1).cast('long').alias('page_id'),
                        F.length('content').cast('long').alias('n_chars'), F.md5(F.col('content').cast('binary')).alias('digest'))


@query('scan_crawl_responses', f"""WITH {O.RESPONSES} SELECT url, status, server, x_powered_by, csp, cf_ray, x_ratelimit_limit,
    x_akamai_trans_id, content_type, content_length, ip, length(body) AS body_chars, CAST(NULL AS VARCHAR) AS error FROM responses WHERE file_id % 9 <> 4
    UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
        'Unreadable record: ' || CASE WHEN file_id % 2 = 0 THEN '{{"url":"' || file_id || '","status":' ELSE 'response ' || file_id END FROM responses WHERE file_id % 9 = 4""")
def _crawl(spark, d):
    """A crawl dump of JSON lines, every ninth of them broken off or no JSON at all."""
    path = f'{shared_folder(spark)}/crawl-{uuid.uuid4().hex}'
    number = F.col('file_id').cast('string')
    broken = F.when(F.col('file_id') % 2 == 0, F.concat(F.lit('{"url":"'), number, F.lit('","status":'))).otherwise(F.concat(F.lit('response '), number))
    record = F.to_json(F.struct('url', 'status', 'headers', 'body', 'ip'))
    responses(spark, d).select(F.when(F.col('file_id') % 9 == 4, broken).otherwise(record).alias('value')).write.text(path)
    names = {'server': 'Server', 'x_powered_by': 'X-Powered-By', 'csp': 'Content-Security-Policy', 'cf_ray': 'CF-RAY',
             'x_ratelimit_limit': 'X-RateLimit-Limit', 'x_akamai_trans_id': 'X-Akamai-Trans-Id', 'content_type': 'Content-Type',
             'content_length': 'Content-Length'}
    return scan_crawl_responses(spark, path, 'json').select('url', 'status', *[H.header_get(F.col('headers'), n).alias(c) for c, n in names.items()],
                                      'ip', F.length('body').cast('long').alias('body_chars'), 'error')


_LINES = r"string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')"


@query('scan_url_list', f"""WITH l AS (SELECT doc_id, [u FOR u IN [{O.strip('x')} FOR x IN {_LINES}] IF u <> '' AND NOT starts_with(u, '#')] AS urls
    FROM documents) SELECT doc_id AS list_id, CAST(i AS INTEGER) AS pos, urls[i + 1] AS url FROM (SELECT *, unnest(range(len(urls))) AS i FROM l)""")
def _url_list(spark, d):
    return scan_url_list(documents(spark, d).select(F.col('doc_id').alias('list_id'), F.col('text').alias('content')))


_PAYLOAD = """CASE page_id % 5
    WHEN 0 THEN concat('{"url": "  ', url, ' "}')
    WHEN 1 THEN concat('{"urls": ["', url, '", " ", 7, "http://0.0.0.0:80/', CAST(page_id AS STRING), '"], "url": "x"}')
    WHEN 2 THEN concat('{"urls": "', url, '"}')
    WHEN 3 THEN concat('{"urls": [], "url": "http://user@0.0.0.0/', CAST(page_id AS STRING), '?q=0.0.0.0"}')
    ELSE '{"other": 1}' END"""


@query('scan_request_payloads', f"""WITH p AS (SELECT page_id, CAST({_PAYLOAD} AS JSON) AS j FROM pages),
    c AS (SELECT page_id, CASE WHEN json_type(j, '$.urls') = 'VARCHAR' THEN [json_extract_string(j, '$.urls')]
        WHEN json_array_length(j, '$.urls') > 0 THEN [json_extract_string(x, '$') FOR x IN CAST(json_extract(j, '$.urls') AS JSON[]) IF json_type(x) = 'VARCHAR']
        ELSE [json_extract_string(j, '$.url')] END AS urls FROM p),
    t AS (SELECT page_id, [{O.strip('u')} FOR u IN urls IF u IS NOT NULL AND {O.strip('u')} <> ''] AS urls FROM c)
    SELECT page_id AS payload_id, CAST(i AS INTEGER) AS pos,
        regexp_replace(urls[i + 1], '^(https?://)0[.]0[.]0[.]0', '\\1127.0.0.1') AS url FROM (SELECT *, unnest(range(len(urls))) AS i FROM t)""")
def _payloads(spark, d):
    return scan_request_payloads(table(spark, d, 'pages').select(F.col('page_id').alias('payload_id'), F.expr(_PAYLOAD).alias('payload')))


@query('route_inputs', lambda: f"""WITH {O.corpus(False)} SELECT file_id, CASE WHEN regexp_matches(lower(url),
    '[.](js|html|htm|json|php|ts|jsx|tsx|vue|map)$') OR len([x FOR x IN {_LINES.replace('text', 'content')} IF {O.strip('x')} <> ''
    AND NOT starts_with({O.strip('x')}, '#')]) = 0 THEN 'content' ELSE 'urls' END AS route FROM corpus""")
def _route(spark, d):
    return route_inputs(corpus(spark, d).withColumnRenamed('url', 'name')).select('file_id', 'route')


@query('cap_body_size', f"""WITH {O.RESPONSES}, s AS (SELECT *, CAST(content_length AS DOUBLE) / 1048576 AS mb FROM responses)
    SELECT file_id, CASE WHEN mb > 10 THEN format('File too large ({{:.1f}}MB). Max limit is 10MB.', mb) END AS fetch_error,
    CASE WHEN mb <= 10 THEN length(body) END AS body_chars FROM s""")
def _cap(spark, d):
    return S.cap_body_size(responses(spark, d)).select('file_id', 'fetch_error', F.length('body').cast('long').alias('body_chars'))


def _catalog_sql(profile: str) -> str:
    table_ = FAMILIES if profile == 'current' else LEGACY_FAMILIES
    rules = {f: family_rules(f, profile) for f in table_}
    rows = ', '.join(f"('{f}', '{r.category}', {r.ord}, {O.q(r.label)}, {r.groups}, {r.last_closed_group}, "
                     f"'{'High' if r.strict or r.severity in ('critical', 'high') else 'Medium'}', {O.q(O.technique(r.label))})"
                     for f, rs in rules.items() for r in rs)
    return O.with_matches(rules, f""", catalog(family, category, ord, label, n_groups, last_group, confidence, technique) AS (VALUES {rows})
        SELECT c.family, c.category, CAST(c.ord AS INTEGER) AS ord, c.label, CAST(c.n_groups AS INTEGER) AS n_groups,
        CAST(c.last_group AS INTEGER) AS last_group, c.confidence, c.technique, count(DISTINCT file_id) AS n_files, count(file_id) AS n_matches
        FROM catalog c LEFT JOIN raw ON raw.family = c.family AND raw.ord = c.ord GROUP BY ALL""", False)


def _catalog_use(spark, d, catalog: DataFrame, profile: str) -> DataFrame:
    families = FAMILIES if profile == 'current' else LEGACY_FAMILIES
    rules = {f: family_rules(f, profile) for f in families}
    used = raw_matches(corpus(spark, d), [], rules).groupBy('family', F.col('rule_ord').alias('ord'), 'file_id').agg(
        F.count('*').alias('n')).groupBy('family', 'ord').agg(F.count('*').alias('n_files'), F.sum('n').alias('n_matches'))
    return catalog.join(used, ['family', 'ord'], 'left').fillna(0, ['n_files', 'n_matches']).select(
        'family', 'category', 'ord', 'label', 'n_groups', 'last_group', 'confidence', 'technique', 'n_files', 'n_matches')


@query('rule_catalog', lambda: _catalog_sql('current'))
def _rule_catalog(spark, d):
    """The catalog, with the use of each rule in the corpus."""
    return _catalog_use(spark, d, rule_catalog(spark), 'current')


@query('legacy_rule_catalog', lambda: _catalog_sql('legacy'))
def _legacy_catalog(spark, d):
    return _catalog_use(spark, d, legacy_rule_catalog(spark), 'legacy')


@query('join_rules_files', lambda: raw_sql(list(FAMILIES), "SELECT file_id, family, CAST(ord AS INTEGER) AS rule_ord, label AS type, "
                                           "count(*) AS n_matches FROM raw GROUP BY ALL"))
def _rules_files(spark, d):
    return raw_matches(corpus(spark, d), list(FAMILIES)).groupBy('file_id', 'family', 'rule_ord', 'type').agg(F.count('*').alias('n_matches'))


# --- filters -----------------------------------------------------------------------------

_HOSTS = """CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '//[^/]*', '//0.0.0.0:8080')
    WHEN 2 THEN concat('  ', url) ELSE concat('ftp:', substr(url, position('//' IN url))) END"""


def _host_variants(spark, d):
    return table(spark, d, 'pages').select('page_id', F.expr(_HOSTS).alias('url'))


@query('filter_valid_http_url', f"SELECT page_id, url FROM (SELECT page_id, {_HOSTS} AS url FROM pages) "
                                "WHERE regexp_matches(trim(url), '^https?://[^/?#]') AND NOT regexp_matches(trim(url), '^https?://0[.]0[.]0[.]0')")
def _valid_url(spark, d):
    return _host_variants(spark, d).where(U.is_valid_http_url(F.col('url')))


@query('normalize_local_url', f"SELECT page_id, CASE WHEN regexp_matches(trim(url), '^https?://0[.]0[.]0[.]0') THEN "
                              "replace(trim(url), '//0.0.0.0', '//127.0.0.1') ELSE url END AS normal, replace(url, '0.0.0.0', 'localhost') AS fetched "
                              f"FROM (SELECT page_id, {_HOSTS} AS url FROM pages)")
def _local_url(spark, d):
    return _host_variants(spark, d).select('page_id', U.normalize_local_url(F.col('url')).alias('normal'), U.fetch_url(F.col('url')).alias('fetched'))


_DOC_SIZE = "CASE WHEN coalesce(length(text), 0) = 0 THEN true WHEN length(text) < 50 THEN false WHEN length(text) > 500000 THEN true END"


@query('filter_relevance_heuristic', f"SELECT doc_id, {_DOC_SIZE} AS relevant FROM documents")
def _heuristic(spark, d):
    return V.filter_relevance_heuristic(table(spark, d, 'documents').withColumnRenamed('text', 'content')).select('doc_id', 'relevant')


# a score that both sides can compute: the share of letters, relevant from 0.8 on
_SHARE = "(CAST(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS DOUBLE) / greatest(length(text), 1))"


@query('gate_skipped_files', lambda: f"""WITH corpus AS (SELECT doc_id AS file_id, source AS url, text AS content FROM documents), {O.family_cte('emails')},
    s AS (SELECT doc_id AS file_id, length(text) > 0 AND {_SHARE} < 0.8 AS skipped, {_SHARE} AS score FROM documents)
    SELECT s.file_id, skipped, CASE WHEN skipped THEN 'Skipped by ML Filter (Low relevance score: ' || format('{{:.2f}}', score) || ')' END AS error,
        count(f.file_id) FILTER (NOT skipped) AS n_findings FROM s LEFT JOIN f_emails f ON f.file_id = s.file_id GROUP BY s.file_id, skipped, score""")
def _gate(spark, d):
    """Every document scored; a skipped one is listed with its score, its error line and no findings."""
    files = documents(spark, d).select(F.col('doc_id').alias('file_id'), F.col('source').alias('url'), F.col('text').alias('content'))
    size = F.length('content')
    score = F.length(F.regexp_replace('content', '[^A-Za-z]', '')) / F.greatest(size, F.lit(1))
    gated = V.gate_skipped_files(files.withColumn('relevance_score', score).withColumn('relevant', ~((size > 0) & (F.col('relevance_score') < 0.8))))
    found_ = scan_files(gated.where('not skipped'), ['emails'], with_text=False).groupBy('file_id').agg(F.count('*').alias('n_findings'))
    return gated.select('file_id', 'skipped', F.nullif(F.array_join('errors', ''), F.lit('')).alias('error')).join(found_, 'file_id', 'left') \
        .fillna(0, ['n_findings'])


CHECKED = ['api_keys', 'credentials', 'comments', 'libraries', 'obfuscation']


# Matches with an ending by file, so that every filter has something to drop.
_ENDING = """CASE CAST(file_id % 6 AS INT) WHEN 0 THEN concat(match, ' Your_API_Key') WHEN 1 THEN concat(match, 'x123456789')
    WHEN 2 THEN concat(match, '@LocalHost') WHEN 3 THEN concat(match, 'Undefined') WHEN 4 THEN concat(match, '.PlaceHolder') ELSE match END"""


def _fp_query(name: str, families: list[str], flag, condition: Callable[[], str], variant: str = _ENDING) -> None:
    """Matches and whether a filter drops them, out of all matches before filters."""
    def build(spark, d):
        rows = raw_matches(corpus(spark, d), families).withColumn('text', F.expr(variant))
        return rows.select('family', 'file_id', 'rule_ord', 'match_ord', 'type', 'text', flag(F.col('text'), F.col('type')).alias('dropped'))
    QUERIES[name] = build
    ORACLE[name] = lambda: raw_sql(families, f"""SELECT family, file_id, CAST(ord AS INTEGER) AS rule_ord, match_ord, label AS type, text,
        {condition()} AS dropped FROM (SELECT *, {variant} AS text FROM raw)""")


_LOW = 'lower(text)'
_fp_query('filter_fp_general', CHECKED, lambda m, t: P.fp_general(m), lambda: O.any_of(_LOW, W.FP_GENERAL))
_fp_query('filter_fp_placeholder', CHECKED, lambda m, t: P.fp_placeholder(m), lambda: O.any_of(_LOW, W.FP_PLACEHOLDERS))
_fp_query('filter_endpoint_fp', ['endpoints'], lambda m, t: P.fp_endpoint(m), lambda: O.any_of(_LOW, W.FP_ENDPOINT_WORDS))
_fp_query('filter_path_fp', ['paths'], lambda m, t: P.fp_path(m), lambda: O.any_of(_LOW, W.FP_PATH_WORDS))
_fp_query('filter_fp_css_object', ['parameters'], lambda m, t: P.fp_css_object(m, t),
          lambda: f"(label = 'Object Parameters' AND {O.any_of(_LOW, [p + ':' for p in W.CSS_PROPERTIES])})")
_fp_query('filter_fp_jwt', CHECKED, lambda m, t: P.fp_jwt(m, t),
          lambda: "(label = 'JWT Token' AND (len(string_split(text, '.')) < 3 OR length(text) < 50))",
          'substr(match, 1, CAST(20 + file_id % 90 AS INT))')


@query('filter_fp_credential', lambda: _credential_sql())
def _credential(spark, d):
    """Every line of the documents and the corpus, judged as if it were a credential match."""
    texts = documents(spark, d).select('doc_id', F.lit('documents').alias('source'), 'text').unionByName(
        corpus(spark, d).select(F.col('file_id').alias('doc_id'), F.lit('corpus').alias('source'), F.col('content').alias('text')))
    lines = texts.select('doc_id', 'source', F.posexplode(F.split('text', '\n')).alias('pos', 'match'))
    return lines.withColumn('dropped', P.fp_credential(F.col('match'), F.lit('Password'))).where('dropped').select('doc_id', 'source', 'pos', 'match')


def _credential_sql():
    low = 'lower(match)'
    return f"""WITH {O.corpus(False)}, l AS (SELECT doc_id, source, CAST(i AS INTEGER) AS pos, lines[i + 1] AS match FROM (SELECT doc_id, source, lines, unnest(range(len(lines))) AS i
        FROM (SELECT doc_id, 'documents' AS source, string_split(text, chr(10)) AS lines FROM documents
            UNION ALL SELECT file_id, 'corpus', string_split(content, chr(10)) FROM corpus)))
        SELECT doc_id, source, pos, match FROM l WHERE regexp_matches({low}, {O.q(O.re2(W.FP_CREDENTIAL_EMPTY, False))})
        OR regexp_matches({low}, {O.q(O.re2(W.FP_CREDENTIAL_DECLARATION, False))})
        OR (regexp_matches({low}, {O.q(O.re2(W.FP_CREDENTIAL_CALL, False))}) AND NOT regexp_matches({low}, '["'']'))"""


@query('fp_filter_gate', lambda: raw_sql(PATTERN_FAMILIES, f"""SELECT family, CAST(ord AS INTEGER) AS rule_ord, label AS type, checks_fp,
    count(*) AS n_matches, count(*) FILTER (checks_fp AND {O.fp('match', 'label')}) AS n_dropped FROM raw GROUP BY ALL"""))
def _fp_gate(spark, d):
    dropped = F.col('checks_fp') & P.is_false_positive(F.col('match'), F.col('type'))
    return raw_matches(corpus(spark, d), PATTERN_FAMILIES).groupBy('family', 'rule_ord', 'type', 'checks_fp').agg(
        F.count('*').alias('n_matches'), F.count_if(dropped).alias('n_dropped'))


_WORDS = r"""w AS (SELECT doc_id, CAST(i AS INTEGER) AS pos, words[i + 1] AS word FROM (SELECT doc_id, words, unnest(range(len(words))) AS i
    FROM (SELECT doc_id, string_split_regex(text, '[ \n]') AS words FROM documents)))"""


def _words(spark, d):
    return documents(spark, d).select('doc_id', F.posexplode(F.split('text', '[ \n]', -1)).alias('pos', 'word'))


@query('filter_css_property_names', lambda: f"WITH {O.corpus(False)}, {O.matches('m', O._rule_values(family_rules('parameters')))} "
       f"SELECT file_id, CAST(ord AS INTEGER) AS rule_ord, match_ord, match, {_lead()} AS name FROM m "
       f"WHERE lower({_lead()}) NOT IN ({', '.join(map(O.q, W.CSS_PROPERTIES))})")
def _css_names(spark, d):
    """Parameter matches whose leading word is no style property: an anti join to the property table."""
    lead = F.regexp_extract('match', r'([A-Za-z\-]+)', 1)
    raw = raw_matches(corpus(spark, d), ['parameters']).select('file_id', 'rule_ord', 'match_ord', 'match', lead.alias('name'))
    return join_css_props(raw)


def _lead() -> str:
    return r"regexp_extract(match, '([A-Za-z\-]+)', 1)"


def join_css_props(parameters: DataFrame) -> DataFrame:
    properties = F.broadcast(css_properties(parameters.sparkSession))
    return parameters.join(properties, F.lower('name') == F.col('property'), 'left_anti')


@query('join_css_props', lambda: f"WITH {_WORDS} SELECT doc_id, pos, word AS name FROM w WHERE lower(word) NOT IN ({', '.join(map(O.q, W.CSS_PROPERTIES))})")
def _css_join(spark, d):
    return join_css_props(_words(spark, d).withColumnRenamed('word', 'name'))


_CSS_WORD = """CASE CAST(pos % 50 AS INT) WHEN 0 THEN '"1.5EM"' WHEN 1 THEN '-12px' WHEN 2 THEN 'Hidden' WHEN 3 THEN '12pxx' WHEN 4 THEN '50%'
    ELSE word END"""


@query('filter_css_values', lambda: f"WITH {_WORDS} SELECT doc_id, pos, value FROM (SELECT *, {_CSS_WORD} AS value FROM w) WHERE {O.css_value('value')}")
def _css_values(spark, d):
    """Words of the documents, some of them turned into style values by their place."""
    return _words(spark, d).select('doc_id', 'pos', F.expr(_CSS_WORD).alias('value')).where(P.is_css_value(F.col('value')))


_SUB = """CASE page_id % 6 WHEN 0 THEN concat('https://api.', regexp_extract(url, '//([^/?#]*)', 1), '/v1') WHEN 1 THEN url
    WHEN 2 THEN concat('//WWW.', regexp_extract(url, '//([^/?#]*)', 1), ':8443/x') WHEN 3 THEN '/static/a.js'
    WHEN 4 THEN concat('http://x.y.', regexp_extract(url, '//([^/?#]*)', 1)) ELSE concat('https://evil', regexp_extract(url, '//([^/?#]*)', 1)) END"""


@query('is_subdomain', f"SELECT page_id, target, {O.is_subdomain('target', 'url')} AS below FROM (SELECT page_id, url, {_SUB} AS target FROM pages)")
def _is_sub(spark, d):
    return table(spark, d, 'pages').select('page_id', F.expr(_SUB).alias('target'), 'url').select(
        'page_id', 'target', U.is_subdomain(F.col('target'), F.col('url')).alias('below'))


@query('filter_subdomains', f"SELECT page_id, target FROM (SELECT page_id, url, {_SUB} AS target FROM pages) WHERE NOT {O.is_subdomain('target', 'url')}")
def _no_sub(spark, d):
    return table(spark, d, 'pages').select('page_id', F.expr(_SUB).alias('target'), 'url').where(
        ~U.is_subdomain(F.col('target'), F.col('url'))).select('page_id', 'target')


_CANDIDATES = lambda: f"WITH {O.corpus(False)}, {O.matches('m', O._one_rule(O.R.ENTROPY_CANDIDATE, 'x'))}"


@query('filter_entropy_candidates', lambda: f"""{_CANDIDATES()} SELECT file_id, match_ord, {O._group(1)} AS candidate FROM m
    WHERE NOT starts_with({O._group(1)}, 'http') QUALIFY row_number() OVER (PARTITION BY file_id, {O._group(1)} ORDER BY match_ord) = 1""")
def _entropy_candidates(spark, d):
    raw = raw_matches(corpus(spark, d), ['entropy']).where(P.is_entropy_candidate(F.col('one')))
    return D.dedup_first(raw, ['file_id', 'one']).select('file_id', 'match_ord', F.col('one').alias('candidate'))


@query('dedup_first_candidates', lambda: f"""{_CANDIDATES()} SELECT file_id, match_ord, line, match FROM m
    QUALIFY row_number() OVER (PARTITION BY file_id, match ORDER BY match_ord) = 1""")
def _dedup_candidates(spark, d):
    return D.dedup_first_candidates(raw_matches(corpus(spark, d), ['entropy'])).select('file_id', 'match_ord', 'line', 'match')


@query('filter_base64_candidates', lambda: f"""WITH {O.corpus(False)}, {O.matches('m', O._one_rule(O.R.BASE64_CANDIDATE, 'x'))},
    t AS (SELECT file_id, match_ord, trim(match, '"''') AS candidate FROM m), c AS (SELECT *, CAST(from_base64(candidate) AS VARCHAR) AS blob FROM t
    WHERE length(candidate) >= 20) SELECT file_id, match_ord, candidate, CASE WHEN NOT contains(blob, '\\x') THEN blob END AS decoded FROM c""")
def _base64_candidates(spark, d):
    raw = raw_matches(corpus(spark, d), ['base64']).withColumn('candidate', strip_quotes(F.col('match')))
    return raw.where(F.length('candidate') >= 20).select('file_id', 'match_ord', 'candidate', base64_text(F.col('candidate')).alias('decoded'))


@query('base64_text', r"""SELECT doc_id, CASE WHEN NOT regexp_matches(t,
    '[\p{C}\p{Zl}\p{Zp}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]') THEN t END AS decoded
    FROM (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents WHERE text <> '')""")
def _base64_text(spark, d):
    """Round trip of whole documents, line breaks as blanks; null where one can't be printed."""
    text = F.translate('text', '\n', ' ').cast('binary')
    return documents(spark, d).where("text <> ''").select(
        'doc_id', base64_text(F.translate(F.base64(text), '\r\n', '')).alias('decoded'))


@query('gate_sink_scan_size', """SELECT doc_id, format('Skipped AST analysis for large file ({:.2f}MB). Regex analysis still performed.',
    length(repeat(text, 40)) / 1048576.0) AS error FROM documents WHERE length(repeat(text, 40)) > 1048576""")
def _sink_gate(spark, d):
    """Documents repeated forty times, so that some pass the size limit."""
    files = documents(spark, d).select('doc_id', F.col('doc_id').alias('file_id'), F.lit('').alias('url'), F.repeat('text', F.lit(40)).alias('content'))
    return V.gate_sink_scan_size(files).select(F.col('file_id').alias('doc_id'), 'error')


@query('gate_html_scripts', lambda: f"WITH {O.corpus(False)} SELECT file_id FROM corpus WHERE contains(lower(content), '<script')")
def _html_gate(spark, d):
    return corpus(spark, d).where(F.contains(fold_case(F.col('content')), F.lit('<script'))).select('file_id')


_VIEWS = ['all', *[next((v for v, c in T.VIEWS.items() if c == name), name) for name in T.CATEGORIES]]


@query('filter_by_category', lambda: findings_sql(EVERY, f"""SELECT view, category, file_id, part, rule_ord, match_ord, match
    FROM findings JOIN (VALUES {', '.join(f"('{v}', '{T.VIEWS.get(v, v)}')" for v in _VIEWS)}) AS v(view, shown) ON shown IN ('all', category)"""))
def _by_category(spark, d):
    """Every view of the findings."""
    found = materialize(scan_files(corpus(spark, d), EVERY, with_text=False).select(
        'category', 'file_id', 'part', 'rule_ord', 'match_ord', 'match'))
    views = [T.filter_by_category(found, v).withColumn('view', F.lit(v)) for v in _VIEWS]
    return reduce(DataFrame.unionByName, views)


@query('drop_null_items', "SELECT page_id, len([x FOR x IN [nullif(regexp_extract(url, '[?](.*)$', 1), ''), url, "
                          "nullif(regexp_extract(url, '(#.*)$', 1), '')] IF x IS NOT NULL]) AS n FROM pages")
def _drop_nulls(spark, d):
    part = lambda p: F.nullif(F.regexp_extract('url', p, 1), F.lit(''))
    frame = table(spark, d, 'pages').select('page_id', F.array(part('[?](.*)$'), F.col('url'), part('(#.*)$')).alias('items'))
    return T.drop_null_items(frame, 'items').select('page_id', F.size('items').cast('long').alias('n'))


@query('project_report_params', lambda: findings_sql(['parameters'], 'SELECT file_id, part, rule_ord, match_ord, name AS param_name FROM findings'))
def _params(spark, d):
    return T.project_report_params(scan_files(corpus(spark, d), ['parameters'], with_text=False))


# --- joins -------------------------------------------------------------------------------

LINKED = ['api_keys', 'entropy', 'endpoints']
# the first five endpoints near each key, by rule and place
_NEAR = """, keys AS (SELECT * FROM findings WHERE category = 'api_keys'), eps AS (SELECT * FROM findings WHERE category = 'api_endpoints'),
    near AS (SELECT k.file_id, k.part, k.rule_ord, k.match_ord, k.type, k.line, e.method, e.path, e.line AS e_line,
        row_number() OVER (PARTITION BY k.file_id, k.part, k.rule_ord, k.match_ord ORDER BY e.rule_ord, e.match_ord) AS rk
        FROM keys k JOIN eps e ON e.file_id = k.file_id AND abs(e.line - k.line) <= 20 QUALIFY rk <= 5)"""


@query('join_keys_endpoints', lambda: findings_sql(LINKED, """SELECT k.file_id, k.part, k.rule_ord, k.match_ord,
    CASE WHEN k.file_id IN (SELECT file_id FROM eps) THEN coalesce(related, '') END AS related FROM keys k LEFT JOIN
    (SELECT file_id, part, rule_ord, match_ord, string_agg(method || ' ' || path || ' ' || CAST(e_line AS VARCHAR), '|' ORDER BY rk) AS related
     FROM near GROUP BY ALL) n USING (file_id, part, rule_ord, match_ord)""", _NEAR))
def _link(spark, d):
    found = materialize(scan_files(corpus(spark, d), LINKED, with_text=False), 'file_id')
    related = F.array_join(F.transform('related_endpoints', lambda e: F.concat_ws(' ', e['method'], e['path'], e['line'].cast('string'))), '|')
    return L.join_keys_endpoints(found).select('file_id', 'part', 'rule_ord', 'match_ord', related.alias('related'))


@query('topk_related_endpoints', lambda: findings_sql(LINKED, """SELECT DISTINCT file_id, line AS key_line, CAST(rk AS INTEGER) AS rank, method, path,
    e_line AS line FROM near""", _NEAR))
def _near(spark, d):
    found = materialize(scan_files(corpus(spark, d), LINKED, with_text=False), 'file_id')
    near = L.near_endpoints(found.where("category = 'api_keys'"), found.where("category = 'api_endpoints'"))
    return near.select('file_id', 'key_line', F.posexplode('related_endpoints').alias('pos', 'e')).select(
        'file_id', 'key_line', (F.col('pos') + 1).alias('rank'), 'e.method', 'e.path', 'e.line')


_EXAMPLES = """, examples AS (SELECT file_id, trim(method || ' ' || path) AS example,
    row_number() OVER (PARTITION BY file_id ORDER BY part, rule_ord, match_ord, rk) AS ex FROM near QUALIFY ex <= 3)"""


@query('topk_examples', lambda: findings_sql(LINKED, 'SELECT file_id, CAST(ex AS INTEGER) AS rank, example FROM examples', _NEAR + _EXAMPLES))
def _examples(spark, d):
    found = materialize(scan_files(corpus(spark, d), LINKED, with_text=False), 'file_id')
    return L.topk_examples(L.join_keys_endpoints(found).where(F.size('related_endpoints') > 0))


@query('join_risk_catalog', lambda: findings_sql(['sink_calls'], 'SELECT match AS trigger, cwe, owasp, severity, type AS description, count(*) AS n, '
                                                 'count(DISTINCT file_id) AS n_files FROM findings GROUP BY ALL'))
def _risk(spark, d):
    """Called names of the corpus against the catalog; its last dotted part is the second try."""
    calls = raw_matches(corpus(spark, d), ['sink_calls']).select(
        'file_id', F.explode(triggers(F.col('match'), F.col('rule_ord'))).alias('name'))
    risk = risk_catalog(spark)
    whole = F.broadcast(risk.select(F.col('trigger').alias('_whole'), F.struct(*risk.columns).alias('_by_whole')))
    last = F.broadcast(risk.select(F.col('trigger').alias('_last'), F.struct(*risk.columns).alias('_by_last')))
    joined = (calls.join(whole, F.col('name') == F.col('_whole'), 'left')
              .join(last, F.substring_index('name', '.', -1) == F.col('_last'), 'left')
              .withColumn('risk', F.coalesce('_by_whole', '_by_last')).where(F.col('risk').isNotNull()))
    per_file = joined.groupBy(F.col('name').alias('trigger'), 'risk.cwe', 'risk.owasp', 'risk.severity', 'risk.description', 'file_id') \
        .agg(F.count('*').alias('n'))
    return per_file.groupBy('trigger', 'cwe', 'owasp', 'severity', 'description').agg(F.sum('n').alias('n'), F.count('*').alias('n_files'))


_ROOTS = """, roots AS (SELECT regexp_extract(url, '^([^:]+://[^/?#]*)', 1) || '/' AS root, min(page_id) AS first FROM pages GROUP BY 1)"""


@query('join_root_csp', f"""WITH {O.RESPONSES}{_ROOTS}, r AS (SELECT file_id, csp, content_type,
    (SELECT CASE WHEN first % 2 = 0 THEN 'script-src ''self''' END FROM roots WHERE root = regexp_extract(url, '^([^:]+://[^/?#]*)', 1) || '/') AS root_csp
    FROM responses), c AS (SELECT file_id, CASE WHEN csp IS NULL AND contains(content_type, 'javascript') THEN root_csp ELSE csp END AS raw FROM r)
    SELECT file_id, raw, {O.csp_weaknesses('raw')} AS weaknesses FROM c""")
def _root_csp(spark, d):
    crawl = responses(spark, d).select('file_id', 'url', 'headers')
    roots = (table(spark, d, 'pages').groupBy(U.root_url(F.col('url')).alias('url')).agg(F.min('page_id').alias('first'))
             .select(F.lit(None).cast('long').alias('file_id'), 'url', F.when(F.col('first') % 2 == 0, F.create_map(
                 F.lit('Content-Security-Policy'), F.lit("script-src 'self'"))).otherwise(F.create_map(F.lit('Server'), F.lit('x'))).alias('headers')))
    joined = S.join_root_csp(S.analyze_headers(crawl.unionByName(roots)))
    return joined.where(F.col('file_id').isNotNull()).select(
        'file_id', F.col('csp_info.raw').alias('raw'), F.array_join('csp_info.weaknesses', '|').alias('weaknesses'))


@query('join_local_fallback', """SELECT page_id AS file_id, CASE WHEN page_id % 2 = 0 THEN 'http://127.0.0.1:80/' ELSE 'http://localhost:80/' END
    || CAST(page_id AS VARCHAR) AS url, CASE WHEN page_id % 2 = 0 THEN md5(html) END AS digest FROM pages""")
def _local(spark, d):
    """Every page behind a dead localhost URL; every other one also answers on the loopback address."""
    base = table(spark, d, 'pages').select('page_id', 'html')
    at = lambda host: F.concat(F.lit(f'http://{host}:80/'), F.col('page_id').cast('string')).alias('url')
    dead = base.select(F.col('page_id').alias('file_id'), at('localhost'), F.lit(None).cast('string').alias('body'))
    alive = base.where(F.col('page_id') % 2 == 0).select(F.lit(None).cast('long').alias('file_id'), at('127.0.0.1'), F.col('html').alias('body'))
    return S.join_local_fallback(dead.unionByName(alive)).where(F.col('file_id').isNotNull()).select(
        'file_id', 'url', F.md5(F.col('body').cast('binary')).alias('digest'))


_HEADER_ROWS = f"""WITH {O.RESPONSES}, {O.corpus(False).strip()}, meta AS (SELECT file_id, length(content) AS file_size FROM corpus)
    SELECT file_id, file_size, {O.SERVER_TYPE} AS server_type, x_powered_by, csp AS raw, {O.csp_weaknesses('csp')} AS weaknesses,
    (contains(coalesce(lower(server), ''), 'cloudflare') OR cf_ray IS NOT NULL) AS behind_cdn, {O.PROVIDER} AS provider, ip AS ip_address
    FROM meta JOIN responses USING (file_id)"""


@query('join_findings_responses', _HEADER_ROWS)
def _findings_responses(spark, d):
    joined = S.join_findings_responses(code_corpus(spark, d), S.analyze_headers(responses(spark, d)))
    return joined.select('file_id', F.col('file_size').cast('long').alias('file_size'), F.col('server_info.type').alias('server_type'),
                         F.col('server_info.x_powered_by').alias('x_powered_by'), F.col('csp_info.raw').alias('raw'),
                         F.array_join('csp_info.weaknesses', '|').alias('weaknesses'), F.col('cdn_info').isNotNull().alias('behind_cdn'),
                         F.col('rate_limit_info.provider').alias('provider'), 'ip_address')
