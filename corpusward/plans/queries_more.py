"""Second part of the registry: roll-ups, windows, functions, streams, recommendations."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, functions as F

from ..catalog import custom_rules, family_rules, rule_errors, words as W
from ..functions import headers as H, url as U
from ..functions.labels import confidence_of, refine_technique, technique_of
from ..functions.text import shannon_entropy, strip_quotes
from ..operators import dedup as D, recommend as C, relevance as V, report as T, responses as S
from ..operators.rule_table import scan_rule_table
from ..operators.scan import PATTERN_FAMILIES, context_frame, raw_matches, scan_endpoints_legacy, scan_files, scan_patterns_legacy
from ..sources.results import lookup_batch, lookup_file, sink_results_json, write_bucketed
from ..sources.urls import order_by_file_id
from ..streaming.files import analyze_stream, streamed_findings, streamed_progress
from ..streaming.limiter import exempt_trusted, limit_request_stream, limit_requests
from . import oracle as O
from .analyze import analyze, files_of
from .corpus import code_corpus, request_log, responses, table, table_stream
from .queries import EVERY, ORACLE, QUERIES, _EXAMPLES, _NEAR, corpus, documents, findings_sql, query, raw_sql
from .session import state_in_rocksdb
from .shared import materialize, shared_folder

SUMMARY = ['api_keys', 'entropy', 'credentials', 'xss_sinks', 'sink_calls', 'endpoints']
TOTALS = [*SUMMARY, 'emails', 'ip_addresses']


def found(spark, d, families) -> DataFrame:
    return scan_files(corpus(spark, d), families, with_text=False)


def shared_findings(spark, d, families) -> DataFrame:
    """Findings several steps read: computed once."""
    return materialize(found(spark, d, families), 'file_id')


# --- roll-ups ---------------------------------------------------------------------------

def _count(category: str) -> str:
    return f"count(*) FILTER (category = '{category}')"


@query('agg_totals', lambda: findings_sql(TOTALS, f"""SELECT (SELECT count(*) FROM recs) AS recommendations, {_count('api_keys')} AS api_keys, {_count('credentials')} AS credentials,
    {_count('emails')} AS emails, {_count('xss_vulnerabilities')} AS xss, {_count('api_endpoints')} AS endpoints FROM findings""",
    _recommendation_ctes()))
def _totals(spark, d):
    findings = shared_findings(spark, d, TOTALS)
    return T.agg_totals(findings, _advice(spark, d, findings))


_SUMMARY_SQL = f"""SELECT c.file_id, c.url, {_count('api_keys')} AS n_keys, {_count('credentials')} AS n_credentials,
    {_count('xss_vulnerabilities')} AS n_sinks, {_count('api_endpoints')} AS n_endpoints,
    {_count('api_keys')} + {_count('credentials')} + {_count('xss_vulnerabilities')} + {_count('api_endpoints')} = 0 AS no_issues
    FROM corpus c LEFT JOIN findings f ON f.file_id = c.file_id GROUP BY c.file_id, c.url"""


@query('agg_file_summary', lambda: findings_sql(SUMMARY, _SUMMARY_SQL))
def _summary(spark, d):
    return T.agg_file_summary(code_corpus(spark, d), found(spark, d, SUMMARY))


def _bucketed(spark, frame: DataFrame, name: str) -> DataFrame:
    unique = f'{name}_{uuid.uuid4().hex}'
    return write_bucketed(frame, unique, int(spark.conf.get('spark.sql.shuffle.partitions')), os.path.join(shared_folder(spark), unique))


@query('bucketed_file_summary', lambda: findings_sql(SUMMARY, _SUMMARY_SQL))
def _bucketed_summary(spark, d):
    """The summary from a corpus dealt by file once: scan, counts and join then move nothing."""
    files = _bucketed(spark, code_corpus(spark, d), 'corpus')
    return T.agg_file_summary(files, scan_files(files, SUMMARY, with_text=False))


@query('agg_category_counts', lambda: findings_sql(EVERY, f"""SELECT file_id, category, count(*) AS n, CASE category {' '.join(
    f"WHEN '{c}' THEN {O.q(t)}" for c, t in T.TITLES.items())} ELSE category END AS title FROM findings GROUP BY file_id, category"""))
def _category_counts(spark, d):
    return T.with_titles(T.agg_category_counts(found(spark, d, EVERY)))


@query('agg_file_status', f"""WITH {O.RESPONSES} SELECT file_id, url AS label, CASE WHEN status >= 400 THEN
    CAST(CASE WHEN CAST(content_length AS BIGINT) > 10485760 THEN 2 ELSE 1 END AS VARCHAR) || ' error(s)'
    WHEN CAST(content_length AS BIGINT) > 10485760 THEN '1 error(s)' ELSE 'OK' END AS status FROM responses""")
def _status(spark, d):
    crawl = S.with_status_errors(S.cap_body_size(responses(spark, d)))
    return T.agg_file_status(crawl.withColumn('errors', F.array('fetch_error', 'status_error')))


@query('union_errors', f"""WITH {O.RESPONSES}, e AS (SELECT file_id, status || '' AS code,
    CASE status WHEN 403 THEN 'Access Denied (403 Forbidden). Analyzing returned content.' WHEN 404 THEN 'File not found (404). Analyzing returned content.'
    WHEN 401 THEN 'Unauthorized (401). Analyzing returned content.' WHEN 503 THEN 'Server returned status 503. Analyzing returned content.' END AS a,
    CASE WHEN CAST(content_length AS BIGINT) > 10485760 THEN format('File too large ({{:.1f}}MB). Max limit is 10MB.', CAST(content_length AS DOUBLE) / 1048576) END AS b
    FROM responses) SELECT file_id, array_to_string(list_sort([x FOR x IN [a, b] IF x IS NOT NULL]), '|') AS errors FROM e WHERE a IS NOT NULL OR b IS NOT NULL""")
def _errors(spark, d):
    crawl = S.with_status_errors(S.cap_body_size(responses(spark, d)))
    rows = V.union_errors(crawl.select('file_id', F.col('status_error').alias('error')), crawl.select('file_id', F.col('fetch_error').alias('error')))
    return rows.select('file_id', F.array_join(F.array_sort('errors'), '|').alias('errors'))


def _refined_sql() -> str:
    low = "lower(coalesce(type, ''))"
    cases = ' '.join(f'WHEN {O.any_of(low, marks)} THEN {O.q(name)}' for name, marks in W.TECHNIQUE_REFINEMENT)
    return f"CASE WHEN technique <> {O.q(W.TECHNIQUE_SIGNATURE)} THEN technique {cases} ELSE technique END"


_BY_TECHNIQUE = lambda: f"SELECT file_id, {_refined_sql()} AS technique, count(*) AS n FROM findings WHERE technique IS NOT NULL GROUP BY ALL"


_PAGE = 3


@query('agg_by_technique', lambda: findings_sql(EVERY, f"""SELECT file_id, technique, CAST((n - 1) // {_PAGE} AS INTEGER) AS page, count(*) AS n,
    string_agg(concat(category, '/', type, '/', match, '/', line), chr(10) ORDER BY n) AS items FROM (SELECT *, row_number() OVER (PARTITION BY file_id, technique
        ORDER BY list_position([{', '.join(map(O.q, T.LISTED))}], category), part, rule_ord, match_ord) AS n
        FROM (SELECT * EXCLUDE (technique), {_refined_sql()} AS technique FROM findings WHERE technique IS NOT NULL)) GROUP BY file_id, technique, (n - 1) // {_PAGE}"""))
def _techniques(spark, d):
    """The findings of each technique as lists, here three to a page."""
    pages_ = T.list_by_technique(found(spark, d, EVERY), _PAGE)
    item = F.transform('items', lambda i: F.concat_ws('/', i['category'], i['type'], i['match'], i['line'].cast('string')))
    return pages_.select('file_id', 'technique', 'page', F.size('items').cast('long').alias('n'), F.array_join(item, '\n').alias('items'))


@query('refine_technique', lambda: findings_sql(EVERY, f"SELECT type, technique AS given, {_refined_sql()} AS technique, count(*) AS n FROM findings "
                                                       "WHERE technique IS NOT NULL GROUP BY ALL"))
def _refine(spark, d):
    rows = found(spark, d, EVERY).where(F.col('technique').isNotNull())
    return rows.select('type', F.col('technique').alias('given'), refine_technique(F.col('technique'), F.col('type')).alias('technique')) \
        .groupBy('type', 'given', 'technique').agg(F.count('*').alias('n'))


@query('join_technique_descriptions', lambda: findings_sql(EVERY, f"""SELECT technique, sum(n)::BIGINT AS n, CASE technique {' '.join(
    f'WHEN {O.q(t)} THEN {O.q(x)}' for t, x in W.TECHNIQUE_DESCRIPTIONS)} ELSE {O.q(W.TECHNIQUE_DEFAULT_DESCRIPTION)} END AS description
    FROM ({_BY_TECHNIQUE()}) GROUP BY technique"""))
def _technique_texts(spark, d):
    totals = T.agg_by_technique(found(spark, d, EVERY)).groupBy('technique').agg(F.sum('n').alias('n'))
    return T.join_technique_descriptions(totals)


def _has(word: str, text: str = 'type') -> str:
    return f"contains({text}, {O.q(word)})"


_PROVIDERS = {'aws': 'AWS', 'google': 'Google', 'stripe': 'Stripe', 'github': 'GitHub'}
_PROVIDER_SQL = ('SELECT file_id, count(*) AS n_keys, ' + ', '.join(f"count(*) FILTER ({_has(w)}) AS n_{n}" for n, w in _PROVIDERS.items())
                 + ', count(*) - ' + ' - '.join(f"count(*) FILTER ({_has(w)})" for w in _PROVIDERS.values())
                 + " AS n_other FROM findings WHERE category = 'api_keys' GROUP BY file_id")
_FLAGS_SQL = f"""SELECT file_id, bool_or({_has('innerHTML')}) AS has_inner_html, bool_or({_has('eval', 'lower(type)')} OR {_has('Function')}) AS has_eval,
    bool_or({_has('document.write')}) AS has_doc_write, bool_or({_has('dangerouslySetInnerHTML')}) AS has_react, bool_or({_has('v-html')}) AS has_vue
    FROM findings WHERE category = 'xss_vulnerabilities' GROUP BY file_id"""


@query('agg_provider_key_counts', lambda: findings_sql(['api_keys', 'entropy'], _PROVIDER_SQL))
def _providers(spark, d):
    return C.agg_provider_key_counts(found(spark, d, ['api_keys', 'entropy']))


@query('agg_sink_class_flags', lambda: findings_sql(['xss_sinks', 'sink_calls'], _FLAGS_SQL))
def _flags(spark, d):
    return C.agg_sink_class_flags(found(spark, d, ['xss_sinks', 'sink_calls']))


def _recommendation_ctes() -> str:
    cases = {
        'aws': 'n_aws > 0', 'google': 'n_google > 0', 'stripe': 'n_stripe > 0', 'github': 'n_github > 0', 'linked': 'examples IS NOT NULL',
        'generic': 'n_other > 0', 'credentials': 'n_credentials > 0', 'inner_html': 'has_inner_html', 'eval': 'has_eval',
        'doc_write': 'has_doc_write', 'react': 'has_react', 'vue': 'has_vue',
        'xss_other': 'has_eval IS NOT NULL AND NOT (has_inner_html OR has_eval OR has_doc_write OR has_react OR has_vue)',
        'csp_weak': "weaknesses <> ''", 'csp_missing': "starts_with(url, 'http') AND csp IS NULL", 'banner': 'x_powered_by IS NOT NULL',
        'rate_limit': 'provider IS NOT NULL'}
    values = {'linked': 'examples', 'csp_weak': "replace(weaknesses, '|', ', ')", 'banner': 'x_powered_by', 'rate_limit': 'provider'}
    rows = []
    for i, (key, priority, category, title, text) in enumerate(W.RECOMMENDATIONS):
        said = f"replace(replace({O.q(text)}, '{{n}}', CAST(n_{key} AS VARCHAR)), '{{list}}', '')" if '{n}' in text else \
            f"replace({O.q(text)}, '{{list}}', {values[key]})" if '{list}' in text else O.q(text)
        rows.append(f"SELECT file_id, url, {i} AS no, {O.q(priority)} AS priority, {O.q(category)} AS category, {O.q(title)} AS title, "
                    f"{said} AS description FROM flags WHERE {cases[key]}")
    return f"""{_NEAR}{_EXAMPLES}, ex AS (SELECT file_id, string_agg(example, ', ' ORDER BY ex) AS examples FROM examples GROUP BY file_id),
    {O.RESPONSES}, provider_counts AS ({_PROVIDER_SQL}), sink_flags AS ({_FLAGS_SQL}),
    creds AS (SELECT file_id, count(*) AS n_credentials FROM findings WHERE category = 'credentials' GROUP BY file_id),
    flags AS (SELECT c.file_id, c.url, p.* EXCLUDE (file_id), s.* EXCLUDE (file_id), n_credentials, examples, csp, x_powered_by,
        {O.csp_weaknesses('csp')} AS weaknesses, {O.PROVIDER} AS provider
        FROM corpus c LEFT JOIN provider_counts p USING (file_id) LEFT JOIN sink_flags s USING (file_id) LEFT JOIN creds USING (file_id)
        LEFT JOIN ex USING (file_id) LEFT JOIN responses r USING (file_id)),
    recs AS (SELECT file_id, url, CAST(row_number() OVER (PARTITION BY file_id ORDER BY no) - 1 AS INTEGER) AS ord, priority, category, title, description
        FROM ({' UNION ALL '.join(rows)}))"""


def _advice(spark, d, findings: DataFrame | None = None) -> DataFrame:
    files = code_corpus(spark, d)
    findings = shared_findings(spark, d, SUMMARY) if findings is None else findings
    headers = S.join_findings_responses(files, S.analyze_headers(responses(spark, d)))
    return C.recommendations(files, findings, headers)


@query('recommendations', lambda: findings_sql(SUMMARY, 'SELECT * FROM recs', _recommendation_ctes()))
def _recommendations(spark, d):
    return _advice(spark, d)


@query('dedup_recommendations', lambda: findings_sql(SUMMARY, """SELECT file_id, ord, title, priority FROM (SELECT * FROM recs UNION ALL
    SELECT file_id, url, ord + 100, 'Low' AS priority, category, title, description FROM recs) QUALIFY row_number() OVER (PARTITION BY file_id, title ORDER BY ord) = 1""",
                                                     _recommendation_ctes()))
def _dedup_recs(spark, d):
    """Two passes over the same files: each title counts once, the first one."""
    advice = _advice(spark, d)
    again = advice.withColumns({'ord': F.col('ord') + 100, 'priority': F.lit('Low')})
    return D.dedup_recommendations(advice.unionByName(again)).select('file_id', 'ord', 'title', 'priority')


def _digest_sql() -> str:
    shown = lambda c: (f"(SELECT left(string_agg(match, ', ' ORDER BY part, rule_ord, match_ord), 100) FROM findings f "
                       f"WHERE f.file_id = s.file_id AND f.category = '{c}')")
    return f"""SELECT file_id, 'File: ' || url || chr(10) || coalesce(nullif(concat_ws(chr(10),
        CASE WHEN n_keys > 0 THEN '- API Keys (' || n_keys || '): ' || {shown('api_keys')} || '...' END,
        CASE WHEN n_credentials > 0 THEN '- Credentials (' || n_credentials || '): ' || {shown('credentials')} || '...' END,
        CASE WHEN n_sinks > 0 THEN '- XSS Vulnerabilities (' || n_sinks || ') found.' END,
        '- Recommendations: ' || (SELECT string_agg(title, '; ' ORDER BY ord) FROM recs r WHERE r.file_id = s.file_id)), ''),
        'No significant security issues found.') || chr(10) AS digest FROM ({_SUMMARY_SQL}) s"""


@query('agg_findings_digest', lambda: findings_sql(SUMMARY, _digest_sql(), _recommendation_ctes()))
def _digest(spark, d):
    findings = shared_findings(spark, d, SUMMARY)
    return T.agg_findings_digest(code_corpus(spark, d), findings, _advice(spark, d, findings))


@query('agg_collect_result', lambda: findings_sql(EVERY, f"""SELECT c.file_id, c.url, length(c.content) AS file_size, {', '.join(
    f"count(*) FILTER (category = '{c}') AS n_{c}" for c in T.CATEGORIES)},
    min(match ORDER BY part, rule_ord, match_ord) FILTER (category = 'api_keys') IS NOT NULL AS has_key,
    first(match ORDER BY part, rule_ord, match_ord) FILTER (category = 'api_keys') AS first_key
    FROM corpus c LEFT JOIN findings f ON f.file_id = c.file_id GROUP BY c.file_id, c.url, c.content"""))
def _collect(spark, d):
    """Nested results, shown by the size of each list and the first key."""
    files = corpus(spark, d)
    nested = T.agg_collect_result(files, scan_files(files, EVERY, with_text=False))
    return nested.select('file_id', 'url', F.col('file_size').cast('long').alias('file_size'),
                         *[F.size(c).cast('long').alias(f'n_{c}') for c in T.CATEGORIES],
                         (F.size('api_keys') > 0).alias('has_key'), F.get('api_keys', F.lit(0))['match'].alias('first_key'))


@query('sink_results_json', lambda: findings_sql(['api_keys', 'credentials', 'xss_sinks', 'emails', 'endpoints', 'parameters'], """SELECT c.file_id,
    c.url, count(*) FILTER (category = 'api_keys') AS n_api_keys, count(*) FILTER (category = 'credentials') AS n_credentials,
    count(*) FILTER (category = 'xss_vulnerabilities') AS n_xss_vulnerabilities, count(*) FILTER (category = 'api_endpoints') AS n_api_endpoints,
    count(*) FILTER (category = 'parameters') AS n_parameters FROM corpus c LEFT JOIN findings f ON f.file_id = c.file_id GROUP BY c.file_id, c.url"""))
def _json(spark, d):
    """Nested results written as JSON and read back."""
    files = corpus(spark, d)
    found_ = scan_files(files, ['api_keys', 'credentials', 'xss_sinks', 'emails', 'endpoints', 'parameters'], with_text=False)
    nested = T.agg_collect_result(files, found_)
    path = os.path.join(shared_folder(spark), f'results-{uuid.uuid4().hex}')
    sink_results_json(nested, path)
    return spark.read.schema(nested.schema).json(path).select(
        'file_id', 'url', *[F.size(c).cast('long').alias(f'n_{c}') for c in ('api_keys', 'credentials', 'xss_vulnerabilities', 'api_endpoints', 'parameters')])


LEGACY = ['api_keys', 'credentials', 'comments', 'xss_sinks', 'endpoints']


def _legacy_findings(spark, d):
    files = corpus(spark, d)
    patterns = scan_patterns_legacy(files).withColumn('part', F.lit(0)).select(
        'file_id', 'category', 'part', 'rule_ord', 'match_ord', 'type', F.lit(None).cast('string').alias('method'),
        F.lit(None).cast('string').alias('path'), 'match', 'line', 'severity')
    endpoints = scan_endpoints_legacy(files).select(
        'file_id', 'category', 'part', 'rule_ord', 'match_ord', 'type', 'method', 'path', 'match', 'line', 'severity')
    return materialize(patterns.unionByName(endpoints), 'file_id')


def _legacy_ctes() -> str:
    patterns = {f: family_rules(f, 'legacy') for f in LEGACY[:4]}
    ctes = [O.corpus(False), O._endpoints('endpoints', 'eps', filtered=False)]
    ctes += [O.matches(f'm_{f}', O._rule_values(rules)) for f, rules in patterns.items()]
    union = ' UNION ALL '.join(f"SELECT file_id, '{rules[0].category}' AS category, ord AS rule_ord, match_ord, label AS type, NULL AS method, NULL AS path, "
                               f"match, line, severity FROM m_{f}" for f, rules in patterns.items())
    return f"""WITH {', '.join(ctes)}, findings AS ({union} UNION ALL SELECT file_id, 'api_endpoints', rule_ord, match_ord, NULL, method, path, NULL, line, NULL FROM eps)"""


@query('topk_report_items', lambda: _legacy_ctes() + """ SELECT file_id, category, CAST(row_number() OVER w AS INTEGER) AS rank, rule_ord, match_ord FROM findings
    WINDOW w AS (PARTITION BY file_id, category ORDER BY rule_ord, match_ord)
    QUALIFY category = 'xss_vulnerabilities' OR row_number() OVER w <= CASE category WHEN 'api_endpoints' THEN 20 ELSE 10 END""")
def _report_items(spark, d):
    return T.topk_report_items(_legacy_findings(spark, d)).select('file_id', 'category', 'rank', 'rule_ord', 'match_ord')


@query('sink_text_report', lambda: _text_report_sql())
def _report(spark, d):
    return T.text_report(corpus(spark, d), _legacy_findings(spark, d), '2024-01-01T00:00:00')


def _text_report_sql() -> str:
    sections = [('api_keys', '🔑 API Keys Found: ', 10), ('credentials', '🔐 Credentials Found: ', 10), ('interesting_comments', '💬 Interesting Comments: ', 10),
                ('xss_vulnerabilities', '⚠️  XSS Vulnerabilities: ', 1000000000), ('api_endpoints', '🌐 API Endpoints: ', 20)]
    values = ', '.join(f"('{c}', {i + 1}, {O.q(t)}, {n})" for i, (c, t, n) in enumerate(sections))
    return _legacy_ctes() + f""", sections(category, section, title, lim) AS (VALUES {values}),
    items AS (SELECT f.*, section, lim, row_number() OVER (PARTITION BY file_id, f.category ORDER BY rule_ord, match_ord) AS rank FROM findings f JOIN sections USING (category)),
    counts AS (SELECT file_id, category, section, title, lim, count(*) AS n FROM findings JOIN sections USING (category) GROUP BY ALL),
    head AS (SELECT file_id, unnest(range(7)) AS i, ['', repeat('=', 80), 'URL: ' || url, 'File Size: ' || format('{{:,}}', length(content)) || ' bytes',
        'Analysis Time: 2024-01-01T00:00:00', repeat('=', 80), ''] AS ls FROM corpus),
    tot AS (SELECT c.file_id, count(*) FILTER (category = 'api_keys') AS k, count(*) FILTER (category = 'credentials') AS p,
        count(*) FILTER (category = 'xss_vulnerabilities') AS x, count(*) FILTER (category = 'api_endpoints') AS e
        FROM corpus c LEFT JOIN findings f ON f.file_id = c.file_id GROUP BY c.file_id),
    tail AS (SELECT file_id, CASE WHEN k + p + x + e = 0 THEN ['✓ No security issues detected', ''] ELSE ['Summary:', '  • API Keys: ' || k,
        '  • Credentials: ' || p, '  • XSS Vulnerabilities: ' || x, '  • API Endpoints: ' || e, ''] END AS ls FROM tot),
    tails AS (SELECT file_id, unnest(range(len(ls))) AS i, ls FROM tail),
    out AS (SELECT file_id, 0 AS section, i AS item, 0 AS part_no, ls[i + 1] AS text FROM head
    UNION ALL SELECT file_id, section, 0, 0, title || n FROM counts
    UNION ALL SELECT file_id, section, rank, 0, CASE category WHEN 'api_endpoints' THEN '  • [' || method || '] ' || path
        WHEN 'xss_vulnerabilities' THEN '  • [' || upper(severity) || '] ' || type ELSE '  • ' || type END || ' (Line ' || line || ')' FROM items WHERE rank <= lim
    UNION ALL SELECT file_id, section, rank, 1, CASE WHEN category IN ('api_keys', 'credentials') THEN '    Match: ' || left(match, 60) || '...'
        ELSE '    ' || left(match, 80) END FROM items WHERE rank <= lim AND category <> 'api_endpoints'
    UNION ALL SELECT file_id, section, 1000000000, 0, '  ... and ' || (n - lim) || ' more' FROM counts WHERE n > lim
    UNION ALL SELECT file_id, section, 1000000001, 0, '' FROM counts
    UNION ALL SELECT file_id, 9, i, 0, ls[i + 1] FROM tails)
    SELECT file_id, CAST(section AS INTEGER) AS section, CAST(item AS INTEGER) AS item, CAST(part_no AS INTEGER) AS part_no, text FROM out"""


def _batches(spark, d) -> DataFrame:
    """Pages by the first path segment of their URL, as stored batches."""
    return table(spark, d, 'pages').select(F.regexp_extract('url', '//[^/]*/([a-z]+)', 1).alias('batch_id'),
                                           F.col('page_id').alias('file_id'), 'url', F.length('html').cast('long').alias('file_size'))


def _stored(spark, d) -> str:
    path = os.path.join(shared_folder(spark), f'batches-{uuid.uuid4().hex}')
    _batches(spark, d).write.partitionBy('batch_id').parquet(path)
    return path


_BATCH = "regexp_extract(url, '//[^/]*/([a-z]+)', 1)"


@query('lookup_batch', f"SELECT page_id AS file_id, url, length(html) AS file_size FROM pages WHERE {_BATCH} = 'de'")
def _lookup_batch(spark, d):
    return lookup_batch(spark, _stored(spark, d), 'de').select('file_id', 'url', 'file_size')


@query('lookup_file', f"SELECT page_id AS file_id, url, length(html) AS file_size FROM pages WHERE {_BATCH} = 'fr' AND page_id = 0")
def _lookup_file(spark, d):
    return lookup_file(spark, _stored(spark, d), 'fr', 0).select('file_id', 'url', 'file_size')


@query('agg_batch_progress', f"WITH {O.RESPONSES} SELECT {_BATCH} AS batch_id, count(*) AS total, count(*) FILTER (status < 400) AS completed FROM responses GROUP BY 1")
def _progress(spark, d):
    return T.agg_batch_progress(responses(spark, d).select(F.regexp_extract('url', '//[^/]*/([a-z]+)', 1).alias('batch_id'),
                                                           (F.col('status') < 400).alias('completed')))


# --- windows and order -------------------------------------------------------------------

@query('dedup_first_findings', lambda: raw_sql(PATTERN_FAMILIES, """SELECT file_id, family, CAST(ord AS INTEGER) AS rule_ord, match_ord, line, label AS type, match FROM raw
    QUALIFY row_number() OVER (PARTITION BY file_id, line, match, label ORDER BY ord, match_ord) = 1"""))
def _dedup_findings(spark, d):
    return D.dedup_first_findings(raw_matches(corpus(spark, d), PATTERN_FAMILIES)).select(
        'file_id', 'family', 'rule_ord', 'match_ord', 'line', 'type', 'match')


def _dedup(name: str, family: str, keys: list[str], dedup) -> None:
    """First-wins over raw extraction rows whose path or name is the first group."""
    def build(spark, d):
        rows = raw_matches(corpus(spark, d), [family]).withColumns({'path': F.col('one'), 'name': F.col('one')})
        return dedup(rows).select('file_id', 'rule_ord', 'match_ord', 'line', 'path')
    QUERIES[name] = build
    ORACLE[name] = lambda: (f"WITH {O.corpus(False)}, {O.matches('m', O._rule_values(family_rules(family)))} SELECT file_id, CAST(ord AS INTEGER) AS rule_ord, "
                            f"match_ord, line, {O._group(1)} AS path FROM m QUALIFY row_number() OVER (PARTITION BY file_id, {', '.join(keys)} "
                            "ORDER BY ord, match_ord) = 1")


_G = O._group(1)
_dedup('dedup_first_endpoints', 'endpoints', [_G, 'line'], D.dedup_first_endpoints)
_dedup('dedup_first_paths', 'paths', [_G, 'line', 'label'], D.dedup_first_paths)


@query('dedup_first_params', lambda: f"""WITH {O.corpus(False)}, {O.matches('m', O._rule_values(family_rules('parameters')))}
    SELECT file_id, CAST(ord AS INTEGER) AS rule_ord, match_ord, line, match AS name FROM m
    QUALIFY row_number() OVER (PARTITION BY file_id, match, line, label ORDER BY ord, match_ord) = 1""")
def _dedup_params(spark, d):
    rows = raw_matches(corpus(spark, d), ['parameters']).withColumn('name', F.col('match'))
    return D.dedup_first_params(rows).select('file_id', 'rule_ord', 'match_ord', 'line', 'name')


@query('context_frame', lambda: raw_sql(['comments', 'libraries'], f"""SELECT family, file_id, CAST(ord AS INTEGER) AS rule_ord, match_ord, line,
    {O.context('greatest(0, line - 3)', 'least(len(lines), line + 2)')} AS context FROM raw"""))
def _context(spark, d):
    return context_frame(corpus(spark, d), ['comments', 'libraries'], 2, 2).select(
        'family', 'file_id', 'rule_ord', 'match_ord', 'line', 'context')


_ALL_RULES = ['api_keys', 'credentials', 'emails', 'comments', 'xss_sinks', 'endpoints', 'parameters', 'paths']


def _positions(name: str, families: list[str]) -> None:
    QUERIES[name] = lambda spark, d: raw_matches(corpus(spark, d), families).select('family', 'file_id', 'rule_ord', 'match_ord', 'start', 'line')
    ORACLE[name] = lambda: raw_sql(families, 'SELECT family, file_id, CAST(ord AS INTEGER) AS rule_ord, match_ord, start, line FROM raw')


_positions('running_line_number', _ALL_RULES)
_positions('line_number', ['parameters', 'paths'])


@query('order_by_file_id', 'SELECT CAST(row_number() OVER (ORDER BY page_id) AS BIGINT) AS file_id, page_id, url FROM pages ORDER BY 1')
def _ordered(spark, d):
    """The list's place gives the id; page ids are places already."""
    return order_by_file_id(table(spark, d, 'pages').select('page_id', 'url'), 'page_id').select('file_id', 'page_id', 'url')


# --- functions -----------------------------------------------------------------------------

@query('shannon_entropy', lambda: _entropy_sql())
def _entropy(spark, d):
    words = documents(spark, d).select('doc_id', F.posexplode(F.split('text', '\n', -1)).alias('pos', 'text'))
    return words.select('doc_id', 'pos', F.round(shannon_entropy(F.col('text')), 6).alias('entropy'))


def _entropy_sql() -> str:
    return """WITH l AS (SELECT doc_id, i, lines[i + 1] AS line FROM (SELECT doc_id, lines, unnest(range(len(lines))) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))),
    c AS (SELECT doc_id, i, length(line) AS n, unnest(string_split(line, '')) AS ch FROM l WHERE line <> ''),
    f AS (SELECT doc_id, i, n, ch, count(*) AS k FROM c WHERE unicode(ch) < 256 GROUP BY ALL),
    e AS (SELECT doc_id, i, sum(-(k / n) * log2(k / n)) AS entropy FROM f GROUP BY ALL)
    SELECT l.doc_id, CAST(l.i AS INTEGER) AS pos, round(coalesce(entropy, 0.0), 6) AS entropy FROM l LEFT JOIN e ON e.doc_id = l.doc_id AND e.i = l.i"""


@query('agg_char_entropy', lambda: """WITH c AS (SELECT doc_id, length(text) AS n, unnest(string_split(text, '')) AS ch FROM documents),
    f AS (SELECT doc_id, n, ch, count(*) AS k FROM c WHERE unicode(ch) < 256 GROUP BY ALL)
    SELECT doc_id, count(*) AS n_chars, round(sum(-(k / n) * log2(k / n)), 6) AS entropy FROM f GROUP BY doc_id""")
def _char_entropy(spark, d):
    """Group-by form: character counts are combined before they are shuffled."""
    chars = documents(spark, d).select('doc_id', F.length('text').alias('n'), F.explode(F.split('text', '')).alias('ch'))
    counts = chars.where((F.col('ch') != '') & (F.ascii('ch') < 256)).groupBy('doc_id', 'n', 'ch').agg(F.count('*').alias('k'))
    p = F.col('k') / F.col('n')
    return counts.groupBy('doc_id').agg(F.count('*').alias('n_chars'), F.round(F.sum(-p * F.log2(p)), 6).alias('entropy'))


def _scan_columns(name: str, families: list[str], columns: list[str], shortened: bool = False) -> None:
    QUERIES[name] = lambda spark, d: scan_files(corpus(spark, d), families, shortened=shortened).select(*columns)
    ORACLE[name] = lambda: findings_sql(families, f"SELECT {', '.join(columns)} FROM findings", shortened=shortened)


_PLACE = ['file_id', 'part', 'rule_ord', 'match_ord']
_scan_columns('line_content', ['xss_sinks', 'paths'], [*_PLACE, 'category', 'line', 'line_content'], shortened=True)
_scan_columns('context_lines', ['api_keys', 'libraries'], [*_PLACE, 'category', 'line', 'context_start_line', 'context_end_line'])
_scan_columns('context_snippet', ['obfuscation', 'server_banners'], [*_PLACE, 'category', 'match', 'context'], shortened=True)
_scan_columns('detection_logic', EVERY, [*_PLACE, 'category', 'type', 'method', 'detection_logic'])
_scan_columns('param_name_value', ['parameters'], [*_PLACE, 'type', 'name', 'match'])


@query('technique_of', lambda: raw_sql(PATTERN_FAMILIES, 'SELECT family, CAST(ord AS INTEGER) AS rule_ord, label AS type, count(*) AS n, technique '
                                       'FROM raw GROUP BY ALL'))
def _technique(spark, d):
    rows = raw_matches(corpus(spark, d), PATTERN_FAMILIES).groupBy('family', 'rule_ord', 'type').agg(F.count('*').alias('n'))
    return rows.withColumn('technique', technique_of(F.col('type')))


@query('confidence_of', lambda: raw_sql(PATTERN_FAMILIES, 'SELECT family, CAST(ord AS INTEGER) AS rule_ord, count(*) AS n, confidence FROM raw GROUP BY ALL'))
def _confidence(spark, d):
    from ..catalog import rule_catalog
    catalog = rule_catalog(spark).select('family', F.col('ord').alias('rule_ord'), confidence_of(F.col('strict'), F.col('severity')).alias('confidence'))
    rows = raw_matches(corpus(spark, d), PATTERN_FAMILIES).groupBy('family', 'rule_ord').agg(F.count('*').alias('n'))
    return rows.join(F.broadcast(catalog), ['family', 'rule_ord']).select('family', 'rule_ord', 'n', 'confidence')


@query('last_group', lambda: f"""WITH {O.corpus(False)}, {O.matches('m', O._rule_values(family_rules('parameters')))}
    SELECT CAST(ord AS INTEGER) AS rule_ord, count(*) AS n, CAST(last_group AS INTEGER) AS last_group FROM m GROUP BY ALL""")
def _last_group(spark, d):
    from ..catalog import rule_catalog
    catalog = rule_catalog(spark).where("family = 'parameters'").select(F.col('ord').alias('rule_ord'), 'last_group')
    return raw_matches(corpus(spark, d), ['parameters']).groupBy('rule_ord').agg(F.count('*').alias('n')) \
        .join(F.broadcast(catalog), 'rule_ord').select('rule_ord', 'n', 'last_group')


@query('url_parts', r"SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS scheme, regexp_extract(url, '//([^/?#]*)', 1) AS netloc, "
                    r"regexp_extract(url, '//[^/?#]*([^?#]*)', 1) AS path FROM pages")
def _parts(spark, d):
    url = F.col('url')
    return table(spark, d, 'pages').select('page_id', U.scheme(url).alias('scheme'), U.netloc(url).alias('netloc'), U.url_path(url).alias('path'))


@query('url_directory', f"SELECT page_id, {O.directory('url')} AS directory FROM pages")
def _directory(spark, d):
    return table(spark, d, 'pages').select('page_id', U.url_directory(F.col('url')).alias('directory'))


@query('root_url', "SELECT page_id, regexp_extract(url, '^([^:]+://[^/?#]*)', 1) || '/' AS root FROM pages")
def _root(spark, d):
    return table(spark, d, 'pages').select('page_id', U.root_url(F.col('url')).alias('root'))


_REF = """CASE page_id % 6 WHEN 0 THEN '/static/app.js?v=1' WHEN 1 THEN '//cdn.io/x.js' WHEN 2 THEN 'https://cdn.io/y.js' WHEN 3 THEN 'lib/z.js'
    WHEN 4 THEN './w.js#top' ELSE '?q=1' END"""
_BASE_DIR = "regexp_replace(regexp_extract(url, '^([^:]+://[^/?#]*[^?#]*)', 1), '[^/]*$', '')"


@query('resolve_url', f"""SELECT page_id, CASE page_id % 6 WHEN 0 THEN regexp_extract(url, '^([^:]+://[^/?#]*)', 1) || ref
    WHEN 1 THEN regexp_extract(url, '^([^:]+:)', 1) || ref WHEN 2 THEN ref WHEN 3 THEN {_BASE_DIR} || ref
    WHEN 4 THEN {_BASE_DIR} || 'w.js#top' ELSE regexp_extract(url, '^([^?#]*)', 1) || ref END AS resolved FROM (SELECT *, {_REF} AS ref FROM pages)""")
def _resolve(spark, d):
    return table(spark, d, 'pages').select('page_id', U.resolve_url(F.col('url'), F.expr(_REF)).alias('resolved'))


@query('strip_quotes', """SELECT doc_id, md5(trim(concat('"''', text, '''"'), '"''')) AS digest FROM documents""")
def _strip_quotes(spark, d):
    quoted = F.concat(F.lit('"\''), F.col('text'), F.lit('\'"'))
    return documents(spark, d).select('doc_id', F.md5(strip_quotes(quoted).cast('binary')).alias('digest'))


@query('http_status_message', f"""WITH {O.RESPONSES} SELECT file_id, CASE status WHEN 403 THEN 'Access Denied (403 Forbidden). Analyzing returned content.'
    WHEN 404 THEN 'File not found (404). Analyzing returned content.' WHEN 401 THEN 'Unauthorized (401). Analyzing returned content.'
    WHEN 503 THEN 'Server returned status 503. Analyzing returned content.' END AS status_error FROM responses""")
def _status_message(spark, d):
    return S.with_status_errors(responses(spark, d)).select('file_id', 'status_error')


@query('fetch_error_message', """SELECT page_id, 'Failed to fetch ' || u || '. ' || CASE WHEN page_id % 2 = 0 THEN 'Connection error: x'
    ELSE 'The file may be too large, inaccessible, or the server timed out.' END || CASE WHEN contains(u, '0.0.0.0') THEN
    ' Note: 0.0.0.0 is not a valid address to connect to. Please use ''localhost'' or ''127.0.0.1'' instead. ' ELSE '' END AS error
    FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'http://0.0.0.0/' || page_id ELSE url END AS u FROM pages)""")
def _fetch_error(spark, d):
    i = F.col('page_id')
    url = F.when(i % 3 == 0, F.concat(F.lit('http://0.0.0.0/'), i.cast('string'))).otherwise(F.col('url'))
    return table(spark, d, 'pages').select('page_id', H.fetch_error_message(url, F.when(i % 2 == 0, F.lit('Connection error: x'))).alias('error'))


@query('header_get', f"WITH {O.RESPONSES} SELECT file_id, server, cf_ray FROM responses")
def _header_get(spark, d):
    """Half of the responses spell their header names in lower case."""
    lower = F.when(F.col('file_id') % 2 == 0, F.transform_keys('headers', lambda k, _: F.lower(k))).otherwise(F.col('headers'))
    return responses(spark, d).select('file_id', H.header_get(lower, 'Server').alias('server'), H.header_get(lower, 'CF-RAY').alias('cf_ray'))


@query('analyze_server', f"WITH {O.RESPONSES} SELECT file_id, server AS server_header, {O.SERVER_TYPE} AS type, x_powered_by FROM responses")
def _server(spark, d):
    return responses(spark, d).select('file_id', H.analyze_server(F.col('headers')).alias('s')).select('file_id', 's.server_header', 's.type', 's.x_powered_by')


@query('analyze_csp', f"""WITH {O.RESPONSES} SELECT file_id, csp IS NOT NULL AS is_present, csp AS raw, {O.csp_weaknesses('csp')} AS weaknesses,
    CASE WHEN csp IS NULL THEN 0 ELSE len(string_split(csp, ';')) END AS n_directives FROM responses""")
def _csp(spark, d):
    rows = responses(spark, d).select('file_id', H.analyze_csp(F.col('headers')).alias('c'))
    return rows.select('file_id', 'c.is_present', 'c.raw', F.array_join('c.weaknesses', '|').alias('weaknesses'),
                       F.size('c.directives').cast('long').alias('n_directives'))


@query('analyze_cdn', f"""WITH {O.RESPONSES} SELECT file_id, 'Cloudflare headers detected' AS details FROM responses
    WHERE contains(lower(coalesce(server, '')), 'cloudflare') OR cf_ray IS NOT NULL""")
def _cdn(spark, d):
    rows = responses(spark, d).select('file_id', H.analyze_cdn(F.col('headers')).alias('c')).where(F.col('c').isNotNull())
    return rows.select('file_id', F.array_join('c.details', '|').alias('details'))


@query('analyze_rate_headers', f"""WITH {O.RESPONSES} SELECT file_id, {O.PROVIDER} AS provider, CASE WHEN x_ratelimit_limit IS NOT NULL THEN
    'X-RateLimit-Limit: ' || x_ratelimit_limit WHEN cf_ray IS NOT NULL THEN 'Cloudflare Rate Limiting (inferred from CF-RAY)' ELSE '' END AS details
    FROM responses WHERE {O.PROVIDER} IS NOT NULL""")
def _rate(spark, d):
    rows = responses(spark, d).select('file_id', H.analyze_rate_headers(F.col('headers')).alias('r')).where(F.col('r').isNotNull())
    return rows.select('file_id', 'r.provider', F.array_join('r.details', '|').alias('details'))


_FORWARDED = "CASE page_id % 5 WHEN 0 THEN concat(' 10.0.0.', CAST(page_id % 200 AS STRING), ' , 1.1.1.1') WHEN 1 THEN '' WHEN 2 THEN '::1' WHEN 3 THEN '0.0.0.0, 9.9.9.9' END"


@query('client_ip', f"""SELECT page_id, CASE WHEN ip IN ('', '0.0.0.0', '::', '::1') THEN '127.0.0.1' ELSE ip END AS client FROM (SELECT page_id,
    coalesce(nullif(trim(split_part(coalesce({_FORWARDED}, ''), ',', 1)), ''), '192.168.0.' || (page_id % 100)) AS ip FROM pages)""")
def _client(spark, d):
    remote = F.concat(F.lit('192.168.0.'), (F.col('page_id') % 100).cast('string'))
    return table(spark, d, 'pages').select('page_id', H.client_ip(F.expr(_FORWARDED), remote).alias('client'))


@query('mask_secret', lambda: findings_sql(['api_keys', 'credentials'], f"SELECT file_id, rule_ord, match_ord, category, {O.strip('match')} AS shown FROM findings"))
def _mask(spark, d):
    rows = found(spark, d, ['api_keys', 'credentials'])
    return rows.select('file_id', 'rule_ord', 'match_ord', 'category', H.mask_secret(F.col('match')).alias('shown'))


@query('escape_html', """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;')) AS digest
    FROM pages""")
def _escape(spark, d):
    return table(spark, d, 'pages').select('page_id', F.md5(H.escape_html(F.col('html')).cast('binary')).alias('digest'))


@query('display_value', lambda: findings_sql(['endpoints', 'paths', 'libraries'], """SELECT file_id, part, rule_ord, match_ord, category,
    coalesce(nullif(match, ''), nullif(path, '')) AS shown, CASE WHEN coalesce(match, '') <> '' THEN 'Match' WHEN coalesce(path, '') <> '' THEN 'Path' ELSE '' END AS label
    FROM findings"""))
def _display(spark, d):
    rows = found(spark, d, ['endpoints', 'paths', 'libraries'])
    content, label = T.display_value(['match', 'path'])
    return rows.select('file_id', 'part', 'rule_ord', 'match_ord', 'category', content.alias('shown'), label.alias('label'))


@query('size_mb', "SELECT doc_id, format('{:.2f}', length(repeat(text, 40)) / 1048576.0) AS mb FROM documents")
def _size_mb(spark, d):
    return documents(spark, d).select('doc_id', H.size_mb(F.length(F.repeat('text', F.lit(40)))).alias('mb'))


# --- relevance ------------------------------------------------------------------------------

@query('relevance_score', "SELECT doc_id, true AS relevant, 1.0::DOUBLE AS relevance_score FROM documents")
def _relevance(spark, d):
    """Without a model every file is relevant."""
    files = documents(spark, d).select('doc_id', F.col('text').alias('content'))
    return V.score_relevance(files).select('doc_id', 'relevant', 'relevance_score')


@query('score_relevance')
def _score(spark, d):
    """With the trained model; hash seed and solver differ from other libraries, so only rows compare."""
    return V.score_relevance(corpus(spark, d), V.train_relevance_model(spark)).select('file_id', 'relevant', 'relevance_score')


@query('train_relevance_model')
def _train(spark, d):
    """Share of documents per source the trained model takes for relevant."""
    files = documents(spark, d).select('doc_id', 'source', F.col('text').alias('content'))
    scored = V.score_relevance(files, V.train_relevance_model(spark))
    return scored.groupBy('source').agg(F.count('*').alias('n'), F.count_if('relevant').alias('n_relevant'))


# --- request limiting and streams ---------------------------------------------------------------

LIMIT, WINDOW = 3, 86400

# Greedy admission as a recursion over each key's requests: the log is a list of passed times.
_LIMITER = f"""WITH RECURSIVE r AS (SELECT user_id AS key, event_id, epoch_us(ts) AS us, {{reset}} AS reset, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
    FROM events {{where}}), s AS (SELECT key, event_id, n, reset, CASE WHEN reset THEN CAST([] AS BIGINT[]) ELSE [us] END AS log, NOT reset AS admitted FROM r WHERE n = 1
    UNION ALL SELECT r.key, r.event_id, r.n, r.reset, CASE WHEN r.reset THEN CAST([] AS BIGINT[])
        WHEN len([t FOR t IN log IF t > us - {WINDOW}000000]) < {LIMIT} THEN list_append([t FOR t IN log IF t > us - {WINDOW}000000], us)
        ELSE [t FOR t IN log IF t > us - {WINDOW}000000] END,
        NOT r.reset AND len([t FOR t IN log IF t > us - {WINDOW}000000]) < {LIMIT} FROM s JOIN r ON r.key = s.key AND r.n = s.n + 1)"""


def _limiter_sql(columns: str, reset: str = 'false', where: str = '') -> str:
    return _LIMITER.replace('{reset}', reset).replace('{where}', where) + f' SELECT {columns} FROM s WHERE NOT reset'


_REMAINING = f'CAST(greatest(0, {LIMIT} - len(log)) AS INTEGER) AS remaining'


@query('limit_requests', _limiter_sql('key, event_id, admitted'))
def _limit(spark, d):
    return limit_requests(request_log(spark, d), LIMIT, WINDOW).select('key', 'event_id', 'admitted')


@query('rolling_request_log', _limiter_sql('key, count(*) AS n, count(*) FILTER (admitted) AS n_admitted') + ' GROUP BY key')
def _log(spark, d):
    return limit_requests(request_log(spark, d), LIMIT, WINDOW).groupBy('key').agg(F.count('*').alias('n'), F.count_if('admitted').alias('n_admitted'))


@query('remaining_quota', _limiter_sql(f'key, event_id, {_REMAINING}'))
def _remaining(spark, d):
    return limit_requests(request_log(spark, d), LIMIT, WINDOW).select('key', 'event_id', 'remaining')


@query('exempt_trusted', _limiter_sql('key, event_id, admitted', where="WHERE event_type <> 'view' AND user_id % 10 <> 0"))
def _exempt(spark, d):
    """Views are static paths here, and every tenth client is trusted."""
    log = request_log(spark, d).withColumns({
        'path': F.when(F.col('event_type') == 'view', F.lit('/static/app.js')).otherwise(F.lit('/api/analyze')),
        'trusted': F.col('key') % 10 == 0})
    return limit_requests(exempt_trusted(log).select('key', 'ts', 'event_id'), LIMIT, WINDOW).select('key', 'event_id', 'admitted')


@query('reset_key', _limiter_sql(f'key, event_id, admitted, {_REMAINING}', reset="event_type = 'error'"))
def _reset(spark, d):
    """Error events are the control events that empty a key's log."""
    log = request_log(spark, d).withColumn('reset', F.col('event_type') == 'error').drop('event_type')
    return limit_requests(log, LIMIT, WINDOW).select('key', 'event_id', 'admitted', 'remaining')


@query('limit_request_stream', _limiter_sql(f'key, event_id, admitted, {_REMAINING}'))
def _limit_stream(spark, d):
    """The same decisions, from a stream of the events."""
    log = table_stream(spark, d, 'events').select(F.col('user_id').alias('key'), 'ts', 'event_id')
    return _run_stream(limit_request_stream(log, LIMIT, WINDOW)).select('key', 'event_id', 'admitted', 'remaining')


def _run_stream(frame: DataFrame) -> DataFrame:
    """Run a stream over all available input; the result is read back from files."""
    spark = frame.sparkSession
    path = os.path.join(shared_folder(spark), f'stream-{uuid.uuid4().hex}')
    with state_in_rocksdb(spark):
        (frame.writeStream.format('parquet').option('path', path).option('checkpointLocation', path + '-checkpoint').outputMode('append')
         .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(frame.schema).parquet(path)


def _page_stream(spark, d) -> DataFrame:
    return table_stream(spark, d, 'pages')


def _streamed(spark, d, families: list[str]) -> str:
    """The corpus analysed as a stream of files; the folder of findings and progress."""
    files = code_corpus(spark, d, pages=_page_stream(spark, d)).withColumn('batch_id', F.regexp_extract('url', '//[^/]*/([a-z]+)', 1))
    path = os.path.join(shared_folder(spark), f'stream-{uuid.uuid4().hex}')
    analyze_stream(files, path, f'{path}-checkpoint', families, with_text=False).awaitTermination()
    return path


_STREAMED = ['file_id', 'category', 'part', 'rule_ord', 'match_ord', 'type', 'method', 'path', 'name', 'match', 'line', 'confidence', 'severity']


@query('stream_scan_files', lambda: findings_sql(EVERY, f"SELECT {', '.join(_STREAMED)} FROM findings"))
def _stream_scan(spark, d):
    """All families, from a stream of the corpus."""
    return streamed_findings(spark, _streamed(spark, d, EVERY)).select(*_STREAMED)


@query('stream_batch_progress', f'SELECT {_BATCH} AS batch_id, count(*) AS completed FROM pages GROUP BY 1')
def _stream_progress(spark, d):
    """Progress that the same stream wrote beside its findings."""
    return streamed_progress(spark, _streamed(spark, d, ['emails']))


@query('analyze', lambda: findings_sql(['api_keys', 'entropy', 'endpoints'], f"""SELECT c.file_id, c.url, CASE WHEN c.file_id % 9 <> 4 THEN length(content) END AS file_size, false AS skipped, coalesce(n_keys, 0) AS n_keys,
    coalesce(n_endpoints, 0) AS n_endpoints, csp, {O.PROVIDER} AS provider, concat_ws('|', CASE status
        WHEN 403 THEN 'Access Denied (403 Forbidden). Analyzing returned content.'
        WHEN 404 THEN 'File not found (404). Analyzing returned content.' WHEN 401 THEN 'Unauthorized (401). Analyzing returned content.'
        WHEN 503 THEN 'Server returned status 503. Analyzing returned content.' END, CASE WHEN c.file_id % 9 = 4 THEN 'Failed to fetch ' || c.url
        || '. The file may be too large, inaccessible, or the server timed out.' END) AS errors
    FROM corpus c JOIN responses r USING (file_id) LEFT JOIN (SELECT * FROM n WHERE file_id % 9 <> 4) USING (file_id)""",
    f""", {O.RESPONSES.strip()}, n AS (SELECT file_id, count(*) FILTER (category = 'api_keys') AS n_keys,
    count(*) FILTER (category = 'api_endpoints') AS n_endpoints FROM findings GROUP BY file_id)"""))
def _analyze(spark, d):
    """A crawl to results, errors included; every ninth body is missing.  Shown by sizes."""
    bodies = corpus(spark, d).select('file_id', 'url', F.when(F.col('file_id') % 9 != 4, F.col('content')).alias('body'))
    crawl = responses(spark, d).drop('url', 'body').join(bodies, 'file_id')
    files, analyzed = files_of(crawl)
    findings = materialize(scan_files(files, with_text=False), 'file_id')
    result = analyze(files, analyzed, findings=findings)
    return result.select('file_id', 'url', F.col('file_size').cast('long').alias('file_size'), 'skipped',
                         F.size('api_keys').cast('long').alias('n_keys'), F.size('api_endpoints').cast('long').alias('n_endpoints'),
                         F.col('csp_info.raw').alias('csp'), F.col('rate_limit_info.provider').alias('provider'),
                         F.coalesce(F.array_join('errors', '|'), F.lit('')).alias('errors'))


# expressions with anchors and shorthands, some under labels that built-in rules have too
CUSTOM = [(r'passphrase\s*=\s*\w+', 'Password', True), (r'^var \w+', 'JWT Token', True), (r'[;,]$', 'Line end', True),
          (r'\bfunction\b\W', 'Function', True), (r'\D{3}\.io', 'Email Address', True)]


# what each of these takes from a file needs the text around the match, or Python's own spelling
CUSTOM_ENDPOINTS = [(r'(?<=\bfetch\(["\'])(/api/\w+)', 'after fetch', True)]
CUSTOM_PATHS = [(r'"(/[a-z]+/[a-z]+)(?=";?$)', 'at the end of a line', True)]
CUSTOM_SPELLED = [(r'(?P<word>const|var) \w+', 'named group', True), (r'e{,2}val\(', 'open count', True), (r'[bad', 'no expression', True),
                  (r'</html>\s*\Z', 'very end', True), (r'(a)?(?(1)b|c)', 'choice', True), (r'Q?(?=url:)', 'empty', True)]


def _custom_sql() -> str:
    """RE2 has no look-around: the same matches with what surrounds them as part of the expression and the rest as a group."""
    def around(name: str, regex: str) -> str:
        return f"""{name} AS (SELECT file_id, unnest(range(1, len(lines) + 1)) AS line, unnest(lines) AS text FROM (SELECT file_id, string_split(content, chr(10)) AS lines FROM corpus)),
            {name}_found AS (SELECT DISTINCT file_id, line, unnest(regexp_extract_all(text, {O.q(regex)}, 1)) AS match FROM {name})"""
    spelled = [(r'(const|var) \w+', 'named group', True), (r'e?e?val\(', 'open count', True), (r'</html>\s*\z', 'very end', True)]
    endpoint = r"(?i)(?:^|[^\pL\pN_])fetch\([\"'](/api/[\pL\pN_]+)"
    return f"""WITH {O.corpus(False)}, {O.matches('m', O._rule_values(custom_rules(CUSTOM)))}, {O.matches('n', O._rule_values(custom_rules(spelled)))},
    {around('ends', endpoint)}, {around('tails', r'(?i)"(/[a-z]+/[a-z]+)";?$')}, {around('empty', r'(?i)(Q?)url:')},
    found AS (SELECT file_id, label AS type, match, line, CAST(NULL AS VARCHAR) AS path FROM m QUALIFY row_number() OVER (PARTITION BY file_id, line, match, label ORDER BY ord, match_ord) = 1
    UNION ALL SELECT file_id, label, match, line, NULL FROM n QUALIFY row_number() OVER (PARTITION BY file_id, line, match, label ORDER BY ord, match_ord) = 1
    UNION ALL SELECT file_id, NULL, NULL, line, match FROM ends_found WHERE NOT {O.any_of('lower(match)', W.FP_ENDPOINT_WORDS)}
    UNION ALL SELECT file_id, 'at the end of a line', concat('"', match), line, match FROM tails_found
    UNION ALL SELECT file_id, 'empty', match, line, NULL FROM empty_found)
    SELECT *, CAST(NULL AS VARCHAR) AS error FROM found
    UNION ALL SELECT NULL, 'no expression', NULL, NULL, NULL, 'unterminated character set at position 0'
    UNION ALL SELECT NULL, 'choice', NULL, NULL, NULL, 'not supported: a choice by whether a group matched'"""


@query('scan_custom_rules', _custom_sql)
def _custom(spark, d):
    """Rules of the user's own, with a row for each that can't run."""
    rules = {'custom': custom_rules(CUSTOM), 'spelled': custom_rules(CUSTOM_SPELLED), 'endpoints': custom_rules(CUSTOM_ENDPOINTS), 'paths': custom_rules(CUSTOM_PATHS)}
    found_ = scan_files(corpus(spark, d), rules=rules, with_text=False).select('file_id', 'type', 'match', 'line', 'path', F.lit(None).cast('string').alias('error'))
    wrong = rule_errors(spark, CUSTOM + CUSTOM_SPELLED).select(
        F.lit(None).cast('long').alias('file_id'), 'type', F.lit(None).cast('string').alias('match'), F.lit(None).cast('int').alias('line'),
        F.lit(None).cast('string').alias('path'), 'error')
    return found_.unionByName(wrong)


_NO_WORD = r'\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b'


@query('scan_rule_table', lambda: f"""WITH {O.corpus(False)}, lines AS (SELECT file_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text
        FROM (SELECT file_id, string_split(content, chr(10)) AS l FROM corpus)),
    rules AS (SELECT concat('(?i)items/', s_suppkey, '[?]id=[0-9]+') AS regex, concat('Item ', s_suppkey % 7) AS type FROM supplier)
    SELECT DISTINCT file_id, type, unnest(regexp_extract_all(text, regex)) AS match, line, CAST(NULL AS VARCHAR) AS error FROM lines, rules WHERE contains(lower(text), 'items/')
    UNION ALL SELECT DISTINCT file_id, 'Address', unnest(regexp_extract_all(text, {O.q(_NO_WORD)})), line, NULL FROM lines
    UNION ALL SELECT NULL, 'Broken', NULL, NULL, 'unterminated character set at position 0'""")
def _rule_table(spark, d):
    """A rule per supplier, one rule without a plain word, and one that is none."""
    items = table(spark, d, 'supplier').select(F.concat(F.lit('items/'), F.col('s_suppkey').cast('string'), F.lit(r'\?id=\d+')).alias('regex'),
                                               F.concat(F.lit('Item '), (F.col('s_suppkey') % 7).cast('string')).alias('label'))
    rules = items.unionByName(spark.createDataFrame([(_NO_WORD, 'Address'), ('[bad', 'Broken')], 'regex string, label string')).withColumn('flag', F.lit(True))
    found_, wrong = scan_rule_table(corpus(spark, d), rules, with_text=False)
    return found_.select('file_id', 'type', 'match', 'line', F.lit(None).cast('string').alias('error')).unionByName(wrong.select(
        F.lit(None).cast('long').alias('file_id'), 'type', F.lit(None).cast('string').alias('match'), F.lit(None).cast('int').alias('line'), 'error'))
