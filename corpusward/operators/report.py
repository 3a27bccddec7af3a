"""Roll-ups and views over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..catalog import technique_descriptions, words as W
from ..functions.labels import refine_technique
from ..functions.text import head

ORDER = ['part', 'rule_ord', 'match_ord']
CATEGORIES = ['api_keys', 'credentials', 'emails', 'interesting_comments', 'xss_vulnerabilities', 'xss_functions',
              'api_endpoints', 'parameters', 'paths_directories', 'server_info_findings', 'libraries',
              'obfuscation_findings']
# View name -> category; views not listed here have the category's own name.  ``all`` and ``errors`` are views too.
VIEWS = {'xss': 'xss_vulnerabilities', 'paths': 'paths_directories', 'comments': 'interesting_comments',
         'server_info': 'server_info_findings', 'obfuscation': 'obfuscation_findings'}
TITLES = {'api_keys': 'API Keys', 'credentials': 'Credentials', 'emails': 'Emails',
          'xss_vulnerabilities': 'XSS Vulnerabilities', 'xss_functions': 'XSS Sinks/Sources',
          'api_endpoints': 'API Endpoints', 'parameters': 'Parameters', 'paths_directories': 'Paths & Directories',
          'interesting_comments': 'Interesting Comments'}


def _in(category: str) -> Column:
    return F.col('category') == category


def filter_by_category(findings: DataFrame, view: str) -> DataFrame:
    """Findings of a view; ``all`` keeps everything."""
    return findings if view == 'all' else findings.where(_in(VIEWS.get(view, view)))


def drop_null_items(frame: DataFrame, column: str) -> DataFrame:
    return frame.withColumn(column, F.array_compact(F.coalesce(column, F.array().cast(frame.schema[column].dataType))))


def project_report_params(findings: DataFrame) -> DataFrame:
    return findings.where(_in('parameters')).select('file_id', *ORDER, F.col('name').alias('param_name'))


def agg_totals(findings: DataFrame, recommendations: DataFrame | None = None) -> DataFrame:
    """Totals over a batch, one row."""
    names = {'api_keys': 'api_keys', 'credentials': 'credentials', 'emails': 'emails', 'xss': 'xss_vulnerabilities',
             'endpoints': 'api_endpoints'}
    rows = findings.select('category')
    if recommendations is not None:
        names['recommendations'] = 'recommendations'
        rows = rows.unionByName(recommendations.select(F.lit('recommendations').alias('category')))
    return rows.agg(*[F.count_if(_in(c)).alias(n) for n, c in names.items()])


def agg_file_summary(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Counts per file, and whether the file is free of issues."""
    counts = findings.groupBy('file_id').agg(
        F.count_if(_in('api_keys')).alias('n_keys'), F.count_if(_in('credentials')).alias('n_credentials'),
        F.count_if(_in('xss_vulnerabilities')).alias('n_sinks'), F.count_if(_in('api_endpoints')).alias('n_endpoints'))
    names = ['n_keys', 'n_credentials', 'n_sinks', 'n_endpoints']
    full = files.select('file_id', 'url').join(counts, 'file_id', 'left').fillna(0, names)
    return full.withColumn('no_issues', sum((F.col(n) for n in names), F.lit(0)) == 0)


def agg_category_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy('file_id', 'category').agg(F.count('*').alias('n'))


def with_titles(counts: DataFrame) -> DataFrame:
    titles = F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair])
    return counts.withColumn('title', F.coalesce(F.try_element_at(titles, F.col('category')), F.col('category')))


def agg_file_status(files: DataFrame) -> DataFrame:
    """files(file_id, url, errors ARRAY) -> OK or the number of errors."""
    n = F.size(F.array_compact(F.coalesce('errors', F.array().cast('array<string>'))))
    return files.select(
        'file_id', F.coalesce('url', F.concat(F.lit('File '), F.col('file_id').cast('string'))).alias('label'),
        F.when(n > 0, F.concat(n.cast('string'), F.lit(' error(s)'))).otherwise(F.lit('OK')).alias('status'))


def refined(findings: DataFrame) -> DataFrame:
    """Findings that name a technique, with the generic one split by label."""
    return findings.where(F.coalesce('technique', F.lit('')) != '') \
        .withColumn('technique', refine_technique(F.col('technique'), F.col('type')))


def agg_by_technique(findings: DataFrame) -> DataFrame:
    """Techniques per file with their finding counts (listed by name when shown)."""
    return refined(findings).groupBy('file_id', 'technique').agg(F.count('*').alias('n'))


#: Categories in the order in which a technique lists their findings.
LISTED = ['api_keys', 'credentials', 'emails', 'xss_vulnerabilities', 'xss_functions', 'api_endpoints', 'parameters', 'paths_directories',
          'interesting_comments', 'server_info_findings', 'libraries', 'obfuscation_findings']
#: Findings in one row of a list.
PAGE = 1000


def list_by_technique(findings: DataFrame, page: int = PAGE) -> DataFrame:
    """(file_id, technique, page, items): the findings of each technique of a file, ``page`` in a row.

    Items are structs of category, place, type, match and line, by category and
    place; techniques sort by name.  Any number of findings goes to pages.
    """
    rows = refined(findings).withColumn('_view', F.array_position(F.lit(LISTED), F.col('category')))
    order = ['_view', *ORDER]
    number = F.row_number().over(Window.partitionBy('file_id', 'technique').orderBy(*order))
    paged = rows.withColumn('page', F.floor((number - 1) / page).cast('int'))
    items = F.sort_array(F.collect_list(F.struct(*order, 'category', 'type', 'match', 'line')))
    return paged.groupBy('file_id', 'technique', 'page').agg(F.transform(items, lambda i: i.dropFields('_view')).alias('items'))


def join_technique_descriptions(techniques: DataFrame) -> DataFrame:
    return techniques.join(F.broadcast(technique_descriptions(techniques.sparkSession)), 'technique', 'left') \
        .withColumn('description', F.coalesce('description', F.lit(W.TECHNIQUE_DEFAULT_DESCRIPTION)))


def display_value(finding_columns: list[str]) -> tuple[Column, Column]:
    """(content, label) shown for a finding: first non-empty of its content columns, else JSON."""
    known = [c for c in ('match', 'parameter', 'value', 'key', 'url', 'path', 'comment') if c in finding_columns]
    content = F.coalesce(*[F.nullif(F.col(c), F.lit('')) for c in known], F.to_json(F.struct(*finding_columns)))
    label = F
    for column, text in [('parameter', 'Parameter'), ('match', 'Match'), ('url', 'URL'), ('path', 'Path')]:
        if column in finding_columns:
            label = label.when(F.coalesce(column, F.lit('')) != '', F.lit(text))
    return content, label.otherwise(F.lit(''))


def _first_by_place(text: Column, chars: int) -> Column:
    """First characters of the texts joined in place order.

    Only as many texts as can matter are joined: the caller passes ranked rows.
    """
    parts = F.transform(F.array_sort(F.collect_list(F.struct('_rank', text.alias('_text')))), lambda e: e['_text'])
    return head(F.array_join(parts, ', '), chars)


def agg_findings_digest(files: DataFrame, findings: DataFrame, recommendations: DataFrame) -> DataFrame:
    """One text per file: counts, the start of the keys' and credentials' matches, titles.

    A digest shows 100 characters of the joined matches, so no more than 100
    findings per file and category can show; the counts are over all of them.
    """
    chars = 100
    secrets = findings.where(F.col('category').isin('api_keys', 'credentials'))
    place = Window.partitionBy('file_id', 'category').orderBy(*ORDER)
    shown = (secrets.withColumn('_rank', F.row_number().over(place)).where(F.col('_rank') <= chars)
             .groupBy('file_id', 'category').agg(_first_by_place(F.col('match'), chars).alias('shown')))
    shown = shown.groupBy('file_id').agg(
        F.max(F.when(_in('api_keys'), F.col('shown'))).alias('shown_keys'),
        F.max(F.when(_in('credentials'), F.col('shown'))).alias('shown_credentials'))
    counts = agg_file_summary(files, findings)
    titles = recommendations.groupBy('file_id').agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct('ord', 'title'))), lambda e: e['title']), '; ').alias('titles'))
    row = counts.join(shown, 'file_id', 'left').join(titles, 'file_id', 'left')

    def line(n: str, text: Column) -> Column:
        return F.when(F.col(n) > 0, text)

    def shown_line(title: str, n: str, column: str) -> Column:
        return line(n, F.concat(F.lit(f'- {title} ('), F.col(n).cast('string'), F.lit('): '), F.col(column), F.lit('...')))

    lines = F.array_compact(F.array(
        shown_line('API Keys', 'n_keys', 'shown_keys'), shown_line('Credentials', 'n_credentials', 'shown_credentials'),
        line('n_sinks', F.concat(F.lit('- XSS Vulnerabilities ('), F.col('n_sinks').cast('string'), F.lit(') found.'))),
        F.concat(F.lit('- Recommendations: '), F.col('titles'))))
    body = F.when(F.size(lines) > 0, F.array_join(lines, '\n')).otherwise(F.lit('No significant security issues found.'))
    title = F.concat(F.lit('File: '), F.coalesce(F.nullif('url', F.lit('')), F.lit('Uploaded File')))
    return row.select('file_id', F.concat(title, F.lit('\n'), body, F.lit('\n')).alias('digest'))


#: Findings in one row of a nested result.
PART = 10_000


def agg_collect_result(files: DataFrame, findings: DataFrame, part_size: int = PART) -> DataFrame:
    """Nested result per file: one array per category, in place order.

    A row holds at most ``part_size`` findings; a file with more has further rows,
    numbered by ``part_no`` from 0, in which categories and places go on.
    """
    keys = {'file_id', 'url', 'category'}
    fields = [*ORDER, *[c for c in findings.columns if c not in keys and c not in ORDER]]
    number = F.row_number().over(Window.partitionBy('file_id').orderBy(F.array_position(F.lit(CATEGORIES), F.col('category')), *ORDER))
    dealt = findings.withColumn('part_no', F.floor((number - 1) / part_size).cast('int'))
    nested = dealt.groupBy('file_id', 'part_no').agg(*[
        F.array_sort(F.collect_list(F.when(_in(c), F.struct(*fields)))).alias(c) for c in CATEGORIES])
    empty = {c: F.coalesce(c, F.array().cast(nested.schema[c].dataType)) for c in CATEGORIES}
    return files.select('file_id', 'url', F.length('content').alias('file_size')) \
        .join(nested, 'file_id', 'left').withColumns({'part_no': F.coalesce('part_no', F.lit(0)), **empty})


def topk_report_items(findings: DataFrame) -> DataFrame:
    """Items a report lists: 10 per category, 20 endpoints, all sinks."""
    place = Window.partitionBy('file_id', 'category').orderBy(*ORDER)
    limits = F.when(_in('api_endpoints'), 20).otherwise(10)
    listed = findings.where(F.col('category').isin('api_keys', 'credentials', 'interesting_comments', 'api_endpoints'))
    sinks = findings.where(_in('xss_vulnerabilities'))
    # the constant bound lets Spark drop rows before the shuffle
    ranked = listed.withColumn('rank', F.row_number().over(place)).where((F.col('rank') <= 20) & (F.col('rank') <= limits))
    return ranked.unionByName(sinks.withColumn('rank', F.row_number().over(place)))


def text_report(files: DataFrame, findings: DataFrame, analyzed_at: str) -> DataFrame:
    """Report lines per file: rows(file_id, section, item, part_no, text).

    ``findings`` come from the older profile (columns category, type, method,
    path, match, line, severity and place).
    """
    sections = [('api_keys', '🔑 API Keys Found: ', 10), ('credentials', '🔐 Credentials Found: ', 10),
                ('interesting_comments', '💬 Interesting Comments: ', 10),
                ('xss_vulnerabilities', '⚠️  XSS Vulnerabilities: ', None), ('api_endpoints', '🌐 API Endpoints: ', 20)]
    number = F
    title = F
    more = F
    for i, (category, text, limit) in enumerate(sections):
        number = number.when(_in(category), F.lit(i + 1))
        title = title.when(_in(category), F.lit(text))
        more = more.when(_in(category), F.lit(limit).cast('int'))
    counts = findings.groupBy('file_id', 'category').agg(F.count('*').alias('n')) \
        .where(F.col('category').isin([s[0] for s in sections]))

    def rows(frame: DataFrame, section, item, part_no, text) -> DataFrame:
        return frame.select('file_id', F.lit(section).alias('section') if isinstance(section, int) else section.alias('section'),
                            item.cast('int').alias('item'), part_no.cast('int').alias('part_no'), text.alias('text'))

    headers = files.select('file_id', F.posexplode(F.array(
        F.lit(''), F.lit('=' * 80), F.concat(F.lit('URL: '), 'url'),
        F.concat(F.lit('File Size: '), F.format_number(F.length('content'), 0), F.lit(' bytes')),
        F.lit(f'Analysis Time: {analyzed_at}'), F.lit('=' * 80), F.lit(''))).alias('no', 'line'))
    out = rows(headers, 0, F.col('no'), F.lit(0), F.col('line'))
    out = out.unionByName(rows(counts, number, F.lit(0), F.lit(0), F.concat(title, F.col('n').cast('string'))))

    line_no = F.concat(F.lit(' (Line '), F.col('line').cast('string'), F.lit(')'))
    severity = F.upper(F.coalesce('severity', F.lit('unknown')))
    first = (F.when(_in('api_endpoints'), F.concat(F.lit('  • ['), 'method', F.lit('] '), 'path', line_no))
             .when(_in('xss_vulnerabilities'), F.concat(F.lit('  • ['), severity, F.lit('] '), 'type', line_no))
             .otherwise(F.concat(F.lit('  • '), 'type', line_no)))
    second = (F.when(F.col('category').isin('api_keys', 'credentials'),
                     F.concat(F.lit('    Match: '), head(F.col('match'), 60), F.lit('...')))
              .when(F.col('category').isin('interesting_comments', 'xss_vulnerabilities'),
                    F.concat(F.lit('    '), head(F.col('match'), 80))))
    items = topk_report_items(findings).withColumn('_texts', F.array_compact(F.array(first, second)))
    items = items.select('file_id', 'category', 'rank', F.posexplode('_texts').alias('no', 'line'))
    out = out.unionByName(rows(items, number, F.col('rank'), F.col('no'), F.col('line')))
    hidden = counts.where(F.col('n') > more)
    out = out.unionByName(rows(hidden, number, F.lit(1_000_000_000), F.lit(0), F.concat(
        F.lit('  ... and '), (F.col('n') - more).cast('string'), F.lit(' more'))))
    out = out.unionByName(rows(counts, number, F.lit(1_000_000_001), F.lit(0), F.lit('')))

    summary = agg_file_summary(files, findings)
    texts = F.when(F.col('no_issues'), F.array(F.lit('✓ No security issues detected'), F.lit(''))).otherwise(F.array(
        F.lit('Summary:'), *[F.concat(F.lit(f'  • {t}: '), F.col(c).cast('string')) for t, c in [
            ('API Keys', 'n_keys'), ('Credentials', 'n_credentials'), ('XSS Vulnerabilities', 'n_sinks'),
            ('API Endpoints', 'n_endpoints')]], F.lit('')))
    closing = summary.select('file_id', F.posexplode(texts).alias('no', 'line'))
    return out.unionByName(rows(closing, 9, F.col('no'), F.lit(0), F.col('line')))


def agg_batch_progress(results: DataFrame) -> DataFrame:
    """results(batch_id, completed BOOLEAN) -> total and completed files per batch."""
    return results.groupBy('batch_id').agg(F.count('*').alias('total'), F.count_if('completed').alias('completed'))
