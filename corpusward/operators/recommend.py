"""Recommendations: one row of flags per file, rules over the flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..catalog import words as W
from .link import join_keys_endpoints, topk_examples


def _has(word: str, text: Column | None = None) -> Column:
    return F.contains(F.coalesce(F.col('type') if text is None else text, F.lit('')), F.lit(word))


def agg_provider_key_counts(findings: DataFrame) -> DataFrame:
    """Keys per provider named in their label, and the rest, per file."""
    keys = findings.where(F.col('category') == 'api_keys')
    providers = {'aws': 'AWS', 'google': 'Google', 'stripe': 'Stripe', 'github': 'GitHub'}
    counts = keys.groupBy('file_id').agg(
        F.count('*').alias('n_keys'), *[F.count_if(_has(w)).alias(f'n_{n}') for n, w in providers.items()])
    named = F.col('n_aws') + F.col('n_google') + F.col('n_stripe') + F.col('n_github')
    return counts.withColumn('n_other', F.col('n_keys') - named)


def agg_sink_class_flags(findings: DataFrame) -> DataFrame:
    """Which kinds of sinks a file has."""
    sinks = findings.where(F.col('category') == 'xss_vulnerabilities')
    return sinks.groupBy('file_id').agg(
        F.bool_or(_has('innerHTML')).alias('has_inner_html'),
        F.bool_or(_has('eval', F.lower('type')) | _has('Function')).alias('has_eval'),
        F.bool_or(_has('document.write')).alias('has_doc_write'),
        F.bool_or(_has('dangerouslySetInnerHTML')).alias('has_react'),
        F.bool_or(_has('v-html')).alias('has_vue'))


def _entries(conditions: dict[str, Column], filled: dict[str, dict[str, Column]]) -> Column:
    """array<struct> of the recommendations whose condition holds, in catalog order."""
    entries = []
    for key, priority, category, title, description in W.RECOMMENDATIONS:
        text: Column = F.lit(description)
        for mark, value in filled.get(key, {}).items():
            before, after = description.split('{' + mark + '}')
            text = F.concat(F.lit(before), value, F.lit(after))
        entries.append(F.when(conditions[key], F.struct(
            F.lit(priority).alias('priority'), F.lit(category).alias('category'),
            F.lit(title).alias('title'), text.alias('description'))))
    return F.array_compact(F.array(*entries))


def recommendations(files: DataFrame, findings: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """rows(file_id, url, ord, priority, category, title, description).

    ``headers`` has one row per file with server_info, csp_info and
    rate_limit_info.  All inputs meet on file_id.  Titles are unique, so
    first-per-title needs no further step.
    """
    keys = agg_provider_key_counts(findings)
    sinks = agg_sink_class_flags(findings)
    credentials = findings.where(F.col('category') == 'credentials').groupBy('file_id').agg(F.count('*').alias('n_credentials'))
    linked = join_keys_endpoints(findings).where(F.size('related_endpoints') > 0)
    examples = topk_examples(linked).groupBy('file_id').agg(
        F.transform(F.array_sort(F.collect_list(F.struct('rank', 'example'))), lambda e: e['example']).alias('examples'))

    flags = files.select('file_id', 'url')
    for part in (keys, sinks, credentials, examples):
        flags = flags.join(part, 'file_id', 'left')
    if headers is not None:
        flags = flags.join(headers.select('file_id', 'server_info', 'csp_info', 'rate_limit_info'), 'file_id', 'left')
        weak, raw = F.col('csp_info.weaknesses'), F.col('csp_info.raw')
        banner, provider = F.col('server_info.x_powered_by'), F.col('rate_limit_info.provider')
    else:
        weak = F.lit(None).cast('array<string>')
        raw = banner = provider = F.lit(None).cast('string')

    sink_flags = ['has_inner_html', 'has_eval', 'has_doc_write', 'has_react', 'has_vue']
    any_class = F.lit(False)
    for flag in sink_flags:
        any_class = any_class | F.col(flag)
    conditions = {
        'aws': F.col('n_aws') > 0, 'google': F.col('n_google') > 0, 'stripe': F.col('n_stripe') > 0,
        'github': F.col('n_github') > 0, 'linked': F.col('examples').isNotNull(), 'generic': F.col('n_other') > 0,
        'credentials': F.col('n_credentials') > 0,
        'inner_html': F.col('has_inner_html'), 'eval': F.col('has_eval'), 'doc_write': F.col('has_doc_write'),
        'react': F.col('has_react'), 'vue': F.col('has_vue'),
        'xss_other': F.col('has_inner_html').isNotNull() & ~any_class,
        'csp_weak': F.size(weak) > 0,
        'csp_missing': F.startswith('url', F.lit('http')) & (F.coalesce(raw, F.lit('')) == ''),
        'banner': banner.isNotNull(),
        'rate_limit': provider.isNotNull() & (provider != 'Unknown'),
    }
    filled = {k: {'n': F.col(f'n_{k}').cast('string')} for k in ('aws', 'google', 'stripe', 'github', 'credentials')}
    filled |= {'linked': {'list': F.array_join('examples', ', ')}, 'csp_weak': {'list': F.array_join(weak, ', ')},
               'banner': {'list': banner}, 'rate_limit': {'list': provider}}
    return flags.select('file_id', 'url', F.posexplode(_entries(conditions, filled)).alias('ord', 'r')) \
        .select('file_id', 'url', 'ord', 'r.*')
