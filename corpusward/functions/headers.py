"""Analysis of response headers (a MAP<STRING, STRING>) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..catalog import words as W
from .text import strip


def header_get(headers: Column, name: str) -> Column:
    """Value under the given spelling, else under the all-lower one; no other spelling."""
    return F.coalesce(F.try_element_at(headers, F.lit(name)), F.try_element_at(headers, F.lit(name.lower())))


def _text(headers: Column, name: str) -> Column:
    return F.coalesce(header_get(headers, name), F.lit(''))


def _filled(headers: Column, name: str) -> Column:
    """First non-empty of the two spellings, else null."""
    def spelled(n: str) -> Column:
        return F.nullif(F.try_element_at(headers, F.lit(n)), F.lit(''))
    return F.coalesce(spelled(name), spelled(name.lower()))


def _has_headers(headers: Column) -> Column:
    return F.coalesce(F.size(headers) > 0, F.lit(False))


def analyze_server(headers: Column) -> Column:
    """struct<server_header, type, x_powered_by, technique>; null only without headers."""
    server = F.nullif(_text(headers, 'Server'), F.lit(''))
    kind = F.when(server.isNull(), F.lit(None))
    for mark, name in W.SERVER_TYPES:
        kind = kind.when(F.contains(F.lower(server), F.lit(mark)), F.lit(name))
    return F.when(_has_headers(headers), F.struct(
        server.alias('server_header'), kind.otherwise(F.lit('Unknown')).alias('type'),
        F.nullif(_text(headers, 'X-Powered-By'), F.lit('')).alias('x_powered_by'),
        F.lit(W.TECHNIQUE_HEADERS).alias('technique')))


def csp_directives(policy: Column) -> Column:
    """MAP name -> value of a policy; the last of repeated directives wins."""
    items = F.filter(F.transform(F.split(policy, ';'), strip), lambda d: d != '')
    entries = F.transform(items, lambda d: F.struct(
        F.lower(F.regexp_extract(d, r'^(\S+)', 1)).alias('name'),
        F.regexp_extract(d, r'(?s)^\S+\s+(.*)$', 1).alias('value')))
    last = F.filter(entries, lambda e, i: ~F.exists(
        F.slice(entries, i + 2, F.size(entries)), lambda later: later['name'] == e['name']))
    return F.map_from_entries(last)


def _weaknesses(directives: Column) -> Column:
    script = F.try_element_at(directives, F.lit('script-src'))
    default = F.try_element_at(directives, F.lit('default-src'))

    def holds(value: Column, part: str) -> Column:
        return F.contains(value, F.lit(part))

    short_self = holds(script, "'self'") & (F.length(script) < 10)
    return F.array_compact(F.array(
        F.when(holds(script, "'unsafe-inline'"), F.lit(W.CSP_UNSAFE_INLINE)),
        F.when(holds(script, "'unsafe-eval'"), F.lit(W.CSP_UNSAFE_EVAL)),
        F.when(holds(script, '*') & ~short_self, F.lit(W.CSP_SCRIPT_WILDCARD)),
        F.when(script.isNull() & default.isNull(), F.lit(W.CSP_NO_SOURCE)),
        F.when(holds(default, '*'), F.lit(W.CSP_DEFAULT_WILDCARD))))


def csp_of_policy(policy: Column) -> Column:
    """struct<is_present, raw, directives, weaknesses, technique> of a policy text."""
    present = F.coalesce(policy, F.lit('')) != ''
    directives = F.when(present, csp_directives(policy)).otherwise(F.create_map().cast('map<string,string>'))
    return F.struct(
        present.alias('is_present'), F.when(present, policy).alias('raw'), directives.alias('directives'),
        F.when(present, _weaknesses(csp_directives(policy))).otherwise(F.array(F.lit(W.CSP_MISSING))).alias('weaknesses'),
        F.lit(W.TECHNIQUE_HEADERS).alias('technique'))


def analyze_csp(headers: Column) -> Column:
    return F.when(_has_headers(headers), csp_of_policy(_text(headers, 'Content-Security-Policy')))


def analyze_cdn(headers: Column) -> Column:
    """struct<is_present, details, technique> of the known proxy; null where absent."""
    behind = F.contains(F.lower(_text(headers, 'Server')), F.lit('cloudflare')) | (_text(headers, 'CF-RAY') != '')
    cache = F.nullif(_text(headers, 'CF-Cache-Status'), F.lit(''))
    return F.when(_has_headers(headers) & behind, F.struct(
        F.lit(True).alias('is_present'),
        F.array_compact(F.array(F.lit('Cloudflare headers detected'), F.concat(F.lit('Cache Status: '), cache))).alias('details'),
        F.lit(W.TECHNIQUE_HEADERS).alias('technique')))


def analyze_rate_headers(headers: Column) -> Column:
    """struct<is_present, details, provider, technique>; null where no limit shows."""
    found = F.array_compact(F.array(*[
        F.concat(F.lit(name + ': '), _filled(headers, name)) for name in W.RATE_HEADERS]))
    ray = _filled(headers, 'CF-RAY').isNotNull()
    akamai = F.nullif(F.try_element_at(headers, F.lit('X-Akamai-Trans-Id')), F.lit('')).isNotNull()
    inferred = F.array(F.lit('Cloudflare Rate Limiting (inferred from CF-RAY)'))
    return F.when(_has_headers(headers) & ((F.size(found) > 0) | ray | akamai), F.struct(
        F.lit(True).alias('is_present'),
        F.when((F.size(found) == 0) & ray, inferred).otherwise(found).alias('details'),
        F.when(akamai, F.lit('Akamai')).when(ray, F.lit('Cloudflare')).otherwise(F.lit('Standard/Custom')).alias('provider'),
        F.lit(W.TECHNIQUE_HEADERS).alias('technique')))


def http_status_message(status: Column) -> Column:
    message = F
    for code, text in W.STATUS_MESSAGES:
        message = message.when(status == code, F.lit(text))
    return message.when(status >= 400, F.concat(
        F.lit('Server returned status '), status.cast('string'), F.lit('. Analyzing returned content.')))


def fetch_error_message(url: Column, reason: Column) -> Column:
    """Message of a URL whose body is missing."""
    default = 'The file may be too large, inaccessible, or the server timed out.'
    note = " Note: 0.0.0.0 is not a valid address to connect to. Please use 'localhost' or '127.0.0.1' instead. "
    return F.concat(
        F.lit('Failed to fetch '), url, F.lit('. '), F.coalesce(F.nullif(reason, F.lit('')), F.lit(default)),
        F.when(F.contains(url, F.lit('0.0.0.0')), F.lit(note)).otherwise(F.lit('')))


def size_mb(chars: Column) -> Column:
    return F.format_string('%.2f', chars / (1024 * 1024))


def client_ip(forwarded: Column, remote: Column) -> Column:
    """First forwarded address, else the peer; unroutable ones become the loopback."""
    first = strip(F.substring_index(F.coalesce(forwarded, F.lit('')), ',', 1))
    ip = F.coalesce(F.nullif(first, F.lit('')), remote, F.lit(''))
    return F.when(ip.isin('', '0.0.0.0', '::', '::1'), F.lit('127.0.0.1')).otherwise(ip)


def escape_html(text: Column) -> Column:
    escaped = F.coalesce(text, F.lit(''))
    for raw, entity in [('&', '&amp;'), ('<', '&lt;'), ('>', '&gt;'), ('"', '&quot;'), ("'", '&#039;')]:
        escaped = F.replace(escaped, F.lit(raw), F.lit(entity))
    return escaped


def mask_secret(text: Column) -> Column:
    """Secrets are shown in full; only surrounding blanks go."""
    return strip(F.coalesce(text, F.lit('')))
