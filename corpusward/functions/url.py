"""URL parts, resolution and host tests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip

_SCHEME = r'^([A-Za-z][A-Za-z0-9+.\-]*):'
_NETLOC = r'^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)'


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, _NETLOC, 1)


def url_path(url: Column) -> Column:
    """Path between the authority and the query, '' if there is none."""
    return F.regexp_extract(url, r'^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)


def url_directory(url: Column) -> Column:
    """Directory of the URL's path; '/' at the top; null without a path."""
    path = url_path(url)
    parent = F.regexp_extract(path, r'^(.*/)[^/]*$', 1)
    trimmed = F.rtrim(parent, F.lit('/'))
    directory = F.when(trimmed == '', parent).otherwise(trimmed)
    return F.when(path != '', F.when(directory == '', F.lit('/')).otherwise(directory))


def root_url(url: Column) -> Column:
    """scheme://authority/ , null unless both are present."""
    return F.when((scheme(url) != '') & (netloc(url) != ''), F.concat(scheme(url), F.lit('://'), netloc(url), F.lit('/')))


def is_valid_http_url(url: Column) -> Column:
    text = strip(url)
    return scheme(text).isin('http', 'https') & (netloc(text) != '') & ~F.startswith(netloc(text), F.lit('0.0.0.0'))


def normalize_local_url(url: Column) -> Column:
    """Host 0.0.0.0 becomes 127.0.0.1; port, user and the rest stay."""
    text = strip(url)
    local = scheme(text).isin('http', 'https') & F.startswith(netloc(text), F.lit('0.0.0.0'))
    parts = r'^([A-Za-z]+)(://)([^/?#]*)(.*)$'
    fixed = F.concat(scheme(text), F.lit('://'), F.replace(netloc(text), F.lit('0.0.0.0'), F.lit('127.0.0.1')),
                     F.regexp_extract(text, r'(?s)' + parts, 4))
    return F.when(local, fixed).otherwise(url)


def fetch_url(url: Column) -> Column:
    """The fetch path replaces 0.0.0.0 anywhere in the URL."""
    return F.replace(url, F.lit('0.0.0.0'), F.lit('localhost'))


def _bare_host(url: Column) -> Column:
    host = F.substring_index(F.lower(netloc(url)), ':', 1)
    return F.when(F.startswith(host, F.lit('www.')), F.substr(host, F.lit(5))).otherwise(host)


def is_subdomain(url: Column, base: Column) -> Column:
    """Whether an absolute URL's host lies strictly below the base's host."""
    absolute = F.startswith(url, F.lit('http:')) | F.startswith(url, F.lit('https:')) | F.startswith(url, F.lit('//'))
    named = (netloc(url) != '') & (netloc(base) != '')
    below = F.endswith(_bare_host(url), F.concat(F.lit('.'), _bare_host(base)))
    return F.coalesce(absolute & named & (_bare_host(url) != _bare_host(base)) & below, F.lit(False))


def _without_dots(path: Column, merged: Column) -> Column:
    """Path with '.' and '..' segments resolved.

    Inner empty segments are dropped where the path was merged with the base's,
    as URL joining does; a trailing dot segment leaves a trailing slash.
    """
    segments = F.split(path, '/')
    last = F.size(segments) - 1
    inner = F.filter(segments, lambda s, i: (i == 0) | (i == last) | (s != '') | ~merged)
    kept = F.aggregate(
        inner, F.array().cast('array<string>'),
        lambda acc, s: F.when(s == '..', F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == '.', acc).otherwise(F.concat(acc, F.array(s))))
    tail = F.element_at(segments, -1)
    closed = F.when(tail.isin('.', '..'), F.concat(kept, F.array(F.lit('')))).otherwise(kept)
    joined = F.array_join(closed, '/')
    return F.when(F.startswith(joined, F.lit('/')), joined).otherwise(F.concat(F.lit('/'), joined))


def resolve_url(base: Column, ref: Column) -> Column:
    """Reference resolved against a base URL.

    Only hierarchical schemes are joined; any other scheme returns the
    reference as it is.
    """
    base_scheme, ref_scheme = scheme(base), scheme(ref)
    ref_rest = F.when(ref_scheme == base_scheme, F.regexp_replace(ref, _SCHEME, '')).otherwise(ref)
    absolute = (ref_scheme != '') & ((ref_scheme != base_scheme) | ~base_scheme.isin('http', 'https', 'ftp', 'file', ''))
    other = ~base_scheme.isin('', 'http', 'https', 'ftp', 'file')
    origin = F.concat(F.when(base_scheme != '', F.concat(base_scheme, F.lit(':'))).otherwise(F.lit('')),
                      F.when(F.startswith(F.regexp_replace(base, _SCHEME, ''), F.lit('//')),
                             F.concat(F.lit('//'), netloc(base))).otherwise(F.lit('')))
    path = F.regexp_extract(ref_rest, r'^([^?#]*)', 1)
    query = F.regexp_extract(ref_rest, r'^[^?#]*(\?[^#]+)', 1)
    fragment = F.regexp_extract(ref_rest, r'(#.+)$', 1)
    base_path = url_path(base)
    base_query = F.regexp_extract(base, r'^[^?#]*(\?[^#]+)', 1)
    directory = F.regexp_extract(base_path, r'^(.*/)[^/]*$', 1)
    merged = F.when(F.startswith(path, F.lit('/')), path).otherwise(
        F.concat(F.when(directory == '', F.lit('/')).otherwise(directory), path))
    relative = F.when(path == '', F.concat(origin, base_path, F.when(query != '', query).otherwise(base_query), fragment)) \
        .otherwise(F.concat(origin, _without_dots(merged, ~F.startswith(path, F.lit('/'))), query, fragment))
    authority = F.concat(F.when(base_scheme != '', F.concat(base_scheme, F.lit(':'))).otherwise(F.lit('')), ref_rest)
    return (F.when((base == '') | base.isNull(), ref)
            .when(ref == '', base)
            .when(absolute | other, ref)
            .when(F.startswith(ref_rest, F.lit('//')), authority)
            .otherwise(relative))
