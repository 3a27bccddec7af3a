import math
from urllib.parse import urljoin, urlparse
import os.path

from pyspark.sql import functions as F

from corpusward.functions import headers as H, url as U
from corpusward.functions.labels import refine_technique
from corpusward.functions.text import shannon_entropy, strip

from . import model


def column(spark, values, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], 'i int, v string')
    return [r[0] for r in frame.select('i', expression(F.col('v')).alias('x')).orderBy('i').select('x').collect()]


def test_entropy(spark):
    values = ['a', 'ab', 'aaaaéé', 'häß€漢', 'abcdefghijklmnopqrstuvwxyz012345']
    for got, text in zip(column(spark, values, shannon_entropy), values):
        assert math.isclose(got, model.entropy(text), abs_tol=1e-12)
    assert column(spark, [''], shannon_entropy) == [0.0]


def test_strip_is_unicode_aware(spark):
    values = ['　 a \x1f', ' b c\x85', '\n\t', 'x​']
    assert column(spark, values, strip) == [v.strip() for v in values]


URLS = ['https://h.io/a/b/c.js?x=1#f', 'http://h.io', 'https://h.io/', 'https://h.io//x//y', 'a/b.js', 'http://h.io/a/', 'http://u:p@h.io:8/a']
REFS = ['x.js', '/x.js', '//c.io/x.js', 'https://c.io/x', './x', '../x', '../../../x', '?q=1', '#top', '', 'a/./b/../c', 'g/', '..', '.',
        'mailto:a@b.c', 'x?y=../z', '/../x', 'https:y.js', '/a//b']


def test_resolve_like_the_standard(spark):
    pairs = [(b, r) for b in URLS if b.startswith('http') for r in REFS]
    frame = spark.createDataFrame([(i, b, r) for i, (b, r) in enumerate(pairs)], 'i int, b string, r string')
    got = [r.u for r in frame.select('i', U.resolve_url(F.col('b'), F.col('r')).alias('u')).orderBy('i').collect()]
    wrong = [(b, r, g, urljoin(b, r)) for (b, r), g in zip(pairs, got) if g != urljoin(b, r)]
    assert not wrong


def test_directory(spark):
    expected = [(os.path.dirname(urlparse(u).path) or '/') if urlparse(u).path else None for u in URLS]
    assert column(spark, URLS, U.url_directory) == expected


def test_valid_and_local(spark):
    values = ['http://a', 'https://0.0.0.0/x', 'ftp://a', 'http:///x', ' https://a.io ', 'nothing', 'HTTP://A']
    assert column(spark, values, U.is_valid_http_url) == [True, False, False, False, True, False, True]
    assert column(spark, ['http://0.0.0.0:80/0.0.0.0?q', 'x'], U.normalize_local_url) == ['http://127.0.0.1:80/0.0.0.0?q', 'x']


def headers_of(spark, headers, expression):
    frame = spark.createDataFrame([(headers,)], 'h map<string,string>')
    return frame.select(expression(F.col('h')).alias('x')).first().x


def test_csp(spark):
    csp = headers_of(spark, {'content-security-policy': "script-src a;  SCRIPT-SRC  'self' * ; img-src"}, H.analyze_csp)
    assert csp.directives == {'script-src': "'self' *", 'img-src': ''} and csp.weaknesses == []
    wide = headers_of(spark, {'Content-Security-Policy': "script-src 'self' * b; default-src *"}, H.analyze_csp)
    assert len(wide.weaknesses) == 2
    missing = headers_of(spark, {'X': 'y'}, H.analyze_csp)
    assert not missing.is_present and missing.weaknesses == ['CSP Header is missing']
    assert headers_of(spark, {}, H.analyze_csp) is None


def test_server_cdn_and_rates(spark):
    assert headers_of(spark, {'SERVER': 'nginx'}, H.analyze_server).server_header is None
    assert headers_of(spark, {'server': 'Caddy', 'x-powered-by': 'PHP'}, H.analyze_server)[1:3] == ('Unknown', 'PHP')
    cdn = headers_of(spark, {'cf-ray': '1', 'CF-Cache-Status': 'HIT'}, H.analyze_cdn)
    assert cdn.details == ['Cloudflare headers detected', 'Cache Status: HIT']
    names = ['X-RateLimit-Limit', 'X-RateLimit-Remaining', 'X-RateLimit-Reset', 'RateLimit-Limit', 'RateLimit-Remaining',
             'RateLimit-Reset', 'Retry-After']
    every = headers_of(spark, {**{n.lower(): '1' for n in names}, 'CF-RAY': 'r'}, H.analyze_rate_headers)
    assert every.details == [f'{n}: 1' for n in names] and every.provider == 'Cloudflare'
    only = headers_of(spark, {'X-Akamai-Trans-Id': 'a'}, H.analyze_rate_headers)
    assert (only.provider, only.details) == ('Akamai', [])
    assert headers_of(spark, {'x-amzn-RequestId': 'a', 'Retry-After': ''}, H.analyze_rate_headers) is None


def test_refinement(spark):
    label = ['Email Address', 'Stripe Live Secret Key', 'Google API Key', 'Suspicious Comment', 'Source Map (v3)', 'postMessage Listener']
    got = column(spark, label, lambda v: refine_technique(F.lit('Pattern / signature matching'), v))
    assert got == ['Email Extraction', 'IP Address Discovery', 'API Key & Credential Detection', 'Comment Analysis'] + ['Pattern / signature matching'] * 2
