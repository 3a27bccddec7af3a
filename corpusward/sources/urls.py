"""URL lists and request payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..catalog import words as W
from ..functions.text import strip
from ..functions.url import normalize_local_url

# Line breaks of a text, as line splitting knows them.
_LINE_BREAK = r'\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]'


def urls_of_text(text: Column, keep_comments: bool = False, commas: bool = False) -> Column:
    """URLs of a text: one per line, trimmed, without blanks and ``#`` lines.

    The older reader keeps ``#`` lines; the form field also splits at commas.
    """
    lines = F.split(text, r'[\r\n,]+' if commas else _LINE_BREAK, -1)
    kept = F.filter(F.transform(lines, strip), lambda u: u != '')
    return kept if keep_comments or commas else F.filter(kept, lambda u: ~F.startswith(u, F.lit('#')))


def scan_url_list(lists: DataFrame, **options) -> DataFrame:
    """lists(list_id, content) -> rows(list_id, pos, url)."""
    return lists.select('list_id', F.posexplode(urls_of_text(F.col('content'), **options)).alias('pos', 'url'))


def read_url_list(spark: SparkSession, path: str, **options) -> DataFrame:
    lists = spark.read.text(path, wholetext=True).select(F.lit(0).alias('list_id'), F.col('value').alias('content'))
    return scan_url_list(lists, **options)


def scan_request_payloads(payloads: DataFrame) -> DataFrame:
    """payloads(payload_id, payload JSON) -> rows(payload_id, pos, url).

    ``urls`` (list or text) wins over ``url`` unless it is absent or empty; only
    texts count; 0.0.0.0 becomes the loopback.
    """
    document = F.try_parse_json('payload')
    urls = F.try_variant_get(document, '$.urls', 'variant')
    kind = F.schema_of_variant(urls)
    listed = F.when(F.startswith(kind, F.lit('ARRAY')), F.try_variant_get(document, '$.urls', 'array<variant>'))
    texts = F.transform(F.filter(listed, lambda v: F.schema_of_variant(v) == 'STRING'),
                        lambda v: F.try_variant_get(v, '$', 'string'))
    single = F.when(F.schema_of_variant(F.try_variant_get(document, '$.url', 'variant')) == 'STRING',
                    strip(F.try_variant_get(document, '$.url', 'string')))
    fallback = F.when(F.coalesce(single, F.lit('')) != '', F.array(single)).otherwise(F.array().cast('array<string>'))
    chosen = (F.when(kind == 'STRING', F.array(F.try_variant_get(document, '$.urls', 'string')))
              .when(F.size(listed) > 0, texts)
              .when(kind.isNull() | (kind == 'VOID') | (F.size(listed) == 0), fallback))
    cleaned = F.filter(F.transform(chosen, strip), lambda u: u != '')
    return payloads.select('payload_id', F.posexplode(F.transform(cleaned, normalize_local_url)).alias('pos', 'url'))


def route_inputs(inputs: DataFrame) -> DataFrame:
    """inputs(name, content) -> route 'content' or 'urls'.

    Source files, and texts without any URL line, are analysed as they are.
    """
    name = F.lower('name')
    is_code = F.lit(False)
    for extension in W.CODE_EXTENSIONS:
        is_code = is_code | F.endswith(name, F.lit(extension))
    no_urls = F.size(urls_of_text(F.col('content'))) == 0
    return inputs.withColumn('route', F.when(is_code | no_urls, F.lit('content')).otherwise(F.lit('urls')))


def order_by_file_id(urls: DataFrame, order: str = 'pos') -> DataFrame:
    """file_id = place in the list + 1, in that order."""
    return urls.withColumn('file_id', F.col(order) + 1).orderBy('file_id')
