"""One query per operator over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import documents, ship
from .decontamination import build_index, n_hit, search
from .filter_audit import audit
from .hmm import score_texts
from .langid import identify
from .line_dedup import dedup_lines
from .neighbours import nearest
from .ngram_join import link_documents
from .packing import cut, pack, token_ids
from .piece_codec import decode_ids, encode_texts
from .quality_classifier import score_quality
from .quality_rules import judge
from .toxicity import grade_toxicity
from .vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, compress, digest, with_label_error

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(run)
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return run(spark, sf_dir)
    QUERIES[run.__name__] = shipped
    return shipped


@query
def op1_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    model = public_tokenizers.path('piece_bpe_32k.model')
    coded = decode_ids(encode_texts(documents(spark, sf_dir).select('doc_id', 'text'), model), model)
    return coded.select('doc_id', F.size('ids').cast('long').alias('n_tokens'),
                        F.sha2(F.array_join(F.col('ids').cast('array<string>'), ','), 256).alias('ids_sha256'),
                        F.sha2('decoded', 256).alias('decoded_sha256'))


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 2048 tokens."""
    docs = documents(spark, sf_dir).select('doc_id', 'text')
    ids = token_ids(F.col('text'), public_tokenizers.path('byte_bpe_50k.tiktoken'), public_tokenizers.PATTERN)
    pieces = cut(docs.select('doc_id', ids.alias('ids')))
    return pack(pieces.select('doc_id', 'piece', 'start', 'length', F.crc32('ids').alias('ids_crc32')), 2048)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f'{sf_dir}/labels.parquet')


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; cut-offs certified per language."""
    judged = judge(documents(spark, sf_dir).select('doc_id', 'text', 'lang'), labels(spark, sf_dir))
    return judged.select('doc_id', 'n_words', 'word_chars', 'n_symbols', 'n_dup_lines', 'n_repeat_words', 'base_failed',
                         'kept', F.array_join('reasons', ',').alias('reasons'))


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    scored = score_quality(documents(spark, sf_dir).select('doc_id', 'text'), labels(spark, sf_dir), keep_text=False)
    return scored.select('doc_id', 'held_out', 'score', 'predicted')


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document."""
    graded = grade_toxicity(documents(spark, sf_dir).select('doc_id', 'text'), labels(spark, sf_dir))
    return graded.select('doc_id', 'toxic', 'severity', 'grade', 'toxic_chance')


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    found = identify(documents(spark, sf_dir).select('doc_id', 'text', 'lang'))
    return found.select('doc_id', 'held_out', 'lang_pred', 'score', 'rejected')


@query
def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row whose id is divisible by 20."""
    return nearest(spark.read.parquet(f'{sf_dir}/embeddings.parquet'), 'vec_id', 'embedding')


@query
def op10_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document."""
    return score_texts(documents(spark, sf_dir).select('doc_id', 'text'))


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines, however short, as digest and line numbers."""
    done = dedup_lines(documents(spark, sf_dir).select('doc_id', 'text'), min_words=1)
    return done.select('doc_id', 'n_lines', 'n_removed', F.array_join(F.col('removed').cast('array<string>'), ',').alias('removed'),
                       F.sha2(F.coalesce('text', F.lit('')), 256).alias('text_sha256'))


@query
def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the documents by three-word shingles at Jaccard 0.9."""
    return link_documents(documents(spark, sf_dir).select('doc_id', 'text'), k=3, num=9, den=10)


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes, hides and costs, in every order."""
    return audit(documents(spark, sf_dir).select('doc_id', 'text', 'lang'), labels(spark, sf_dir))


ORACLE['op11_filter_audit'] = r"""WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
        [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS ws,
        min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
    l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    cells AS (SELECT part, concat(CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END,
            CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END,
            CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN doc_id > first THEN 'E' ELSE '' END) AS failed,
        count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM w LEFT JOIN l USING (doc_id) GROUP BY ALL),
    f AS (SELECT unnest(string_split('A,B,C,D,E', ',')) AS x),
    orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
        WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
    steps AS (SELECT *, unnest(range(1, 6)) AS step FROM orders),
    gone AS (SELECT *, CASE WHEN failed <> '' THEN list_min([strpos(filter_order, x) FOR x IN string_split(failed, '')]) ELSE 6 END AS gone_at FROM cells, orders),
    r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS letter,
        CAST(sum(n) FILTER (gone_at > step) AS BIGINT) AS kept, CAST(sum(n) FILTER (gone_at = step) AS BIGINT) AS removed,
        CAST(sum(n) FILTER (gone_at < step AND contains(failed, filter_order[step])) AS BIGINT) AS redundant,
        CAST(sum(n) FILTER (failed = filter_order[step]) AS BIGINT) AS unique_fails,
        CAST(sum(good) FILTER (gone_at = step) AS BIGINT) AS good_lost, CAST(sum(toxic) FILTER (gone_at = step) AS BIGINT) AS toxic_lost
        FROM gone JOIN steps USING (filter_order) GROUP BY ALL)
    SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant,
        coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
        CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r"""


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product code and error of every vector."""
    coded, books = compress(spark.read.parquet(f'{sf_dir}/embeddings.parquet'))
    return with_label_error(coded).select('vec_id', 'code', 'error', 'label_error', F.lit(digest(books)).alias('codebooks_sha256'))


def _codes_sql() -> str:
    """The rounds one after another; every assignment compares each part with each entry."""
    def nearest_entry(n: int) -> str:
        return f"""a{n} AS MATERIALIZED (SELECT vec_id, label, p, v, e, d FROM (SELECT x.vec_id, x.label, x.p, x.v, b.e,
            list_sum([(y[1] - y[2]) * (y[1] - y[2]) FOR y IN list_zip(x.v, b.v)]) AS d FROM x JOIN b{n} b USING (p))
            QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1)"""

    def next_books(n: int) -> str:
        return f"""b{n + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{n} b LEFT JOIN (SELECT p, e, list(q ORDER BY i) AS v FROM (
            SELECT p, e, i, CAST((s - ((s % c) + c) % c) // c AS BIGINT) AS q FROM (SELECT p, e, i, sum(y) AS s, count(*) AS c
                FROM (SELECT p, e, unnest(v) AS y, generate_subscripts(v, 1) AS i FROM a{n}) GROUP BY ALL)) GROUP BY p, e) m USING (p, e))"""

    rounds = ', '.join(f'{nearest_entry(n)}, {next_books(n)}' for n in range(ROUNDS))
    return f"""WITH q AS (SELECT vec_id, label, [CAST(floor({SCALE} * CAST(y AS DOUBLE)) AS BIGINT) FOR y IN embedding] AS ints FROM embeddings
            WHERE embedding IS NOT NULL AND len([y FOR y IN embedding IF y IS NULL OR NOT isfinite(y)]) = 0),
        x AS MATERIALIZED (SELECT vec_id, label, p, ints[p * len(ints) // {PARTS} + 1:(p + 1) * len(ints) // {PARTS}] AS v FROM q, range({PARTS}) r(p)),
        b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM x QUALIFY e < {ENTRIES}),
        {rounds}, {nearest_entry(ROUNDS)},
        r AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id, label)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b{ROUNDS}) AS codebooks_sha256 FROM r"""


ORACLE['op12_vector_codes'] = _codes_sql()


@query
def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages of ten words in every document."""
    index = build_index(documents(spark, sf_dir).select('doc_id', 'text'))
    found = search(index, spark.read.parquet(f'{sf_dir}/benchmark.parquet').select('item_id', 'text'))
    items = F.array_distinct(F.transform('spans', lambda s: s['item_id'].cast('string')))
    return found.select('doc_id', 'n_words', n_hit(F.col('spans')).alias('n_hit'), items.alias('items')).select(
        'doc_id', 'n_words', 'n_hit', F.size('items').cast('long').alias('n_items'),
        F.sha2(F.array_join(F.sort_array('items'), ','), 256).alias('items_sha256'), (F.col('n_hit') > 0).alias('contaminated'))


ORACLE['op13_decontamination'] = r"""WITH d AS (SELECT doc_id, {words} AS ws FROM documents), i AS (SELECT item_id, {words} AS ws FROM benchmark),
    windows AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[s:s + 9], ' ') AS w
        FROM (SELECT item_id, ws, unnest(range(1, greatest(2, len(ws) - 8))) AS s FROM i WHERE len(ws) > 0)),
    grams AS (SELECT doc_id, s, n, array_to_string(ws[s:s + n - 1], ' ') AS w
        FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM windows))),
    found AS (SELECT doc_id, s, n, item_id FROM grams JOIN windows USING (n, w)),
    hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM found) GROUP BY doc_id),
    named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""".replace(
    '{words}', r"[x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
               r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> '']")
