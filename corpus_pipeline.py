"""From raw documents to packed training sequences.

Each stage takes the documents that the one before kept; all but the last return
the columns of documents.  ``run`` writes and rereads what is between two stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusward.llm.common import documents, ship, written
from corpusward.llm.line_dedup import dedup_lines
from corpusward.llm.ngram_join import link_documents
from corpusward.llm.packing import cut, pack, token_ids
from corpusward.llm.quality_classifier import score_quality
from corpusward.llm.toxicity import grade_toxicity


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f'{sf_dir}/labels.parquet')


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose severity model finds no toxic grade likely; null and empty texts stay."""
    ship(spark)
    return grade_toxicity(docs, _labels(spark, sf_dir)).where('not toxic').select(*docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least 0.3."""
    ship(spark)
    return score_quality(docs, _labels(spark, sf_dir)).where('predicted = 1').select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines, however short, that an earlier line is similar to; those that lose all their words go."""
    done = dedup_lines(docs, min_words=1)
    done = done.where((F.col('n_removed') == 0) | F.col('text').rlike(r'[^\x20\x09-\x0D]'))
    if 'n_chars' in docs.columns:
        done = done.withColumn('n_chars', F.when(F.col('n_removed') > 0, F.length('text').cast('long')).otherwise(F.col('n_chars')))
    return done.select(*docs.columns)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by five-word shingles at Jaccard 0.8.

    Repeated rows are one document; rows with a null id are in no group and stay.
    """
    ship(spark)
    dropped = link_documents(docs).where('component_id <> doc_id').select('doc_id').distinct()
    return docs.join(dropped, 'doc_id', 'left_anti').dropDuplicates(['doc_id', 'text']).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 tokens."""
    ship(spark)
    ids = token_ids(F.col('text'), public_tokenizers.path('byte_bpe_50k.tiktoken'), public_tokenizers.PATTERN)
    pieces = cut(docs.select('doc_id', ids.alias('ids')))
    return pack(pieces.select('doc_id', 'piece', 'start', 'length', F.crc32('ids').alias('ids_crc32')), 2048)


STAGES = [
    ('toxicity', drop_toxic),
    ('quality classifier', drop_poor),
    ('line dedup', drop_repeated_lines),
    ('n-gram Jaccard join', keep_one_of_copies),
    ('best-fit packing', pack_sequences),
]

#: Trained models and tokenizers are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(' ', '-'))
    return STAGES[-1][1](spark, docs, sf_dir)
