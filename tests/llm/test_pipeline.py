"""Stages of the pipeline, and all of it, against plain Python."""

import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline as P
from corpusward.llm.packing import tokenizer
from corpusward.llm.quality_classifier import score_quality
from corpusward.llm.toxicity import grade_toxicity

from ..conftest import SMALL
from .test_codecs import check_places
from .test_joins import SPACE, grouped, without_repeats


@pytest.fixture(scope='module')
def folder(spark, tmp_path_factory):
    """The smallest tables and some odd documents."""
    path = str(tmp_path_factory.mktemp('pipeline'))
    docs = spark.read.parquet(f'{SMALL}/documents.parquet')
    odd = [None, '', ' \n', 'one\ntwo', 'one\ntwo', 'one\nthree words here', 'a b c d e f g', 'a b c d e f g']
    more = spark.createDataFrame([(10 ** 6 + i, t, 'en', 'odd', len(t or '')) for i, t in enumerate(odd)], docs.schema)
    docs.unionByName(more).coalesce(2).write.parquet(f'{path}/documents.parquet')
    spark.read.parquet(f'{SMALL}/labels.parquet').write.parquet(f'{path}/labels.parquet')
    return path


def rows_of(frame):
    rows = [r.asDict() for r in frame.collect()]
    return sorted(rows, key=lambda r: r['doc_id'])


def without_lines(rows):
    removed, left = without_repeats([r['text'] for r in rows], least=1), []
    for d, r in enumerate(rows):
        if d in removed:
            text = '\n'.join(x for k, x in enumerate(r['text'].split('\n')) if k not in removed[d])
            r = r | {'text': text, 'n_chars': len(text)}
        if d not in removed or SPACE.sub('', r['text']):
            left.append(r)
    return left


def one_of_copies(rows):
    return [r for i, (r, g) in enumerate(zip(rows, grouped([r['text'] for r in rows], 5, 4, 5))) if g[2] == i]


def pieces_of(rows):
    encode = tokenizer(public_tokenizers.path('byte_bpe_50k.tiktoken'), public_tokenizers.PATTERN).encode_ordinary
    for r in rows:
        ids = [*encode(r['text'] or ''), 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            yield r['doc_id'], k, a, b - a, zlib.crc32(np.array(ids[a:b], '<u4').tobytes())


def test_stages_and_run(spark, folder):
    docs = P.documents(spark, folder)
    labels = spark.read.parquet(f'{folder}/labels.parquet')
    every = rows_of(docs)

    toxic = {r['doc_id'] for r in grade_toxicity(docs, labels).select('doc_id', 'toxic').collect() if r['toxic']}
    clean = [r for r in every if r['doc_id'] not in toxic]
    assert toxic and rows_of(P.drop_toxic(spark, docs, folder)) == clean

    clean_docs = spark.createDataFrame(clean, docs.schema)
    score = {r['doc_id']: r['score'] for r in score_quality(clean_docs, labels).select('doc_id', 'score').collect()}
    good = [r for r in clean if score[r['doc_id']] >= 0.3]
    assert len(good) < len(clean) and rows_of(P.drop_poor(spark, clean_docs, folder)) == good

    # the joins also see the odd documents, whatever the models think of them
    lines = without_lines(every)
    assert len(lines) < len(every) and rows_of(P.drop_repeated_lines(spark, docs, folder)) == lines
    single = one_of_copies(every)
    assert len(single) < len(every) and rows_of(P.keep_one_of_copies(spark, docs, folder)) == single

    def check(frame, rows):
        found = frame.collect()
        assert sorted((r['doc_id'], r['piece'], r['start'], r['length'], r['ids_crc32']) for r in found) == sorted(pieces_of(rows))
        check_places(found, [r['length'] for r in found], 2048)

    check(P.pack_sequences(spark, docs, folder), every)
    check(P.run(spark, folder), one_of_copies(without_lines(good)))
