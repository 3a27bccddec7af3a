"""Tokens: the sentencepiece codec and packing against the libraries and plain models."""

import bisect
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusward.llm.packing import cut, pack, plan, token_ids
from corpusward.llm.piece_codec import codec, decode_ids, encode_texts

from ..conftest import SMALL

MODEL = public_tokenizers.path('piece_bpe_32k.model')
ODD = [None, '', ' ', '  a  b ', '\xa0x', 'ﬁ Ａ́', 'a\x00b', '▁x', '\ttab\n\n new', '😀🏽', '<s> </s> <0x41> <unk>', ' ' * 37 + 'x', 'x' + ' ' * 100,
       'word ' * 20000, 'x' * 3000, 'same', 'same']


@pytest.fixture(scope='module')
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_codec_is_the_librarys(library):
    own, rng = codec(MODEL), random.Random(4)
    texts = [t for t in ODD if t] + [''.join(rng.choice('ab ▁\n\té€😀thein,.') for _ in range(rng.randint(1, 200))) for _ in range(800)]
    for text in texts:
        ids = own.encode(text).tolist()
        assert ids == library.encode(text)
        assert own.decode(ids) == library.decode(ids)
    for _ in range(800):
        ids = [rng.choice([rng.randint(0, 300), rng.randint(3, 31999)]) for _ in range(rng.randint(0, 12))]
        assert own.decode(ids) == library.decode(ids)


def test_encode_frames(documents, spark, library):
    docs = documents(*ODD, ids=['mine'] * len(ODD), DECODED=['other'] * len(ODD))
    rows = decode_ids(encode_texts(docs, MODEL), MODEL).collect()
    assert len(rows) == len(ODD)
    for row in rows:
        assert row['ids'] == library.encode(row['text'] or '')
        assert row['decoded'] == library.decode(row['ids'])
    assert encode_texts(docs.limit(0), MODEL).count() == 0


def test_tokens_are_the_tokenizers(spark):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path('byte_bpe_50k.json'))
    tokenizer.encode_special_tokens = True
    docs = spark.read.parquet(f'{SMALL}/documents.parquet').select('text').limit(60).unionByName(
        spark.createDataFrame([(t,) for t in [*ODD, '<|endoftext|> x', "don't  stop \n now "]], 'text string'))
    ids = token_ids(F.col('text'), public_tokenizers.path('byte_bpe_50k.tiktoken'), public_tokenizers.PATTERN)
    for row in docs.select('text', ids.alias('ids')).collect():
        assert np.frombuffer(row['ids'], '<u4').tolist() == [*tokenizer.encode(row['text'] or '', add_special_tokens=False).ids, 0]


def test_cut(spark):
    raw = {i: np.arange(n, dtype='<u4').tobytes() for i, n in enumerate([0, 1, 7, 8, 9, 16, 30])}
    docs = spark.createDataFrame([(i, bytearray(b), 'x') for i, b in raw.items()], 'doc_id long, ids binary, piece string')
    rows = cut(docs, size=8).orderBy('doc_id', 'piece').collect()
    by_doc = {}
    for r in rows:
        assert r['length'] * 4 == len(r['ids']) and 0 < r['length'] <= 8
        assert r['start'] * 4 == len(by_doc.get(r['doc_id'], b''))
        by_doc[r['doc_id']] = by_doc.get(r['doc_id'], b'') + bytes(r['ids'])
    assert by_doc == {i: b for i, b in raw.items() if b}
    assert [r['length'] for r in rows if r['doc_id'] == 6] == [6, 8, 8, 8]


def check_places(rows, lengths, capacity):
    assert Counter(r['length'] for r in rows) == Counter(lengths)
    sequences = {}
    for r in rows:
        sequences.setdefault(r['sequence_id'], []).append((r['offset'], r['length']))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def best_fit(lengths, capacity):
    room, bins = [], 0
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(room, n)
        if i < len(room):
            bisect.insort(room, room.pop(i) - n)
        else:
            bins += 1
            bisect.insort(room, capacity - n)
    return bins


@pytest.mark.parametrize('ranges', [10, 1000000])
def test_pack(spark, ranges):
    rng = random.Random(2)
    lengths = [rng.randint(1, 64) for _ in range(1500)] + [17] * 800
    frame = spark.createDataFrame([(i, n, 'x') for i, n in enumerate(lengths)], 'doc_id long, length int, offset string')
    done = pack(frame, 64, rows_per_range=ranges)
    assert Counter(done.columns) == Counter(['doc_id', 'length', 'sequence_id', 'offset'])
    used = check_places(done.collect(), lengths, 64)
    assert used <= best_fit(lengths, 64)
    assert pack(frame.limit(0), 64).count() == 0
    for wrong in (0, 65, None):
        with pytest.raises(ValueError):
            pack(spark.createDataFrame([(1, wrong)], 'doc_id long, length int'), 64)


def test_pack_gives_equal_places_again(spark, tmp_path):
    """Many pieces of one length in several files: every reading numbers them alike."""
    rows = [(i, 7 if i % 3 else 20, f'{i}') for i in range(3000)]
    spark.createDataFrame(rows, 'doc_id long, length int, name string').repartition(6).write.parquet(str(tmp_path / 'pieces'))
    runs = [sorted(map(tuple, pack(spark.read.parquet(str(tmp_path / 'pieces')), 64, rows_per_range=500).collect())) for _ in range(2)]
    assert runs[0] == runs[1]


def test_plan_finds_the_best_on_small_cases():
    def fewest(sizes, capacity):
        best = len(sizes)

        def put(k, room):
            nonlocal best
            if len(room) >= best:
                return
            if k == len(sizes):
                best = len(room)
                return
            for i in range(len(room)):
                if room[i] >= sizes[k]:
                    room[i] -= sizes[k]
                    put(k + 1, room)
                    room[i] += sizes[k]
            put(k + 1, [*room, capacity - sizes[k]])
        put(0, [])
        return best

    rng = random.Random(7)
    extra = 0
    for _ in range(60):
        sizes = sorted((rng.randint(1, 20) for _ in range(9)), reverse=True)
        rows = plan(dict(Counter(sizes)), 20)
        extra += max(r[4] + r[3] for r in rows) - fewest(sizes, 20)
    assert extra <= 1


def test_plan_with_a_hot_length():
    rng = random.Random(2)
    sizes = [max(1, int(min(2048, rng.lognormvariate(6, 1)))) for _ in range(3000)] + [700] * 2000
    assert max(r[4] + r[3] for r in plan(dict(Counter(sizes)), 2048)) <= 1.01 * best_fit(sizes, 2048)


def test_queries(spark, library):
    from corpusward.llm.queries import QUERIES
    texts = {r['doc_id']: r['text'] for r in spark.read.parquet(f'{SMALL}/documents.parquet').collect()}
    rows = QUERIES['op5_best_fit_packing'](spark, SMALL).collect()
    check_places(rows, [r['length'] for r in rows], 2048)
    import hashlib

    import tiktoken  # noqa: F401
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path('byte_bpe_50k.json'))
    tokenizer.encode_special_tokens = True
    for r in rows[:80]:
        ids = [*tokenizer.encode(texts[r['doc_id']] or '', add_special_tokens=False).ids, 0][r['start']:r['start'] + r['length']]
        assert zlib.crc32(np.array(ids, '<u4').tobytes()) == r['ids_crc32']
    for r in QUERIES['op1_piece_codec'](spark, SMALL).collect():
        ids = library.encode(texts[r['doc_id']] or '')
        assert r['n_tokens'] == len(ids)
        assert r['ids_sha256'] == hashlib.sha256(','.join(map(str, ids)).encode()).hexdigest()
        assert r['decoded_sha256'] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
