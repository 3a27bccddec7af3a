"""Joins and searches against all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusward.llm import ngram_join
from corpusward.llm.common import components
from corpusward.llm.line_dedup import _could_match, dedup_lines
from corpusward.llm.neighbours import build, nearest, nearest_rows, search
from corpusward.llm.ngram_join import link_documents

from ..conftest import SMALL

SPACE = re.compile(r'[\x20\x09-\x0D]+')


def variants(rng, words, n, edits):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f'e{rng.randint(0, 10 ** 6)}'
        out.append(w)
    return out


def fixture_texts(seed):
    """Near copies around the threshold, a hot group, shared passages, short texts, repeats, nulls."""
    rng = random.Random(seed)
    vocabulary = [f'w{i}' for i in range(60)]
    base = [rng.choice(vocabulary) for _ in range(40)]
    passage = ' '.join(rng.choice(vocabulary) for _ in range(25))
    texts = [' '.join(w) for w in variants(rng, base, 60, 3)]
    for _ in range(25):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        texts += [' '.join(w) for w in variants(rng, own, rng.randint(1, 4), 4)]
        texts.append(' '.join(own) + '\n' + passage)
    texts += ['a b', 'A\tB', 'a  b ', 'a', '', None, ' \n\t', 'x y z', 'x y z', 'x y z q', *[passage] * 5]
    rng.shuffle(texts)
    return texts


def grouped(texts, k, num, den):
    sets = []
    for t in texts:
        w = [x for x in SPACE.split((t or '')) if x]
        w = [''.join(c.lower() if 'A' <= c <= 'Z' else c for c in x) for x in w]
        sets.append({tuple(w)} if 0 < len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)})
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and den * o >= num * len(sets[i] | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return [(i, len(s), g) for i, (s, g) in enumerate(zip(sets, group))]


@pytest.mark.parametrize('k, num, den, seed', [(3, 9, 10, 1), (5, 4, 5, 2), (1, 1, 2, 3), (2, 7, 10, 4)])
def test_ngram_join(documents, k, num, den, seed):
    texts = fixture_texts(seed)
    docs = documents(*texts, low=['x'] * len(texts), component_id=['y'] * len(texts))
    found = link_documents(docs, k=k, num=num, den=den)
    assert sorted(map(tuple, found.collect())) == grouped(texts, k, num, den)


def test_ngram_join_edges(spark, documents):
    assert link_documents(documents('a b c').limit(0)).count() == 0
    rows = [(None, 'a b c d e f g'), (5, 'a b c d e f g'), (5, 'k l m n o p q'), (9, 'k l m n o p q'), (2, 'a b c d e f g')]
    found = link_documents(spark.createDataFrame(rows, 'doc_id long, text string')).collect()
    assert sorted((str(r['doc_id']), r['component_id']) for r in found) == [('2', 2), ('5', 2), ('5', 2), ('9', 2), ('None', None)]


def test_the_second_meeting_reads_tables(documents, monkeypatch):
    """Its plan has only the joins of its own; all before it, once for each reading, was a burden of the driver's memory."""
    plans, links = [], ngram_join._links

    def spied(pairs, *rest):
        plans.append(pairs._jdf.queryExecution().optimizedPlan().toString())
        return links(pairs, *rest)
    monkeypatch.setattr(ngram_join, '_links', spied)
    texts = fixture_texts(3)
    assert sorted(map(tuple, link_documents(documents(*texts)).collect())) == grouped(texts, 5, 4, 5)
    assert len(plans) == 2 and plans[1].count('Join ') <= 4


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(45)] + [(7, 7)]
    group = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                group[a] = group[b] = min(group[a], group[b])
    assert dict(map(tuple, components(spark.createDataFrame(edges, 'a long, b long')).collect())) == group
    assert components(spark.createDataFrame([], 'a long, b long')).count() == 0


def without_repeats(texts, least=5):
    lines, removed = [], {}
    for d, t in enumerate(texts):
        for k, line in enumerate((t or '').split('\n')):
            w = {x for x in SPACE.split(line) if x}
            if len(w) >= least:
                if any(5 * len(w & v) >= 4 * len(w | v) for v in lines):
                    removed.setdefault(d, []).append(k)
                lines.append(w)
    return removed


@pytest.mark.parametrize('seed', [1, 2])
def test_line_dedup(documents, seed):
    rng = random.Random(seed)
    pool = [t.replace('\n', ' ') for t in fixture_texts(seed) if t]
    texts = ['\n'.join(rng.choice(pool) for _ in range(rng.randint(1, 6))) for _ in range(80)] + [None, '', '\n\n', 'one two', 'one two', ' a b c d e ', 'e d c b a']
    docs = documents(*texts, line=['x'] * len(texts), N_LINES=['y'] * len(texts))
    found = dedup_lines(docs, min_words=5)
    removed = without_repeats(texts)
    for r in found.collect():
        gone = removed.get(r['doc_id'], [])
        assert r['removed'] == gone and r['n_removed'] == len(gone)
        text = texts[r['doc_id']]
        if gone:
            text = '\n'.join(x for k, x in enumerate(text.split('\n')) if k not in gone)
        assert r['text'] == text
    assert found.count() == len(texts) and dedup_lines(docs.limit(0)).count() == 0


def test_lines_meet_at_their_first_common_word(spark):
    """Ten words each with equal bitmaps: similar lines share nine, so their first common word has eight behind it in both."""
    rows = spark.createDataFrame([(i, j) for i in range(3) for j in range(3)], 'i int, j int')
    n, bits = F.lit(10), F.lit(0).cast('long')
    met = {(r['i'], r['j']) for r in rows.where(_could_match(n, F.col('i'), bits, n, F.col('j'), bits, 4, 5)).collect()}
    assert met == {(0, 0), (0, 1), (1, 0), (1, 1)}


@pytest.mark.parametrize('seed', [1, 2])
def test_line_dedup_of_short_lines(spark, documents, tmp_path, seed):
    from corpus_pipeline import drop_repeated_lines
    from corpusward.llm.queries import QUERIES
    rng = random.Random(seed)
    pool = [' '.join(rng.choice('abcdefgh') for _ in range(rng.randint(1, 6))) for _ in range(120)]
    pool += ['Les.', 'All rights reserved.', ' Les. ', 'Les.\tLes.', 'reserved. All  rights', 'p q r s', 's q p r t', '', ' \t', *['hot ' + w for w in 'ijklmnopqrstu']]
    texts = ['\n'.join(rng.choice(pool) for _ in range(rng.randint(1, 8))) for _ in range(60)] + [None, '', 'Les.', 'Les.\nown words']
    removed = without_repeats(texts, least=1)
    left = ['\n'.join(x for k, x in enumerate(t.split('\n')) if k not in removed[d]) if d in removed else t for d, t in enumerate(texts)]
    docs = documents(*texts)
    docs.write.parquet(f'{tmp_path}/documents.parquet')
    found = {r['doc_id']: r['removed'] for r in QUERIES['op8_line_dedup'](spark, str(tmp_path)).collect()}
    assert found == {d: ','.join(map(str, removed.get(d, []))) for d in range(len(texts))}
    kept = {(r['doc_id'], r['text']) for r in drop_repeated_lines(spark, docs, str(tmp_path)).collect()}
    assert kept == {(d, t) for d, t in enumerate(left) if d not in removed or SPACE.sub('', t)}


def test_line_dedup_of_long_lines(documents):
    """Lines of 100 words that share a rare one, some just at the threshold; a second bitmap tells the others apart."""
    from corpusward.llm.line_dedup import distinct_lines, line_rows, postings
    rng = random.Random(3)
    base = [f'w{k}' for k in range(100)]
    lines = [' '.join(base)]
    for number in range(40):
        gone = rng.sample(range(1, 100), 8 + number % 7)
        lines.append(' '.join(f'own{number}x{k}' if k in gone else w for k, w in enumerate(base)))
    lines += [' '.join(['w0', *(f'far{number}x{k}' for k in range(99))]) for number in range(20)] + ['w0 w1 few words', 'few w0 w1 words']
    rng.shuffle(lines)
    docs = documents(*lines)
    removed = without_repeats(lines, least=1)
    assert 0 < len(removed) < 41
    assert {r['doc_id']: r['removed'] for r in dedup_lines(docs).collect() if r['removed']} == removed
    rows = postings(distinct_lines(line_rows(docs, 'text', 'doc_id')), 4, 5, 1).collect()
    assert {(r['n'] > 80, r['half'] is not None) for r in rows} == {(True, True), (False, False)}


def test_line_dedup_leaves_only_tables_that_its_result_reads(spark, documents):
    from pathlib import Path
    from corpusward.llm.common import shared_folder
    there = set(Path(shared_folder(spark)).iterdir())
    found = dedup_lines(documents('a b c d e\nf g', 'e d c b a\nf h', None))
    left = sorted(p.name.split('-')[0] for p in set(Path(shared_folder(spark)).iterdir()) - there)
    assert left == ['lines', 'similar', 'similar']
    assert [r['removed'] for r in found.orderBy('doc_id').collect()] == [[], [0], []]


def test_line_dedup_is_native(documents):
    plan = dedup_lines(documents('a b c d e\nf'))._jdf.queryExecution().toString()
    assert not re.search('Python|Pandas|Arrow', plan)


def product(x, y):
    total = 0.0
    for p, q in zip(x, y):  # one after the other: sum() would round less
        total += float(p) * float(q)
    return total


def all_pairs(rows, every, k):
    out = []
    for a, x in rows:
        if a % every == 0:
            score = [(-product(x, y), b) for b, y in rows if b != a]
            out += [(a, r + 1, b, -s) for r, (s, b) in enumerate(sorted(score)[:k])]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)] + [(2000, [float(x) for x in rng.normal(size=6) * 9])]
    bad = [(5000, None), (5020, []), (5040, [0.0] * 6), (5060, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (5080, [float('nan')] * 6),
           (5100, [float('inf')] + [0.0] * 5), (None, [1.0] * 6)]
    frame = spark.createDataFrame([*rows, *bad, rows[3]], 'vec_id long, embedding array<double>').selectExpr('*', '1 as shard', '2 as v')
    for shard_rows in (100, 100000):
        found = sorted(map(tuple, nearest(frame, 'vec_id', 'embedding', k=7, shard_rows=shard_rows, block_rows=10).collect()))
        expected = sorted(all_pairs(rows, 20, 7))
        assert [f[:3] for f in found] == [e[:3] for e in expected]
        assert np.allclose([f[3] for f in found], [e[3] for e in expected], rtol=1e-12)
    assert nearest(frame.limit(0), 'vec_id', 'embedding').count() == 0
    assert nearest(frame.where('vec_id = 20'), 'vec_id', 'embedding').count() == 0


def test_neighbours_with_hundreds_of_ties(spark):
    """Small whole numbers: many different vectors have the same product with a query."""
    rng = np.random.default_rng(4)
    vectors = np.unique(rng.integers(-3, 4, size=(1500, 5)), axis=0)
    vectors = rng.permutation(vectors[(vectors != 0).any(1)])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(20, [3.0, 3.0, 3.0, 3.0, 3.0]), (9000, [1.0] * 5), (9020, [1.0] * 5)]
    frame = spark.createDataFrame(rows, 'vec_id long, embedding array<double>')
    found = sorted(map(tuple, nearest(frame, 'vec_id', 'embedding', k=20, shard_rows=400, block_rows=16).collect()))
    assert found == sorted(all_pairs(rows, 20, 20))
    tree = build(vectors.astype(float), np.arange(len(vectors)), 21)
    cut = nearest_rows(tree, np.arange(50), vectors[:50].astype(float), 20, 1.0, held=100)
    whole = nearest_rows(tree, np.arange(50), vectors[:50].astype(float), 20, 1.0)
    assert cut.reset_index(drop=True).equals(whole.reset_index(drop=True))


def test_relaxed_pruning_keeps_most():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 8))
    points = centres[rng.integers(30, size=3000)] + 0.1 * rng.normal(size=(3000, 8))
    tree = build(points, np.arange(3000), 11)
    exact, _ = search(tree, points[:200], 10, 1.0)
    relaxed, _ = search(tree, points[:200], 10, 1.3)
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact, relaxed)]) >= 0.9


def test_neighbour_query_recall(spark):
    from corpusward.llm.queries import QUERIES
    rows = [(r['vec_id'], r['embedding']) for r in spark.read.parquet(f'{SMALL}/embeddings.parquet').collect()]
    found = sorted(map(tuple, QUERIES['op9_nearest_neighbours'](spark, SMALL).collect()))
    expected = sorted(all_pairs(rows, 20, 20))
    assert len(found) == len(expected)
    assert np.mean([f[2] == e[2] for f, e in zip(found, expected)]) >= 0.99


def test_line_postings_are_sorted_once(spark, monkeypatch):
    """One order serves all that a line looks up among the postings of its words, and no filter is left to an interpreter."""
    from corpusward.llm import line_dedup

    plans, write = {}, line_dedup.written

    def seen(frame, name):
        plans.setdefault(name, frame._jdf.queryExecution().sparkPlan().toString())
        return write(frame, name)
    monkeypatch.setattr(line_dedup, 'written', seen)
    sets = spark.createDataFrame([(i, f'one two three four five six w{i % 7}') for i in range(30)], 'sid long, line string')
    # whoever differs in a seventh word only is similar to the first
    assert sorted(r['sid'] for r in line_dedup.near_repeats(sets, 3, 4, 1).collect()) == list(range(1, 30))
    assert plans['postings'].count('Window [') == 1
    assert 'lambdafunction' not in plans['postings'][:plans['postings'].index('Window [')]
