"""Filter audit, vector codes and decontamination against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusward.llm import vector_codes as V
from corpusward.llm.common import shared_folder
from corpusward.llm.decontamination import build_index, n_hit, near, occurrences, search, stretches
from corpusward.llm.filter_audit import audit


# --- filter audit --------------------------------------------------------------

def audit_by_hand(docs, labels):
    """docs: (id, text, part); labels: (id, quality, toxic)."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    rows = []
    for i, text, part in docs:
        text = text or ''
        words = [w for w in re.split(r'[\x20\x09-\x0D]+', text) if w]
        failed = {
            'A': len(words) < 100, 'B': 100 * len(set(words)) < 80 * len(words),
            'C': 100 * sum('A' <= c <= 'Z' for c in text) > 10 * len(text), 'D': bool(set(text) & set('#$%&*|')),
            'E': i is not None and any(o is not None and o < i and (t or '') == text for o, t, _ in docs)}
        rows.append((part or '', i, failed))
    out = []
    for part in {p for p, *_ in rows}:
        own, taken = [r for r in rows if r[0] == part], Counter()
        steps = []
        for order in permutations('ABCDE'):
            left = own
            for n, letter in enumerate(order, 1):
                removed = [r for r in left if r[2][letter]]
                before, left = left, [r for r in left if not r[2][letter]]
                redundant = sum(r[2][letter] for r in own) - len(removed)
                alone = sum(r[2][letter] and sum(r[2].values()) == 1 for r in own)
                taken[letter] += len(removed)
                steps.append([letter, (part, ''.join(order), n, len(left), len(removed), redundant, alone,
                                       sum(r[1] in good for r in removed), sum(r[1] in toxic for r in removed))])
        out += [(*row, taken[letter]) for letter, row in steps]
    return sorted(out)


def audit_texts():
    rng = random.Random(3)
    many = ' '.join(f'w{i}' for i in range(120))
    texts = [None, '', ' \n', 'ABC', 'a#b', many, many, many + ' $', 'w ' * 100, many.upper(), 'é' * 9 + 'A', 'é' * 8 + 'AA', 'a\x1cb ' * 60]
    return texts + [' '.join(rng.choice('xyzXYZ#') + str(rng.randint(0, 90)) for _ in range(rng.choice([40, 99, 100, 130]))) for _ in range(40)]


def test_audit(spark):
    texts = audit_texts()
    docs = [(i, t, ['en', 'de', None, ''][i % 4]) for i, t in enumerate(texts)]
    docs += [(3, 'ABC', 'en'), (None, 'ABC', 'en'), (None, None, 'fr'), (200, 'x' * 300_000, 'en'), (201, 'x' * 300_000, 'zz')]
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 60, 2)] + [(4, 0, 1), (4, 1, 0), (None, 1, 1), (5, None, None), (999, 1, 1)]
    frame = spark.createDataFrame([(*d, 'other', 1) for d in docs], 'doc_id long, text string, lang string, part string, n int')
    marked = spark.createDataFrame(labels, 'doc_id long, quality int, toxic int')
    got = sorted(tuple(r) for r in audit(frame, marked).collect())
    assert got == audit_by_hand(docs, labels)


def test_audit_of_nothing(spark, labels):
    empty = spark.createDataFrame([], 'doc_id long, text string, lang string')
    assert audit(empty, labels((1, 1, 1))).collect() == []
    assert audit(spark.createDataFrame([(1, 'a', 'en')], empty.schema), labels((1, 1, 1)).where('false')).count() == 600


# --- vector codes --------------------------------------------------------------

def codes_by_hand(rows, parts=8, entries=16, rounds=6):
    """rows: (id, vector, label) that take part, all of one length."""
    kept = sorted(((i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1])
    cuts = [(p * width // parts, (p + 1) * width // parts) for p in range(parts)]
    books = [[r[1][a:b] for r in kept[:entries]] for a, b in cuts]

    def best(v, book):
        return min((sum((x - y) ** 2 for x, y in zip(v, e)), at) for at, e in enumerate(book))
    for _ in range(rounds):
        for p, (a, b) in enumerate(cuts):
            members = {}
            for _, v, _ in kept:
                members.setdefault(best(v[a:b], books[p])[1], []).append(v[a:b])
            books[p] = [[sum(c) // len(members[e]) for c in zip(*members[e])] if e in members else old for e, old in enumerate(books[p])]
    found = [(i, label, [best(v[a:b], book) for (a, b), book in zip(cuts, books)]) for i, v, label in kept]
    sums = Counter()
    for _, label, f in found:
        sums[label] += sum(d for d, _ in f)
    text = ','.join(str(x) for book in books for e in book for x in e)

    def long(n):
        return n if n < 2 ** 63 else None
    return sorted(((i, ''.join(f'{e:02x}' for _, e in f), long(sum(d for d, _ in f)), long(sums[label])) for i, label, f in found), key=str), hashlib.sha256(text.encode()).hexdigest()


def coded(spark, rows, schema='vec_id long, embedding array<double>, label int', **options):
    table, books = V.compress(spark.createDataFrame(rows, schema).repartition(3), **options)
    found = V.with_label_error(table).select('vec_id', 'code', 'error', 'label_error').collect()
    return sorted((tuple(r) for r in found), key=str), V.digest(books)


@pytest.mark.parametrize('scale', [0.0005, 1.0, 300_000.0])  # many ties; floats; beyond 64-bit squares
def test_codes(spark, scale):
    rng = np.random.default_rng(5)
    vectors = np.round(rng.normal(size=(220, 16)) * scale, 3)
    vectors[40:60] = vectors[7]  # repeated vectors
    rows = [(int(i) if i != 9 else None, v.tolist(), None if i % 5 == 0 else int(i % 3)) for i, v in enumerate(vectors)]
    rows += [(300, rows[3][1], 1), (300, rows[3][1], 1)]
    bad = [(500, None, 1), (501, [], 1), (502, [1.0, None] + [0.0] * 14, 1), (503, [float('nan')] + [0.0] * 15, 2),
           (504, [float('-inf')] + [0.0] * 15, 2), (505, [0.0] * 8, 1), (506, [1e300] + [0.0] * 15, 1)]
    assert coded(spark, rows + bad) == codes_by_hand(rows)


def test_few_vectors_and_uneven_parts(spark):
    rows = [(i, [float(i), -i / 3, 0.5, i * i / 7, 1.0], 'x') for i in range(5)]
    schema = 'vec_id long, embedding array<float>, label string'
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert coded(spark, rows, schema) == codes_by_hand(rows)
    assert coded(spark, rows, schema, parts=2, entries=2, rounds=3, pivots=1) == codes_by_hand(rows, 2, 2, 3)
    empty, books = V.compress(spark.createDataFrame([], schema))
    assert V.with_label_error(empty).collect() == [] and all(not len(b) for b in books)


def test_pivots_leave_out_distances_but_no_nearest_entry():
    rng = np.random.default_rng(1)
    values = np.floor(4096 * rng.normal(size=(3000, 8))).astype(np.int64)
    entries = values[:16]
    pivots = V.far_apart(entries)
    stored = V.distances(values, pivots).astype(np.float32)
    index, best, tried = V.assign(values, stored, entries, pivots)
    exact = ((values[:, None, :] - entries[None]) ** 2).sum(2)
    assert (best == exact.min(1)).all() and (index == exact.argmin(1)).all()
    assert tried < 0.8 * exact.size


# --- decontamination -----------------------------------------------------------

WORD = re.compile(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')


def words(text):
    return WORD.findall(''.join(c.lower() if 'A' <= c <= 'Z' else c for c in text or ''))


def spans_by_hand(text, items, window=10):
    doc, out = words(text), []
    for item, t in items:
        own = words(t)
        n = min(window, len(own))
        for place in range(max(1, len(own) - window + 1) if own else 0):
            out += [(item, place, at, n) for at in range(len(doc) - n + 1) if doc[at:at + n] == own[place:place + n]]
    return sorted(out, key=str)


def leak_texts():
    rng = random.Random(8)
    vocabulary = ['the', 'of', 'É', 'naïve', 'x1'] + [f'word{i}' for i in range(30)]
    passages = [' '.join(rng.choice(vocabulary) for _ in range(n)) for n in (3, 9, 10, 11, 14, 25)]
    items = [(i, p) for i, p in enumerate(passages)] + [(6, None), (7, ''), (8, '--'), (9, passages[3].upper()), (10, 'the the the the the the the the the the the the'), (11, 'unheard ' * 12), (2, 'again ' + passages[2])]
    texts = [None, '', '...', 'the ' * 40, 'the ' * 9]
    for _ in range(60):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        kind = rng.randint(0, 3)
        if kind:
            p = passages[rng.randrange(len(passages))].split()
            if kind == 2:
                p[rng.randrange(len(p))] = 'other'
            at = rng.randint(0, len(own))
            own[at:at] = p
        texts.append(rng.choice([' ', ', ', '\n', '_']).join(own))
    texts += [passages[5]] * 3 + [passages[4] + ' ' + passages[4], ' '.join(vocabulary * 3000) + ' ' + passages[5]]
    # cut between two documents: no occurrence
    texts += [' '.join(passages[4].split()[:7]), ' '.join(passages[4].split()[7:])]
    return texts, items


def test_exact_phrases(spark):
    texts, items = leak_texts()
    docs = spark.createDataFrame([(i, t, 'x', 0) for i, t in enumerate(texts)] + [(None, texts[-3], 'x', 0), (1, 'the ' * 12, 'x', 0)],
                                 'doc_id long, text string, segment string, n int')
    tests = spark.createDataFrame([(i, t, 'y') for i, t in items], 'item_id long, text string, doc_id string')
    expected = sorted((str(r.doc_id), len(words(r.text)), spans_by_hand(r.text, items)) for r in docs.collect())
    for options in ({}, {'segment_tokens': 100, 'segment_docs': 3}):
        index = build_index(docs, **options)
        for block_words in (1 << 20, 40):
            found = search(index, tests, block_words=block_words).withColumn('n_hit', n_hit(F.col('spans'))).collect()
            assert sorted((str(r.doc_id), r.n_words, sorted((tuple(s) for s in r.spans), key=str)) for r in found) == expected, (options, block_words)
            for r in found:
                assert r.n_hit == len({p for s in r.spans for p in range(s.start, s.start + s.length)})
    assert sum(len(s) for *_, s in expected) > 100


def test_postings_hold_every_token(spark, documents):
    texts, _ = leak_texts()
    docs = documents(*texts)
    index = build_index(docs, segment_tokens=500)
    rows = index.collect()
    listed = {r.segment: r.docs for r in rows if r.term is None}
    found = {}
    for r in rows:
        if r.term is not None:
            assert r.n == len(r.positions) and list(r.positions) == sorted(r.positions)
            for p in r.positions:
                doc = max((d for d in listed[r.segment] if d.base <= p), key=lambda d: (d.base, d.n_words))
                found.setdefault(doc.doc_id, {})[p - doc.base] = r.term
    for i, t in enumerate(texts):
        assert [found.get(i, {}).get(p) for p in range(len(words(t)))] == words(t)


def test_no_documents_or_items(spark, documents):
    empty = documents('a').where('false')
    items = spark.createDataFrame([(1, 'a b c')], 'item_id long, text string')
    assert search(build_index(empty), items).collect() == []
    index = build_index(documents('a b c', None))
    assert sorted((r.doc_id, r.n_words, len(r.spans)) for r in search(index, items).collect()) == [(0, 3, 1), (1, 0, 0)]
    assert [len(r.spans) for r in search(index, items.where('false')).collect()] == [0, 0]


def stretches_by_hand(doc, window, span):
    need = set(window)
    found = [(a, b) for a in range(len(doc)) for b in range(a + 1, min(len(doc), a + span) + 1) if need <= set(doc[a:b])]
    return [s for s in found if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in found)]


def test_proximity(spark, documents):
    rng = random.Random(4)
    for _ in range(200):
        doc = [rng.randint(0, 6) for _ in range(rng.randint(0, 40))]
        window = tuple(rng.randint(0, 6) for _ in range(rng.randint(1, 5)))
        span = rng.randint(len(window), 12)
        lists = {t: np.array([i for i, x in enumerate(doc) if x == t], np.int32) for t in set(doc)}
        assert [tuple(s) for s in stretches(lists, window, span).tolist()] == stretches_by_hand(doc, window, span)
        assert occurrences(lists, window).tolist() == [i for i in range(len(doc) - len(window) + 1) if tuple(doc[i:i + len(window)]) == window]
    items = spark.createDataFrame([(1, 'red green blue')], 'item_id long, text string')
    index = build_index(documents('blue a red b green', 'blue a b c red green', 'red green', 'x', 'Blue, green; RED'))
    found = {r.doc_id: [(s.start, s.length) for s in r.spans] for r in near(index, items, 5).collect()}
    assert found == {0: [(0, 5)], 1: [], 2: [], 3: [], 4: [(0, 3)]}


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = 'spark://host:7077'
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}
    with pytest.raises(ValueError):
        shared_folder(Session())
