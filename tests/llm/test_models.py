"""Trained operators: held-out accuracy, exact recursions, guarantees, edge cases."""

import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusward.llm import hmm, langid, toxicity
from corpusward.llm.hmm import score_texts
from corpusward.llm.langid import identify
from corpusward.llm.quality_classifier import isotonic, score_quality
from corpusward.llm.quality_rules import GRID, binomial_tail, certified, judge, measured
from corpusward.llm.queries import QUERIES
from corpusward.llm.toxicity import grade_toxicity

from ..conftest import MEDIUM, SMALL

EDGES = [None, '', ' \n\t', '1234 !!!', 'x', 'word ' * 30000, 'same text here', 'same text here']


@pytest.fixture(scope='module')
def medium_labels(spark):
    return {r['doc_id']: r for r in spark.read.parquet(f'{MEDIUM}/labels.parquet').collect()}


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


# --- quality rules ----------------------------------------------------------------

def counts_of(text):
    text = text or ''
    words = [w for w in re.split(r'[\x20\x09-\x0D]+', text) if w]
    windows, covered, seen, repeated = {}, set(), set(), 0
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    for places in windows.values():
        if len(places) > 1:
            covered.update(p + k for p in places for k in range(8))
    for line in text.split('\n'):
        if re.search(r'[^\x20\x09-\x0D]', line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r'[#*$%&|<>]', text)), repeated, len(covered)


def test_counts(documents):
    rng = random.Random(5)
    texts = EDGES + [' '.join(rng.choice('ab') for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += ['\n'.join(rng.choice(['a b', '', ' ', 'c', '$# é 𝛼']) for _ in range(9)) for _ in range(20)]
    docs = documents(*texts, N_WORDS=['x'] * len(texts), _words=['y'] * len(texts))
    for r in measured(docs).collect():
        assert tuple(r[c] for c in ('n_words', 'word_chars', 'n_symbols', 'n_dup_lines', 'n_repeat_words')) == counts_of(texts[r['doc_id']])


def test_rules_query(spark, medium_labels):
    texts = {r['doc_id']: r['text'] for r in spark.read.parquet(f'{MEDIUM}/documents.parquet').collect()}
    rows = QUERIES['op6_quality_rules'](spark, MEDIUM).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, _, _, _, repeats = found = counts_of(texts[r['doc_id']])
        assert tuple(r)[1:6] == found
        assert r['base_failed'] == (n < 20 or 100 * repeats > 30 * n)
        assert not (r['base_failed'] and r['kept'])


def test_rules_are_native(spark):
    plan = QUERIES['op6_quality_rules'](spark, SMALL)._jdf.queryExecution().toString()
    assert not re.search('Python|Pandas|Arrow', plan)


def test_bound_is_exact():
    for n, p in ((10, 0.3), (200, 0.01), (900, 0.008)):
        for k in (0, 1, n // 50, n // 10):
            exact = math.fsum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
            assert binomial_tail(k, n, p) == pytest.approx(exact, rel=1e-9)


def test_cutoffs_keep_their_promise():
    """Of many holdouts of a stratum at the limit, few lead to a cut-off that rejects too many."""
    rng = np.random.default_rng(3)
    alpha, delta, tests, n = 0.05, 0.05, 36, 4000
    share = alpha / len(GRID)
    wrong = 0
    for _ in range(300):
        beyond = {name: sorted(rng.binomial(n, share * 1.05, len(grid)), reverse=True) for name, grid in GRID.items()}
        wrong += bool(certified(n, beyond, tests, alpha, delta))
    assert wrong <= 300 * delta
    assert certified(n, {'upper_share': [3000, 40, 2, 0, 0, 0]}, tests, alpha, delta) == {'upper_share': GRID['upper_share'][2]}
    assert certified(0, {'upper_share': [0] * 6}, tests, alpha, delta) == {}


def test_rules_edges(documents, labels, spark):
    docs = documents(*EDGES, lang=['en', None] * 4)
    rows = judge(docs, labels((0, 1, 0), (None, 1, None), (1, None, 0))).collect()
    assert len(rows) == len(EDGES) and all(r['kept'] is not None for r in rows)
    assert judge(docs.limit(0), labels((0, 1, 0))).count() == 0
    clean = documents(*[' '.join(f'w{i}x{j}' for j in range(40)) for i in range(3000)],
                      lang=['en'] * 3000)
    noisy = clean.withColumn('text', F.when(F.col('doc_id') % 10 == 0, F.concat('text', F.lit(' ###' * 40))).otherwise(F.col('text')))
    marks = noisy.select('doc_id', (F.col('doc_id') % 10 != 0).cast('int').alias('quality'), F.lit(0).alias('toxic'))
    done = judge(noisy, marks).groupBy((F.col('doc_id') % 10 == 0).alias('noisy'), 'kept').count().collect()
    assert sorted(map(tuple, done)) == [(False, True, 2700), (True, False, 300)]


# --- quality classifier -----------------------------------------------------------

def auc(good, bad):
    good, bad = np.array(good)[:, None], np.array(bad)[None]
    return ((good > bad).mean() + (good == bad).mean() / 2)


def test_quality_held_out(spark, medium_labels):
    rows = [r for r in QUERIES['op7_quality_classifier'](spark, MEDIUM).collect()]
    assert len({r['doc_id'] for r in rows}) == len(rows) == 1000
    assert all(0 <= r['score'] <= 1 and r['predicted'] == (r['score'] >= 0.3) and r['held_out'] == (fold(r['doc_id'], 5) == 0) for r in rows)
    held = {q: [r['score'] for r in rows if r['held_out'] and r['doc_id'] in medium_labels and medium_labels[r['doc_id']]['quality'] == q]
            for q in (0, 1)}
    assert auc(held[1], held[0]) > 0.9


def test_held_out_labels_are_not_learned(spark):
    docs = spark.read.parquet(f'{SMALL}/documents.parquet').select('doc_id', 'text')
    marks = spark.read.parquet(f'{SMALL}/labels.parquet')
    other = marks.withColumn('quality', F.when(F.crc32(F.col('doc_id').cast('string')) % 5 == 0, 1 - F.col('quality')).otherwise(F.col('quality')))
    a, b = ({r['doc_id']: r['score'] for r in score_quality(docs, m).collect()} for m in (marks, other))
    assert a == pytest.approx(b, abs=1e-9)


def test_isotonic():
    values, share = isotonic(np.arange(6.0), np.full(6, 100.0), np.array([10.0, 5, 30, 80, 70, 95]))
    assert (np.diff(share) > 0).all() and len(values) == 4


def test_quality_edges(documents, labels):
    docs = documents(*EDGES, x=['a'] * 8, SCORE=['b'] * 8)
    for marks in (labels((None, 1, 1), (1, None, 0)), labels((0, 1, 0), (1, 0, 0), (1, 1, 0), (7, 1, 0), (99, 0, 0))):
        rows = score_quality(docs, marks).collect()
        assert len(rows) == 8 and all(0 <= r['score'] <= 1 for r in rows)
        assert rows[6]['score'] == rows[7]['score'] and rows[0]['x'] == 'a'
    assert score_quality(docs.limit(0), labels((1, 1, 0))).count() == 0


# --- toxicity -----------------------------------------------------------------------

def test_toxicity(spark, medium_labels):
    rows = {r['doc_id']: r for r in QUERIES['op2_toxicity'](spark, MEDIUM).collect()}
    assert len(rows) == 1000 and all(0 <= r['severity'] <= 3 for r in rows.values())
    found = {t: [rows[i]['toxic'] for i, m in medium_labels.items() if m['toxic'] == t] for t in (0, 1)}
    assert np.mean(found[1]) > 0.8 and np.mean(found[0]) < 0.02


def test_thresholds_share_weights():
    model = toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), np.array([1.0, 2.0, 4.0]))
    model.weights[toxicity.buckets('bad')[0]] = 1.5
    p, q = model.chances('fine words'), model.chances('fine BAD words')
    assert (np.diff(p) < 0).all() and np.log(q / (1 - q)) - np.log(p / (1 - p)) == pytest.approx(1.5)
    assert (model.chances(None) == p).all()


def test_grades_follow_the_vocabulary():
    rng, vile = random.Random(1), [f'{chr(97 + i) * 3}bad' for i in range(9)]

    def row(toxic, bad):
        words = [f'w{chr(97 + rng.randint(0, 25))}{chr(97 + rng.randint(0, 11))}' for _ in range(30)] + rng.sample(vile, bad)
        found = [toxicity.buckets(w) for w in sorted(set(words))]
        return {'toxic': toxic, 'ids': np.array([i for b in found for i in b]), 'of': np.array([k for k, b in enumerate(found) for _ in b])}

    model = toxicity.fit([row(0, 0) for _ in range(300)] + [row(1, n) for n in (1, 2, 4, 5, 8, 9) for _ in range(50)])
    severity = [model.chances(' '.join(vile[:n])).sum() for n in (0, 1, 4, 9)]
    assert severity == sorted(severity) and severity[0] < 0.3 and severity[3] > 2.2
    assert toxicity.fit([]) is None


def test_toxicity_fit_copies_no_sample():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, toxicity.BUCKETS, (500, 3000)).astype(np.int32)
    rows = [{'toxic': k % 2, 'ids': x, 'of': np.arange(3000, dtype=np.int32) // 3} for k, x in enumerate(ids)]
    tracemalloc.start()
    assert toxicity.fit(rows, steps=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # weights and counts per bucket have a fixed size, here more than the sample; before, 51 MB
    assert peak < 16 * 8 * toxicity.BUCKETS


def test_toxicity_edges(documents, labels):
    docs = documents(*EDGES, toxic=['a'] * 8, _found=['b'] * 8)
    for marks in (labels((None, 1, 1)), labels((0, 1, 0), (1, 0, 1), (7, 1, 1), (7, 1, 0), (6, None, None))):
        rows = grade_toxicity(docs, marks).collect()
        assert len(rows) == 8 and rows[0]['_found'] == 'b' and rows[6]['severity'] == rows[7]['severity']
    assert grade_toxicity(docs.limit(0), labels((1, 1, 0))).count() == 0


# --- language -----------------------------------------------------------------------

def test_language_held_out(spark):
    truth = {r['doc_id']: r['lang'] for r in spark.read.parquet(f'{MEDIUM}/documents.parquet').collect()}
    rows = QUERIES['op3_language_id'](spark, MEDIUM).collect()
    assert len(rows) == 1000 and all(0 <= r['score'] <= 1 and r['held_out'] == (fold(r['doc_id'], 3) == 1) for r in rows)
    held = [r for r in rows if r['held_out']]
    assert np.mean([r['lang_pred'] == truth[r['doc_id']] for r in held]) > 0.97
    assert np.mean([r['lang_pred'] == truth[r['doc_id']] for r in held if not r['rejected']]) > 0.985


def test_language_edges(documents):
    docs = documents(*EDGES, lang=['en', 'en', 'de', 'de', 'en', None, 'en', 'de'], SCORE=['x'] * 8)
    rows = identify(docs).collect()
    assert [r['lang_pred'] == 'und' for r in rows] == [True] * 4 + [False] * 4
    assert identify(docs.limit(0)).count() == 0
    assert {r['lang_pred'] for r in identify(docs.withColumn('lang', F.lit(None).cast('string'))).collect()} == {'und'}
    assert {r['lang_pred'] for r in identify(docs.withColumn('lang', F.lit('xx'))).collect()} == {'und', 'xx'}


def test_blocks_give_the_whole_text(monkeypatch):
    text = 'Höher ab-c 12 ' * 50
    whole = np.sort(np.concatenate([ids for ids, _ in langid.blocks(text)]))
    assert len(whole) > 1000
    monkeypatch.setattr(langid, 'BLOCK', 37)
    parts = list(langid.blocks(text))
    assert sum(n for _, n in parts) >= sum(c.isalpha() for c in text) and len(parts) == 19


# --- hidden Markov model --------------------------------------------------------------

def by_all_paths(model, symbols):
    total = 0.0
    for path in itertools.product(range(hmm.STATES), repeat=len(symbols)):
        p = model.start[path[0]] * model.emit[symbols[0], path[0]]
        for i in range(1, len(symbols)):
            p *= model.move[path[i - 1], path[i]] * model.emit[symbols[i], path[i]]
        total += p
    return math.log(total)


def test_forward_and_expected_counts():
    rng = np.random.default_rng(0)
    shares = np.zeros(hmm.CLASSES)
    shares[:6] = rng.dirichlet(np.ones(6))
    model = hmm.first_guess(shares)
    sequences = [rng.integers(0, 6, n).astype(np.int32) for n in (3, 1, 4, 2, 4)]
    assert hmm.log_chances(model, sequences) == pytest.approx([by_all_paths(model, s) for s in sequences])
    counts = {'start': np.zeros(hmm.STATES), 'move': np.zeros((hmm.STATES,) * 2), 'emit': np.zeros((hmm.CLASSES, hmm.STATES))}
    hmm.expected(model, sequences, np.ones(5, bool), counts)
    assert counts['emit'].sum() == pytest.approx(14) and counts['move'].sum() == pytest.approx(9) and counts['start'].sum() == pytest.approx(5)
    assert counts['emit'].sum(1)[:6] == pytest.approx(np.bincount(np.concatenate(sequences), minlength=6))
    # one step of Baum-Welch never makes the sequences less likely
    better = hmm.Model(counts['start'] / 5, counts['move'] / counts['move'].sum(1, keepdims=True), counts['emit'] / counts['emit'].sum(0))
    assert hmm.log_chances(better, sequences).sum() >= hmm.log_chances(model, sequences).sum()


@pytest.mark.parametrize('least', [1, 1e-30])
def test_texts_end_between_two_scalings(least):
    """Lengths around the tokens from one scaling to the next, with chances as small as they can be."""
    rng = np.random.default_rng(1)
    model = hmm.first_guess(rng.dirichlet(np.ones(hmm.CLASSES)))
    model.emit[:6] *= least
    sequences = [rng.integers(0, 6, n).astype(np.int32) for n in (1, 7, 8, 9, 15, 16, 17, 3, 40, 16)]

    def by_steps(symbols):
        total, alpha = 0.0, model.start
        for i, k in enumerate(symbols):
            alpha = (alpha if i == 0 else alpha @ model.move) * model.emit[k]
            total, alpha = total + math.log(alpha.sum()), alpha / alpha.sum()
        return total
    assert hmm.log_chances(model, sequences) == pytest.approx([by_steps(s) for s in sequences], rel=1e-12)


def test_scores(spark):
    texts = {r['doc_id']: r['text'] for r in spark.read.parquet(f'{MEDIUM}/documents.parquet').collect()}
    tokens = {i: [*(t or '').encode().lower().split(), b''] for i, t in texts.items()}
    counts = Counter(w for i, t in tokens.items() if fold(i, 10) for w in t)
    total, different = sum(counts.values()), len(counts)
    rows = QUERIES['op10_hmm_scores'](spark, MEDIUM).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = tokens[r['doc_id']]
        assert (r['held_out'], r['n_tokens'], r['n_known'], r['train_tokens']) == (
            fold(r['doc_id'], 10) == 0, len(t), sum(counts[w] > 0 for w in t), total)
        assert r['base_score'] == pytest.approx(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (different + 1))) for w in t), rel=1e-9)
    held = [r for r in rows if r['held_out']]
    assert sum(r['score'] for r in held) > sum(r['base_score'] for r in held)


def test_score_edges(documents, spark):
    docs = documents(*EDGES, score=['x'] * 8, c=['y'] * 8)
    rows = sorted(score_texts(docs).collect())
    assert [r['n_tokens'] for r in rows] == [1, 1, 1, 3, 2, 30001, 4, 4]
    assert all(math.isfinite(r['score']) and r['score'] < 0 for r in rows) and rows[6]['score'] == rows[7]['score']
    assert score_texts(docs.limit(0)).count() == 0
    nulls = score_texts(docs.withColumn('doc_id', F.lit(None).cast('long'))).collect()
    assert len(nulls) == 8 and not any(r['held_out'] for r in nulls) and {r['train_tokens'] for r in nulls} == {0}


def test_chances_add_up(documents):
    """The words of a class share its chance: all one-word texts together have the chance of one-word texts."""
    docs = documents(*['a b', 'b a c', 'c c', 'd'] * 10)
    rows = score_texts(docs.unionByName(documents('a', 'b', 'c', 'd').withColumn('doc_id', F.col('doc_id') + 1000)), passes=2).collect()
    single = [10 ** r['score'] for r in rows if r['doc_id'] >= 1000]
    assert 0 < sum(single) < 1


def test_quality_rules_keep_a_null_stratum_apart(spark):
    """Null and the empty string have cut-offs of their own."""
    good = ' '.join(f'word{i}' for i in range(40))
    texts = [(i, good, None) for i in range(3000)] + [(3000 + i, good + ' !!!' * 30, '') for i in range(3000)] + [(9000, good + ' !!!' * 30, None), (9001, good + ' !!!' * 30, '')]
    docs = spark.createDataFrame(texts, 'doc_id long, text string, lang string')
    marked = spark.createDataFrame([(i, 1) for i in range(6000)], 'doc_id long, quality int')
    found = {r.doc_id: (r.kept, list(r.reasons), r.stratum) for r in judge(docs, marked).where('doc_id >= 9000').collect()}
    assert found[9000][2] is None and not found[9000][0] and 'marks_per_word' in found[9000][1]
    assert found[9001][2] == '' and 'marks_per_word' not in found[9001][1]


@pytest.mark.parametrize('n', [10 ** 9, 10 ** 11])
def test_binomial_tail_of_many_documents(n):
    """Four deviations below the mean the tail is that of the normal distribution, all terms counted."""
    p = 0.05 / 6
    k = int(n * p - 4 * math.sqrt(n * p * (1 - p)))
    assert binomial_tail(k, n, p) == pytest.approx(0.5 * math.erfc(4 / math.sqrt(2)), rel=0.01)


def hmm_by_hand(texts, passes):
    """Classes, class shares, Baum-Welch and scores of {id: text} in plain Python."""
    split = {i: (t or '').encode().lower().split() for i, t in texts.items()}
    learned = [i for i in texts if fold(i, 10)]
    count = Counter(w for i in learned for w in split[i])
    top = sorted(count, key=lambda w: (-count[w], w))[:hmm.TOP]
    own = {w: 1 + k for k, w in enumerate(top)}

    def shared(w):
        return 1 + hmm.TOP + zlib.crc32(w[-3:]) % hmm.ENDINGS
    size, words = [0.0] * hmm.CLASSES, [0.0] * hmm.CLASSES
    size[0] = len(learned)
    for w, c in count.items():
        size[own.get(w, shared(w))] += c
        words[shared(w)] += w not in own
    total = sum(x + hmm.SMOOTH for x in size)
    shares = np.array([(x + hmm.SMOOTH) / total for x in size])
    shares[1 + len(top):1 + hmm.TOP] = 0
    shares /= shares.sum()
    symbols = {i: [own.get(w, shared(w)) for w in split[i]] + [0] for i in texts}
    model, n = hmm.first_guess(shares), hmm.STATES

    def forward(s):
        rows = [[model.start[k] * model.emit[s[0], k] for k in range(n)]]
        for x in s[1:]:
            rows.append([sum(rows[-1][j] * model.move[j, k] for j in range(n)) * model.emit[x, k] for k in range(n)])
        return rows
    for _ in range(passes):
        start, move, emit = np.zeros(n), np.zeros((n, n)), np.zeros((hmm.CLASSES, n))
        for i in learned:
            s, alpha = symbols[i], forward(symbols[i])
            beta = [[1.0] * n]
            for x in reversed(s[1:]):
                beta.insert(0, [sum(model.move[k, j] * model.emit[x, j] * beta[0][j] for j in range(n)) for k in range(n)])
            chance = sum(alpha[-1])
            for at, x in enumerate(s):
                for k in range(n):
                    emit[x, k] += alpha[at][k] * beta[at][k] / chance
                    start[k] += alpha[at][k] * beta[at][k] / chance if at == 0 else 0
                    for j in range(n) if at else ():
                        move[j, k] += alpha[at - 1][j] * model.move[j, k] * model.emit[x, k] * beta[at][k] / chance
        start, move, emit = start + 0.1, move + 0.1, emit + 0.01 + shares[:, None]
        model = hmm.Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    out = {}
    for i in texts:
        score = math.log10(sum(forward(symbols[i])[-1]))
        for w in split[i]:
            if w not in own:
                k = shared(w)
                score += math.log10(count[w] + hmm.SMOOTH) - math.log10(size[k] + hmm.SMOOTH * (words[k] + 1))
        out[i] = score
    return out


def test_scores_by_hand(documents):
    rng = random.Random(6)
    words = [f'w{i}' for i in range(2300)]  # more than have a class of their own
    texts = [' '.join(rng.choice(words[:40] if rng.random() < 0.5 else words) for _ in range(rng.randint(0, 40))) for _ in range(150)] + [None, 'neverseen w1', 'W1 w2']
    expected = hmm_by_hand(dict(enumerate(texts)), 2)
    found = {r['doc_id']: r['score'] for r in score_texts(documents(*texts).repartition(3), passes=2).collect()}
    assert found == pytest.approx(expected, rel=1e-9)


def test_quality_verdicts_by_hand(spark, documents):
    """Counts of good documents beyond each cut-off, their exact bounds, the lowest certified ones and the verdicts."""
    rng = random.Random(12)
    texts, langs, labels = [], [], []
    for i in range(12000):
        poor = rng.random() < 0.3
        n = rng.randint(15, 60)
        text = ' '.join(rng.choice(['alpha', 'beta', 'gamma!', 'DELTA', 'long' * 4, 'x']) if poor and rng.random() < 0.5 else f'word{rng.randint(0, 500)}' for _ in range(n))
        texts.append(text + (' ###' * 20 if poor else ''))
        langs.append(['en', 'de', None][i % 3])
        labels.append((i, int(not poor or rng.random() < (0.2 if i % 3 == 1 else 0.01))))
    docs = documents(*texts, lang=langs)
    marked = spark.createDataFrame(labels, 'doc_id long, quality int')
    counted = {r['doc_id']: r for r in measured(docs).collect()}

    def values(r):
        w, c, lines = r['n_words'], r['word_chars'], r['n_lines']
        return {'symbols_per_word': r['n_symbols'] / w, 'marks_per_word': r['n_marks'] / w, 'upper_share': r['n_upper'] / c,
                'repeated_lines': r['n_dup_lines'] / lines, 'repeated_words': r['n_repeat_words'] / w, 'long_words': c / w}

    def failed(r):
        return r['n_words'] < 20 or 100 * r['n_repeat_words'] > 30 * r['n_words']
    tests, limits = 3 * sum(map(len, GRID.values())), {}
    for lang in ('en', 'de', None):
        good = [values(counted[i]) for i, q in labels if q and langs[i] == lang and not failed(counted[i])]
        for name, grid in GRID.items():
            for cutoff in grid:
                k, n, p = sum(v[name] > cutoff for v in good), len(good), 0.05 / len(GRID)
                tail = math.fsum(math.comb(n, j) * p ** j * (1 - p) ** (n - j) for j in range(k + 1))
                if k < p * n and tail <= 0.05 / tests:
                    limits[lang, name] = cutoff
                    break
    assert any(c != GRID[name][0] for (_, name), c in limits.items())
    for r in judge(docs, marked).collect():
        reasons = [name for name, v in values(counted[r['doc_id']]).items() if (r['stratum'], name) in limits and v > limits[r['stratum'], name]]
        assert (r['reasons'], r['base_failed'], r['kept']) == (reasons, failed(counted[r['doc_id']]), not reasons and not failed(counted[r['doc_id']]))


def test_least_hashed_rows(spark):
    """The rows of smallest hash of each group, however hot the group or a key."""
    from corpusward.llm.common import least_hashed
    rows = [(i, 'hot' if i % 10 else f'g{i % 3}', f't{i}') for i in range(20_000)] + [(7, 'hot', 'again')] * 5_000 + [(None, 'hot', 'n')] * 3
    frame = spark.createDataFrame(rows, 'k long, g string, _rank string').repartition(7)
    hashed = {r.k: r.h for r in frame.select('k', F.xxhash64('k').alias('h')).distinct().collect()}
    found = {}
    for r in least_hashed(frame, 'k', 'g', 50).collect():
        found.setdefault(r.g, []).append(r.k)
    for group in {g for _, g, _ in rows}:
        assert sorted(found[group], key=hashed.get) == sorted({k for k, g, _ in rows if g == group}, key=hashed.get)[:50]
    assert least_hashed(frame.where('false'), 'k', 'g', 5).collect() == []
