"""Toxicity as a severity grade: cumulative-link ordinal regression on sparse text features.

P(grade >= k) = sigmoid(w.x - theta_k): one weight vector, none of it negative, for all thresholds.  x
counts the hashed words of a text, and the hashed beginnings of its words, each
different word once.  The labels say toxic or not; a toxic text's grade comes from
how many of its different words are toxic vocabulary, i.e. far more frequent among
the toxic texts of the sample: grade 1 up to two of them, 2 up to five, 3 above.

Fitting takes a bounded sample of labelled rows (``sample_rows``, half of them
toxic where there are as many); scoring reads whole texts of all rows.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import free_name, gathered, least_hashed

BUCKETS = 1 << 18
GRADES = 3
STARTS = (4, 5, 6)
CACHED_WORDS = 300_000
_WORD = re.compile(r'[^\W\d_]+')


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def buckets(word: str) -> list[int]:
    """The word and, of longer words, their beginnings."""
    return [zlib.crc32(s.encode()) % BUCKETS for s in (f'={word}', *(word[:n] for n in STARTS if len(word) > n))]


@dataclass
class Model:
    weights: np.ndarray  # per bucket
    thresholds: np.ndarray  # rising, one per grade
    known: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return self.weights, self.thresholds

    def __setstate__(self, state):
        (self.weights, self.thresholds), self.known = state, {}

    def word(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= CACHED_WORDS:
                self.known.clear()
            found = self.known[word] = float(self.weights[buckets(word)].sum())
        return found

    def chances(self, text: str | None) -> np.ndarray:
        """P(grade >= k) for k from 1."""
        total = sum(map(self.word, words_of(text or '')))
        return 1 / (1 + np.exp(np.clip(self.thresholds - total, -50, 50)))


def sample(docs: DataFrame, labels: DataFrame, text: str, key: str, sample_rows: int) -> DataFrame:
    """(toxic, ids array<int>, of array<int>) of the sampled rows: buckets and the number of the word each is of."""
    marks = (labels.where('toxic is not null').groupBy(F.col(key).alias('_key')).agg(F.max('toxic').alias('toxic'))
             .where('_key is not null'))
    chosen = least_hashed(marks, '_key', 'toxic', sample_rows // 2)

    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            found = [buckets(w) for w in sorted(words_of(t.as_py() or ''))]
            rows.append({'ids': [i for b in found for i in b], 'of': [k for k, b in enumerate(found) for _ in b]})
        return pa.array(rows, pa.struct([('ids', pa.list_(pa.int32())), ('of', pa.list_(pa.int32()))]))

    own = docs.select(F.col(key).alias('_id'), F.col(text).alias('_text'))
    # the sample has a bounded number of ids
    rows = own.join(F.broadcast(chosen), F.col('_id') == F.col('_key'))
    return rows.select('toxic', F.arrow_udf(run, 'struct<ids: array<int>, of: array<int>>')('_text').alias('f')).select('toxic', 'f.ids', 'f.of')


def fit(rows: list, ridge: float = 1.0, steps: int = 250, min_rows: int = 3) -> Model | None:
    """Model from (toxic, ids, of) rows; None without rows of both kinds."""
    toxic = np.array([r['toxic'] for r in rows], bool)
    if not toxic.any() or toxic.all():
        return None
    # one order for the rows, whatever order they came in
    rows = sorted(rows, key=lambda r: (r['toxic'], len(r['ids']), r['ids'][:50].tolist()))
    toxic = np.array([r['toxic'] for r in rows], bool)
    # views of the sample, counted row by row: of copies the driver would not get all memory back
    ids = [np.asarray(r['ids'], np.int32) for r in rows]
    of = [np.asarray(r['of'], np.int32) for r in rows]
    seen, bad = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for i, t in zip(ids, toxic):
        distinct = np.unique(i)
        seen[distinct] += 1
        bad[distinct] += t
    fine = seen - bad
    # toxic vocabulary: buckets that many toxic texts have and hardly another one
    odds = np.log((bad + 0.5) / (toxic.sum() + 1)) - np.log((fine + 0.5) / ((~toxic).sum() + 1))
    vocabulary = (odds > 2) & (bad >= min_rows)
    grade = np.zeros(len(rows), int)
    for k in np.flatnonzero(toxic):
        hits = len(np.unique(of[k][vocabulary[ids[k]]]))
        grade[k] = 1 if hits <= 2 else 2 if hits <= 5 else 3
    # only what toxic texts have significantly more often has a weight, and none is negative:
    # no other words, however many, make a text more or less toxic
    share = toxic.mean()
    surplus = (bad - seen * share) / np.sqrt(seen * share * (1 - share) + 1e-9)
    keep = np.flatnonzero((seen >= min_rows) & (surplus >= 2.5))
    column = np.full(BUCKETS, -1)
    column[keep] = np.arange(len(keep))
    cols = [c[c >= 0] for c in (column[i] for i in ids)]
    row = np.repeat(np.arange(len(rows)), [len(c) for c in cols])
    col = np.concatenate(cols)
    w, theta = np.zeros(len(keep)), np.array([0.5, 1.5, 2.5])
    m_w, v_w, m_t, v_t = np.zeros_like(w), np.zeros_like(w), np.zeros(GRADES), np.zeros(GRADES)
    for step in range(1, steps + 1):
        z = np.bincount(row, w[col], minlength=len(rows))
        p = 1 / (1 + np.exp(np.clip(theta - z[:, None], -50, 50)))
        # likelihood of the grade: difference of two neighbouring cumulative chances
        edge = np.hstack([np.ones((len(rows), 1)), p, np.zeros((len(rows), 1))])
        here = np.maximum(edge[np.arange(len(rows)), grade] - edge[np.arange(len(rows)), grade + 1], 1e-9)
        slope = np.hstack([np.zeros((len(rows), 1)), p * (1 - p), np.zeros((len(rows), 1))])
        up, down = slope[np.arange(len(rows)), grade], slope[np.arange(len(rows)), grade + 1]
        g_z = -(up - down) / here
        g_t = np.zeros(GRADES + 2)
        np.add.at(g_t, grade, up / here)
        np.add.at(g_t, grade + 1, -down / here)
        g_w = np.bincount(col, g_z[row], minlength=len(w)) + ridge * w
        for a, g, m, v in ((w, g_w, m_w, v_w), (theta, g_t[1:-1], m_t, v_t)):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            a -= 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
        np.maximum(w, 0, out=w)
        theta.sort()
    weights = np.zeros(BUCKETS, np.float32)
    weights[keep] = w
    return Model(weights, theta)


def graded(text: Column, model: Model) -> Column:
    """struct<expected, grade, chance>: expected severity, the likeliest grade, and P(grade >= 1)."""
    def run(texts: pa.Array) -> pa.Array:
        p = np.array([model.chances(t.as_py()) for t in texts]).reshape(len(texts), GRADES)
        each = -np.diff(np.hstack([np.ones((len(p), 1)), p, np.zeros((len(p), 1))]))
        return pa.StructArray.from_arrays(
            [pa.array(p.sum(1)), pa.array(each.argmax(1).astype(np.int32)), pa.array(p[:, 0])], ['expected', 'grade', 'chance'])
    # marked so, the function is evaluated once whatever reads its result
    return F.arrow_udf(run, 'struct<expected: double, grade: int, chance: double>').asNondeterministic()(text)


def grade_toxicity(docs: DataFrame, labels: DataFrame, text: str = 'text', key: str = 'doc_id', sample_rows: int = 6000,
                   threshold: float = 0.5) -> DataFrame:
    """Adds severity (expected, 0 to 3), grade (0 to 3), toxic_chance and toxic; columns of these names are replaced.

    ``labels`` has the key and ``toxic``; null keys and labels are not used, and a
    document labelled both ways is toxic.  Null and empty texts have no feature.
    Without labels of both kinds nothing is toxic.
    """
    docs = docs.drop('severity', 'grade', 'toxic_chance', 'toxic')
    model = fit(gathered(sample(docs, labels, text, key, sample_rows)))  # bounded by sample_rows
    if model is None:
        return docs.withColumns({'severity': F.lit(0.0), 'grade': F.lit(0), 'toxic_chance': F.lit(0.0), 'toxic': F.lit(False)})
    found, = free_name(docs, '_found')
    return (docs.withColumn(found, graded(F.col(text), model))
            .withColumns({'severity': F.col(found)['expected'], 'grade': F.col(found)['grade'],
                          'toxic_chance': F.col(found)['chance'], 'toxic': F.col(found)['chance'] >= threshold}).drop(found))
