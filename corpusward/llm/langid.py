"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its hashed character n-grams; a linear
layer gives the languages.  Training is stochastic gradient descent in numpy on a
bounded sample of labelled rows (``per_language`` rows of each language, in order
of a hash of the id).  A part of the sample sets the temperature of the
probabilities and the score under which a prediction is marked as rejected.
Prediction reads whole texts, in blocks of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import fold, free_name, gathered, least_hashed

BUCKETS = 1 << 14
SIZES = (2, 3, 4)
BLOCK = 500_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def subwords(text: str, start: int, end: int) -> tuple[np.ndarray, int]:
    """(buckets of the n-grams that start in text[start:end], letters there); words are set off by a space."""
    part = text[start:end + max(SIZES) - 1].lower() if text else ''
    codes = np.frombuffer((' ' + part + ' ').encode('utf-32-le', 'surrogatepass'), '<u4').astype(np.uint64)
    letter = _letters()[codes]
    codes[~letter] = 32
    found = []
    for n in SIZES:
        count = min(len(codes) - n + 1, end - start + 1)
        if count < 1:
            continue
        h, whole = np.full(count, n, np.uint64), np.ones(count, bool)
        for k in range(n):
            h = (h ^ codes[k:k + count]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if 0 < k < n - 1:
                whole &= letter[k:k + count]  # a space only at either end
        whole &= letter[:count] | letter[n - 1:n - 1 + count]
        found.append((h[whole] >> np.uint64(17)) % np.uint64(BUCKETS))
    return (np.concatenate(found).astype(np.int32) if found else np.empty(0, np.int32)), int(letter.sum())


def blocks(text: str):
    for start in range(0, len(text), BLOCK):
        yield subwords(text, start, min(start + BLOCK, len(text)))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket x language: embeddings already through the linear layer
    bias: np.ndarray
    temperature: float = 1.0
    reject_under: float = 0.0

    def logits(self, text: str) -> np.ndarray | None:
        """None for a text without a letter."""
        total, n, letters = np.zeros(len(self.languages)), 0, 0
        for ids, seen in blocks(text):
            total += self.table[ids].sum(0, dtype=float)
            n += len(ids)
            letters += seen
        return (total / max(n, 1) + self.bias) if letters else None

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        z = self.logits(text) if text and self.languages else None
        if z is None:
            return 'und', 0.0, True
        p = softmax(z[None] / self.temperature)[0]
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.reject_under)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def sample(docs: DataFrame, text: str, label: str, key: str, per_language: int) -> DataFrame:
    """Bucket counts of the sampled rows: (label, ids array<int>, counts array<int>)."""
    chosen = least_hashed(docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(key, label, text), key, label, per_language)

    def counted(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            ids = [i for i, _ in blocks(t.as_py())]
            bucket, n = np.unique(np.concatenate(ids) if ids else np.empty(0, np.int32), return_counts=True)
            rows.append({'ids': bucket.astype(np.int32), 'counts': n.astype(np.int32)})
        return pa.array(rows, pa.struct([('ids', pa.list_(pa.int32())), ('counts', pa.list_(pa.int32()))]))

    count = F.arrow_udf(counted, 'struct<ids: array<int>, counts: array<int>>')
    return chosen.select(F.col(label).alias('label'), count(F.col(text)).alias('f')).select('label', 'f.ids', 'f.counts')


def fit(rows: list, dimensions: int = 16, epochs: int = 12, rate: float = 0.5, precision: float = 0.99, seed: int = 3) -> Model:
    """Model from (label, ids, counts) rows; every fifth row of the shuffled sample calibrates."""
    languages = sorted({r['label'] for r in rows})
    if len(languages) < 2:
        return Model(languages, np.zeros((BUCKETS, len(languages)), np.float32), np.zeros(len(languages)))
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    y = np.array([languages.index(r['label']) for r in rows])
    held = np.arange(len(rows)) % 5 == 0

    def bags(some: np.ndarray) -> np.ndarray:
        m = np.zeros((len(some), BUCKETS), np.float32)
        for k, i in enumerate(some):
            if len(rows[i]['ids']):
                n = np.asarray(rows[i]['counts'], np.float32)
                m[k, rows[i]['ids']] = n / n.sum()
        return m

    embedding = rng.normal(0, 0.1, (BUCKETS, dimensions)).astype(np.float32)
    linear = rng.normal(0, 0.1, (dimensions, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    square = [np.full(a.shape, 1e-6, np.float32) for a in (embedding, linear, bias)]
    train = np.flatnonzero(~held)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
            m = bags(batch)
            mean = m @ embedding
            p = softmax(mean @ linear + bias)
            p[np.arange(len(batch)), y[batch]] -= 1
            p /= len(batch)
            gradients = (m.T @ (p @ linear.T), mean.T @ p, p.sum(0))
            for a, g, s in zip((embedding, linear, bias), gradients, square):  # steps scaled per weight
                s += g * g
                a -= rate * 0.2 * g / np.sqrt(s)
    model = Model(languages, embedding @ linear, bias.astype(float))
    apart = np.flatnonzero(held)
    z = np.vstack([bags(part) @ model.table for part in np.array_split(apart, max(1, len(apart) // 64))]) + bias
    losses = {t: -np.log(softmax(z / t)[np.arange(len(apart)), y[apart]] + 1e-12).mean() for t in np.geomspace(0.1, 10, 41)}
    model.temperature = float(min(losses, key=losses.get))
    p = softmax(z / model.temperature)
    score, right = p.max(1), p.argmax(1) == y[apart]
    order = np.argsort(-score)
    precise = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= precision
    model.reject_under = float(score[order][np.flatnonzero(precise)[-1]]) if precise.any() else 1.0
    return model


def predicted(text: Column, model: Model) -> Column:
    """struct<lang, score, rejected>."""
    def run(texts: pa.Array) -> pa.Array:
        found = [model.predict(t.as_py()) for t in texts]
        columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
        return pa.StructArray.from_arrays(columns, ['lang', 'score', 'rejected'])
    # marked so, the function is evaluated once whatever reads its result
    return F.arrow_udf(run, 'struct<lang: string, score: double, rejected: boolean>').asNondeterministic()(text)


def identify(docs: DataFrame, text: str = 'text', label: str = 'lang', key: str = 'doc_id', folds: int = 3,
             held_fold: int = 1, per_language: int = 600) -> DataFrame:
    """Adds held_out, lang_pred, score and rejected; columns of these names are replaced.

    Learns from rows with text and label whose crc32(key) modulo ``folds`` is not
    ``held_fold``; rows with a null key are not learned from.  A null text and one
    without a letter is ``und`` with score 0, and so is all where nothing can be
    learned; with one language that one is predicted with score 1.
    """
    docs = docs.drop('held_out', 'lang_pred', 'score', 'rejected')
    part = fold(key, folds)
    rows = gathered(sample(docs.where((part != held_fold) & (part >= 0)), text, label, key, per_language))  # bounded
    found, = free_name(docs, '_found')
    return (docs.withColumn(found, predicted(F.col(text), fit(rows)))
            .withColumns({'held_out': part == held_fold, 'lang_pred': F.col(found)['lang'],
                          'score': F.col(found)['score'], 'rejected': F.col(found)['rejected']}).drop(found))
