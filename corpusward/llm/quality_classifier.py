"""Quality scores: random Fourier features over document statistics, ridge regression, isotonic calibration.

The statistics are DataFrame expressions.  Partitions of the labelled rows sum
their part of the normal equations; the driver adds a few matrices of fixed size
and solves.  Calibration pools at most 2001 score values into a rising step line.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, fold, free_name, written

#: Document statistics, in the order of the feature vector.
STATISTICS = ['log_words', 'word_length', 'distinct_words', 'symbols', 'marks', 'upper', 'digits', 'other_signs',
              'repeated_lines', 'log_lines', 'words_per_line', 'top_share']
FEATURES = 256
PARTS = 16


def statistics(text: Column) -> Column:
    """array<double> of a text; null is the empty text."""
    t = F.coalesce(text, F.lit(''))

    def count(pattern: str) -> Column:
        return F.length(t) - F.length(F.regexp_replace(t, pattern, ''))

    words = F.filter(F.split(t, SPACE), lambda w: w != '')
    lines = F.filter(F.split(t, '\n'), lambda x: x != '')
    return F.struct(
        F.size(words).alias('n'), F.size(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))).alias('distinct'),
        F.length(F.regexp_replace(t, SPACE, '')).alias('chars'), count('[#*$%&|<>]+').alias('symbols'),
        count('[!?]+').alias('marks'), count(r'\p{Lu}+').alias('upper'), count(r'\p{Nd}+').alias('digits'),
        count(r'''[^\p{L}\p{N}\s#*$%&|<>!?]+''').alias('signs'),
        F.size(lines).alias('lines'), F.size(F.array_distinct(lines)).alias('distinct_lines'))


def features(s: Column) -> Column:
    """The statistics as numbers of similar size."""
    n, chars, lines = (F.greatest(s[c], F.lit(1)) for c in ('n', 'chars', 'lines'))
    return F.array(*[c.cast('double') for c in (
        F.log1p(s['n']), s['chars'] / n, s['distinct'] / n, s['symbols'] / n, s['marks'] / n, s['upper'] / chars,
        s['digits'] / chars, s['signs'] / n, (s['lines'] - s['distinct_lines']) / lines, F.log1p(s['lines']),
        F.log1p(n / lines), s['symbols'] / chars)])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.lifted(x) @ self.weights, -0.5, 1.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.steps), 0, 1)


def isotonic(values: np.ndarray, weight: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (middle, share of ones) of each block, both rising."""
    blocks: list[list[float]] = []
    for v, w, s in zip(values, weight, ones):
        blocks.append([v * w, w, s])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] >= blocks[-1][2] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 1], (b[:, 2] + 0.5) / (b[:, 1] + 1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), len(STATISTICS))


def fit(table: DataFrame, rows: DataFrame, gamma: float = 1 / 24, ridge: float = 1e-3, seed: int = 5) -> Model | None:
    """Model from labelled rows (x array<double>, y 0 to 1, cal); those where ``cal`` holds fit the step line only.

    ``table`` has the x of all documents, for their means and spreads.

    None without a fitting row.  Without calibration rows the raw score stands.
    """
    d = len(STATISTICS)
    aggregates = [f(F.col('x')[i]) for i in range(d) for f in (F.avg, F.stddev_pop)]
    spread = np.array([v if v is not None else 0.0 for v in table.agg(*aggregates).first()]).reshape(d, 2)
    rng = np.random.default_rng(seed)
    model = Model(spread[:, 0], np.maximum(spread[:, 1], 1e-6), rng.normal(0, np.sqrt(2 * gamma), (d, FEATURES)),
                  rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), (np.array([0.0, 1.0]), np.array([0.0, 1.0])))

    def sums(batches):
        total, n = np.zeros((FEATURES + 1, FEATURES + 2)), 0
        for batch in batches:
            phi = model.lifted(_matrix(batch['x']))
            total += phi.T @ np.hstack([phi, batch['y'].to_numpy(float)[:, None]])
            n += len(batch)
        yield pd.DataFrame({'total': [total.tobytes()], 'n': [n]})

    rows = written(rows, 'labelled')
    # PARTS matrices of fixed size come to the driver, whatever the number of rows
    parts = rows.where('not cal').select('x', 'y').repartition(PARTS).mapInPandas(sums, 'total binary, n long').collect()
    n = sum(p['n'] for p in parts)
    if not n:
        return None
    total = sum(np.frombuffer(p['total']).reshape(FEATURES + 1, FEATURES + 2) for p in parts)
    penalty = np.eye(FEATURES + 1) * ridge * n
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(total[:, :-1] + penalty, total[:, -1])
    raw = _udf(model.raw)
    line = rows.where('cal').select(F.round(raw('x'), 3).alias('v'), 'y').groupBy('v').agg(
        F.count('*').alias('w'), F.sum('y').alias('s')).orderBy('v').toPandas()  # at most 2001 rows
    if len(line):
        model.steps = isotonic(*(line[c].to_numpy(float) for c in 'vws'))
    return model


def _udf(score):
    def run(x: pa.Array) -> pa.Array:
        flat = x.flatten().to_numpy(zero_copy_only=False)
        return pa.array(score(flat.reshape(len(x), len(STATISTICS))), pa.float64())
    return F.arrow_udf(run, 'double')


def score_quality(docs: DataFrame, labels: DataFrame, text: str = 'text', key: str = 'doc_id', folds: int = 5,
                  threshold: float = 0.3, keep_text: bool = True) -> DataFrame:
    """Adds ``held_out``, ``score`` (0 to 1) and ``predicted``; columns of these names are replaced.

    Labels are used of keys whose crc32 modulo ``folds`` is not 0: fold 1
    calibrates, the others fit.  A document with several labels counts with their
    mean; rows with null keys or qualities are not used.  Without labels every
    score is 0.5.  Null texts are empty texts and have a score like any other.
    The statistics are written once, beside the other columns (``keep_text=False``
    leaves the text out, there and in the result).
    """
    docs = docs.drop('held_out', 'score', 'predicted')
    x, mark = free_name(docs, 'x', '_mark')
    table = docs.withColumn(mark, statistics(F.col(text))).withColumn(x, features(F.col(mark))).drop(mark)
    table = written(table if keep_text else table.drop(text), 'statistics')
    marks = (labels.where('quality is not null').groupBy(F.col(key).alias('_key')).agg(F.avg('quality').alias('y'))
             .where((fold('_key', folds) > 0)))
    narrow = table.select(F.col(x).alias('x'), F.col(key).alias('_id'))
    rows = narrow.join(marks, F.col('_id') == F.col('_key')).select('x', 'y', (fold('_id', folds) == 1).alias('cal'))
    model = fit(narrow, rows)
    score = F.lit(0.5) if model is None else _udf(model.score)(F.col(x))
    return (table.withColumns({'held_out': fold(key, folds) == 0, 'score': score})
            .withColumn('predicted', (F.col('score') >= threshold).cast('int')).drop(x))
