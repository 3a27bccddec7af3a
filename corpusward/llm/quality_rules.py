"""Quality rules whose cut-offs carry a guarantee: few good documents are rejected, in every stratum.

Labelled good documents are the holdout.  For each stratum, measure and cut-off
of a fixed grid, the good documents beyond the cut-off are counted; the cut-off
is certified if so few would be seen with probability ``delta / tests`` at most
were the true share ``alpha / measures`` or more (exact binomial bound, corrected
for the number of tests; the shares of the measures add up to ``alpha``).  The
lowest certified cut-off is used, none where none is certified.

Main path: DataFrame expressions only.  The driver sees one row of counts per stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, free_name, written

WINDOW = 8
#: Cut-offs tried, per measure; a document beyond one is rejected.
GRID: dict[str, tuple[float, ...]] = {
    'symbols_per_word': (0.05, 0.1, 0.2, 0.3, 0.5, 0.8),
    'marks_per_word': (0.02, 0.05, 0.1, 0.2, 0.3, 0.5),
    'upper_share': (0.06, 0.1, 0.2, 0.3, 0.5, 0.7),
    'repeated_lines': (0.02, 0.05, 0.1, 0.2, 0.3, 0.5),
    'repeated_words': (0.02, 0.05, 0.1, 0.15, 0.2, 0.25),
    'long_words': (7.0, 8.0, 9.0, 10.0, 12.0, 15.0),
}


def without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, '')


def measured(docs: DataFrame, text: str = 'text') -> DataFrame:
    """Adds the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_marks, n_upper, n_lines (long).

    A null text has no words.  Columns of these names are replaced; all other
    columns stay.  Repeated windows of eight words are found by their 64-bit hash.
    """
    names = ['n_words', 'word_chars', 'n_symbols', 'n_dup_lines', 'n_repeat_words', 'n_marks', 'n_upper', 'n_lines']
    body, words, lines, windows, spots = free_name(docs, '_body', '_words', '_lines', '_windows', '_spots')
    t = F.col(body)
    step = docs.drop(*names).withColumn(body, F.coalesce(docs[text], F.lit('')))
    step = step.withColumns({
        words: F.transform(F.filter(F.split(t, SPACE), lambda w: w != ''), lambda w: F.xxhash64(w)),
        lines: F.filter(F.split(t, '\n'), lambda x: x.rlike(r'[^\x20\x09-\x0D]')),
        'word_chars': F.length(without(t, SPACE)).cast('long'),
        'n_symbols': (F.length(t) - F.length(without(t, '[#*$%&|<>]+'))).cast('long'),
        'n_marks': (F.length(t) - F.length(without(t, r'[!?]+'))).cast('long'),
        'n_upper': (F.length(t) - F.length(without(t, r'\p{Lu}+'))).cast('long')}).drop(body)
    n = F.size(words)
    step = step.withColumns({
        'n_words': n.cast('long'), 'n_lines': F.size(lines).cast('long'),
        'n_dup_lines': (F.size(lines) - F.size(F.array_distinct(lines))).cast('long'),
        windows: F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(
            F.slice(F.col(words), i, WINDOW)))).otherwise(F.array().cast('array<bigint>'))}).drop(lines, words)
    # the few texts with repeats: windows in order of hash, then the places of those that have an equal neighbour
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    step = step.withColumn(spots, F.when(repeats, F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias('h'), i.alias('i'))))))
    step = step.drop(windows)
    same = F.filter(F.col(spots), lambda s, k: ((k > 0) & (F.get(F.col(spots), k - 1)['h'] == s['h']))
                    | F.coalesce(F.get(F.col(spots), k + 1)['h'] == s['h'], F.lit(False)))
    places = F.sort_array(F.transform(same, lambda s: s['i']))
    covered = F.aggregate(
        places, F.struct(F.lit(0).alias('n'), F.lit(0).alias('upto')),
        lambda a, p: F.struct((a['n'] + p + WINDOW - F.greatest(p, a['upto'])).alias('n'), (p + WINDOW).alias('upto')),
        lambda a: a['n'])
    return step.withColumn('n_repeat_words', F.coalesce(F.when(F.col(spots).isNotNull(), covered), F.lit(0)).cast('long')).drop(spots)


def measures() -> dict[str, Column]:
    """What the rules look at, from the counts; higher is worse, and 0 without words."""
    def per(n: Column, of: str) -> Column:
        return F.when(F.col(of) > 0, n / F.col(of)).otherwise(F.lit(0.0)).cast('double')
    return {
        'symbols_per_word': per(F.col('n_symbols'), 'n_words'),
        'marks_per_word': per(F.col('n_marks'), 'n_words'),
        'upper_share': per(F.col('n_upper'), 'word_chars'),
        'repeated_lines': per(F.col('n_dup_lines'), 'n_lines'),
        'repeated_words': per(F.col('n_repeat_words'), 'n_words'),
        'long_words': per(F.col('word_chars'), 'n_words'),
    }


def base_failed() -> Column:
    return (F.col('n_words') < 20) | (100 * F.col('n_repeat_words') > 30 * F.col('n_words'))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(at most k of n) at share p: all terms from the k-th down to those too small to change the sum."""
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0
    first = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    # each term over the one before; the sum in parts of the k-th term, which itself may be too small for a float
    term, total, i = 1.0, 1.0, k
    while i > 0 and total < 1e250:
        ratio = i * (1 - p) / ((n - i + 1) * p)
        term *= ratio
        total += term
        i -= 1
        if ratio < 1 and term < 1e-18 * total:
            break
    return min(1.0, math.exp(min(0.0, first + math.log(total))))


def certified(n: int, beyond: dict[str, list[int]], tests: int, alpha: float, delta: float) -> dict[str, float]:
    """Lowest certified cut-off per measure, of a stratum with ``n`` good documents."""
    share, found = alpha / len(GRID), {}
    for name, counts in beyond.items():
        for cutoff, k in zip(GRID[name], counts):
            # more than the share itself can't be certified: no need for the sum
            if n and k < share * n and binomial_tail(k, n, share) <= delta / tests:
                found[name] = cutoff
                break
    return found


def cutoffs(good: DataFrame, stratum: str, alpha: float = 0.05, delta: float = 0.05) -> list[dict]:
    """Certified cut-offs per stratum, from counts of the good documents (rows of ``measured``)."""
    values = measures()
    sums = [F.count_if(values[name] > c).alias(f'{name}_{j}') for name, grid in GRID.items() for j, c in enumerate(grid)]
    rows = good.where(~base_failed()).groupBy(stratum).agg(F.count('*').alias('_n'), *sums).collect()  # a row per stratum
    tests = max(1, len(rows)) * sum(map(len, GRID.values()))
    return [{'stratum': r[stratum]} | certified(
        r['_n'], {name: [r[f'{name}_{j}'] for j in range(len(grid))] for name, grid in GRID.items()}, tests, alpha, delta)
        for r in rows]


def judge(docs: DataFrame, labels: DataFrame, text: str = 'text', key: str = 'doc_id', stratum: str = 'lang',
          alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Counts of every document with base_failed, reasons (measures beyond their cut-off) and kept.

    ``labels`` has the key and ``quality``; rows with a null key or quality are
    not used, and a document labelled both ways counts as good once.  Documents
    whose stratum has no certified cut-off are judged by the base rule alone; a
    null stratum is a stratum.  Empty tables give empty results.
    """
    own = docs.select(F.col(key), F.col(stratum).alias('stratum'), F.col(text))
    table = written(measured(own, text).drop(text), 'measures')
    marked = labels.where('quality = 1').select(F.col(key).alias('_key')).where('_key is not null').distinct()
    found = cutoffs(table.join(marked, F.col(key) == F.col('_key'), 'left_semi'), 'stratum', alpha, delta)
    schema = '_stratum string, ' + ', '.join(f'{name} double' for name in GRID)
    limits = docs.sparkSession.createDataFrame([(f['stratum'], *(f.get(name) for name in GRID)) for f in found], schema)
    limits = limits.withColumnsRenamed({name: f'_{name}' for name in GRID})
    joined = table.join(F.broadcast(limits), F.col('stratum').eqNullSafe(F.col('_stratum')), 'left').drop('_stratum')  # a row per stratum
    reasons = F.array_compact(F.array(*[F.when(value > F.col(f'_{name}'), F.lit(name)) for name, value in measures().items()]))
    return (joined.withColumns({'base_failed': base_failed(), 'reasons': reasons})
            .withColumn('kept', ~F.col('base_failed') & (F.size('reasons') == 0)).drop(*[f'_{name}' for name in GRID]))
