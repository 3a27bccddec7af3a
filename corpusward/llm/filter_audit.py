"""What every order of a set of filters keeps, removes and hides, per part of the corpus.

A document is reduced to the letters of the filters it fails, and the corpus to
cells: counts per part and set of letters (at most 32 a part).  Each cell is
folded across all orders at once by array functions, and the folds of a part are
added up place by place.  The number of cells does not grow with the documents.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, written

LETTERS = 'ABCDE'
ORDERS = [''.join(p) for p in permutations(LETTERS)]
COUNTS = ('kept', 'removed', 'redundant', 'unique_fails', 'good_lost', 'toxic_lost')


def text_failures(text: Column) -> Column:
    """Letters of the text filters a text fails, in order.

    A: under 100 words; B: less than 80 % of the words are different; C: more
    than 10 % of the code points are A-Z; D: a character of ``#$%&*|``.
    """
    words = F.filter(F.split(text, SPACE), lambda w: w != '')
    found = F.transform(F.array(words), lambda w: F.concat(
        F.when(F.size(w) < 100, F.lit('A')).otherwise(F.lit('')),
        F.when(100 * F.size(F.array_distinct(w)) < 80 * F.size(w), F.lit('B')).otherwise(F.lit(''))))[0]
    capitals = F.length(text) - F.length(F.regexp_replace(text, '[A-Z]+', ''))
    return F.concat(found, F.when(100 * capitals > 10 * F.length(text), F.lit('C')).otherwise(F.lit('')),
                    F.when(F.rlike(text, F.lit('[#$%&*|]')), F.lit('D')).otherwise(F.lit('')))


def failures(docs: DataFrame, key: str = 'doc_id', text: str = 'text', part: str = 'lang') -> DataFrame:
    """(doc_id, part, failed) per row of ``docs``; failed holds the letters of its filters, in order.

    E fails for a text that a row with a smaller key has too.  A null text is
    empty, a null part is the empty string.  A null key is neither smaller nor
    larger than another; rows with equal keys are no copies of each other.
    """
    body = F.coalesce(F.col(text), F.lit(''))
    narrow = written(docs.select(F.col(key).alias('doc_id'), F.coalesce(F.col(part).cast('string'), F.lit('')).alias('part'),
                                 F.unhex(F.sha2(body, 256)).alias('digest'), text_failures(body).alias('failed')), 'failures')
    # the smallest key of every text: joined on key and text, so that many copies of a text are no hot key
    first = narrow.where('doc_id is not null').groupBy('digest').agg(F.min('doc_id').alias('doc_id')).withColumn('_first', F.lit(True))
    copies = F.when(F.col('_first').isNull() & F.col('doc_id').isNotNull(), F.lit('E')).otherwise(F.lit(''))
    return narrow.join(first, ['doc_id', 'digest'], 'left').select('doc_id', 'part', F.concat('failed', copies).alias('failed'))


def cells(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, n, good, toxic): documents, those of label quality 1 and of label toxic 1.

    Labels with a null key belong to no document; of several labels of one
    document, one that says 1 is enough.
    """
    marked = labels.where('doc_id is not null').groupBy('doc_id').agg(
        F.max((F.col('quality') == 1).cast('long')).alias('good'), F.max((F.col('toxic') == 1).cast('long')).alias('toxic'))
    return failed.join(marked, 'doc_id', 'left').groupBy('part', 'failed').agg(
        F.count('*').alias('n'), F.coalesce(F.sum('good'), F.lit(0)).alias('good'), F.coalesce(F.sum('toxic'), F.lit(0)).alias('toxic'))


def audited(counts: DataFrame) -> DataFrame:
    """One row per part, order and step from the cells.

    Columns: part, filter_order, step (from 1), kept (after the step), removed
    (by it), redundant (failing its filter, removed before), unique_fails
    (failing its filter alone), good_lost, toxic_lost (labelled and removed by
    it), shapley (removed by its filter, over all orders).  No cells, no rows.
    """
    kind = 'array<struct<' + ', '.join(f'{name}: bigint' for name in COUNTS) + '>>'
    orders = F.lit(ORDERS)
    failed, none = F.col('failed'), F.lit(0).cast('long')

    def step(state: Column, order: Column, at: Column) -> Column:
        letter = F.substring(order, at, F.lit(1))
        fails, alive = F.contains(failed, letter), state['alive']
        weight = {'kept': (alive & ~fails, 'n'), 'removed': (alive & fails, 'n'), 'redundant': (~alive & fails, 'n'),
                  'unique_fails': (failed == letter, 'n'), 'good_lost': (alive & fails, 'good'), 'toxic_lost': (alive & fails, 'toxic')}
        done = F.struct(*[F.when(holds, F.col(of)).otherwise(none).alias(name) for name, (holds, of) in weight.items()])
        return F.struct((alive & ~fails).alias('alive'), F.concat(state['done'], F.array(done)).alias('done'))

    def walk(order: Column) -> Column:
        start = F.struct(F.lit(True).alias('alive'), F.array().cast(kind).alias('done'))
        return F.aggregate(F.sequence(F.lit(1), F.lit(len(LETTERS))), start, lambda s, at: step(s, order, at), lambda s: s['done'])

    def add(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: F.struct(*[(x[c] + y[c]).alias(c) for c in COUNTS]))

    zeros = F.array_repeat(F.struct(*[none.alias(c) for c in COUNTS]), len(ORDERS) * len(LETTERS))
    folded = counts.select('part', F.flatten(F.transform(orders, walk)).alias('steps'))
    merged = folded.groupBy('part').agg(F.collect_list('steps').alias('all')).select('part', F.aggregate('all', zeros, add).alias('steps'))
    letters = F.lit([letter for order in ORDERS for letter in order])
    shares = F.transform(F.lit(list(LETTERS)), lambda one: F.aggregate(
        F.zip_with('steps', letters, lambda s, letter: F.when(letter == one, s['removed']).otherwise(none)), none, lambda a, b: a + b))
    rows = merged.withColumn('shares', shares).select('part', 'shares', F.posexplode('steps'))
    order = F.get(orders, F.floor(F.col('pos') / len(LETTERS)).cast('int'))
    number = F.col('pos') % len(LETTERS) + 1
    rows = rows.withColumns({'filter_order': order, 'step': number.cast('int')})
    letter = F.substring(F.col('filter_order'), F.col('step'), F.lit(1))
    return rows.select('part', 'filter_order', 'step', *[f'col.{c}' for c in COUNTS],
                       F.get('shares', F.instr(F.lit(LETTERS), letter) - 1).alias('shapley'))


def audit(docs: DataFrame, labels: DataFrame, key: str = 'doc_id', text: str = 'text', part: str = 'lang') -> DataFrame:
    """``audited`` over the documents; columns of ``docs`` beyond the three named are not looked at."""
    return audited(cells(failures(docs, key, text, part), labels))
