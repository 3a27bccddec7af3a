"""Line de-duplication by an exact set-similarity join.

A line is the set of its words; it goes if an earlier line (order: document, then
place) has a Jaccard similarity of at least ``num / den`` with it.  Equal lines
meet by hash.  The other lines' words are ordered by rarity (counts per hash
bucket, so the order is a table of fixed size) and only the rarest few that a
similar line must share one of are joined, with filters on length, on the place
of the shared word and on a parity bitmap.  What remains is compared word by word.

A word's lines first meet the earliest of them and the few before them; a line
found to repeat one is settled, and of words with many lines only the unsettled
ones meet all earlier lines.  So groups of near copies never meet pair by pair.

DataFrame expressions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import discard, free_name, written

BUCKETS = 1 << 15
GROUP = 200_000  # lines of a word that one task may take; more are dealt to several groups
NEAR = 7  # lines before it in the order that a line meets at once
LONG = 80  # words from which a line has a second bitmap: one of 64 bits no longer tells two such lines apart


def line_rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(doc, line_no, line, a, b) of the lines with a word; a and b are hashes of the line."""
    rows = docs.select(F.col(key).alias('doc'), F.posexplode(F.split(F.col(text), '\n')).alias('line_no', 'line'))
    return rows.where(F.col('line').rlike(r'[^\x20\x09-\x0D]')).withColumns(
        {'a': F.xxhash64('line'), 'b': F.xxhash64(F.lit(1), 'line')})


def words(line: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(_blanks(line), ' ')), '')


def tokens(line: Column) -> Column:
    """64-bit hashes of the different words."""
    hashes = F.array_distinct(F.transform(F.split(_blanks(line), ' '), lambda w: F.xxhash64(w)))
    return F.filter(hashes, lambda t: t != F.xxhash64(F.lit('')))


def _blanks(line: Column) -> Column:
    """The other white-space characters as blanks; splitting at one character needs no expression."""
    return F.when(line.rlike(r'[\x09-\x0D]'), F.translate(line, '\t\n\x0b\x0c\r', '     ')).otherwise(line)


def at_least(part: Column, whole: Column, num: int, den: int) -> Column:
    return part * den >= whole * num


def _could_match(n, i, bits, m, j, other_bits, num: int, den: int) -> Column:
    """Length, place and bitmap filters for two lines whose first shared word is at places i and j (from 0) of their orders.

    Similar lines pass at their first shared word, if not at later ones, so a pair need not meet at each word it shares.
    Lines whose lengths are too different do not pass even at their first places.
    """
    return ((F.least(n - i, m - j) * (num + den) >= (n + m) * num)
            & _bits_allow(n, m, F.bit_count(bits.bitwiseXOR(other_bits)), num, den))


def _bits_allow(n: Column, m: Column, apart: Column, num: int, den: int) -> Column:
    """Sets differ in at least as many words as their parity bitmaps in bits."""
    return (n + m - apart) * (num + den) >= (n + m) * (2 * num)


def parity(hashes: Column, shift: int) -> Column:
    """Bitmap of 64 bits in which every word turns one over."""
    return F.aggregate(hashes, F.lit(0).cast('long'), lambda acc, t: acc.bitwiseXOR(F.call_function(
        'shiftleft', F.lit(1).cast('long'), (F.shiftright(t, shift).bitwiseAND(F.lit(63))).cast('int'))))


def distinct_lines(rows: DataFrame) -> DataFrame:
    """Different lines with a number in the order of their first places: (sid, a, b, first, line)."""
    first = rows.groupBy('a', 'b').agg(F.min(F.struct('doc', 'line_no')).alias('first'))
    numbered = written(first.orderBy('first').withColumn('sid', F.monotonically_increasing_id()), 'numbers')
    # the text is moved once, after the numbers are given; equal lines are put together on the way
    texts = rows.groupBy('a', 'b').agg(F.first('line').alias('line'))
    lines = written(numbered.join(texts, ['a', 'b']), 'lines')
    discard(numbered)
    return lines


def postings(sets: DataFrame, num: int, den: int, min_words: int) -> DataFrame:
    """(token, salt, split, sid, n, i, bits, half): the rarest words of each line that a similar line must share one of.

    ``half`` is the bitmap of half the words of a long line, else null; with ``bits`` it gives that of the other half.
    A token is its count, up to 32767, before 48 bits of its hash, so its order is that of the numbers.
    """
    counted = sets.select(F.explode(F.split(_blanks(F.col('line')), ' ')).alias('w'))
    counts = dict(counted.groupBy(F.pmod(F.xxhash64('w'), F.lit(BUCKETS)).alias('k')).count().collect())  # BUCKETS rows
    table = F.split(F.lit(','.join(str(min(counts.get(k, 0), 2_000_000_000)) for k in range(BUCKETS))), ',').cast('array<int>')
    rows = sets.select('sid', tokens(F.col('line')).alias('tokens'))
    if min_words > 1:  # every line has a word; a condition would take the words of each line a second time
        rows = rows.where(F.size('tokens') >= min_words)
    half = F.when(F.size('tokens') > LONG, parity(F.filter('tokens', lambda t: F.shiftright(t, 26).bitwiseAND(F.lit(1)) == 1), 20))
    rows = rows.select('sid', F.size('tokens').alias('n'), parity(F.col('tokens'), 20).alias('bits'), half.alias('half'), F.sort_array(F.transform(
        'tokens', lambda t: F.shiftleft(F.least(F.get(table, F.pmod(t, F.lit(BUCKETS)).cast('int')), F.lit(32767)).cast('long'), 48)
        .bitwiseOR(t.bitwiseAND(F.lit(0xFFFFFFFFFFFF))))).alias('ranked'))
    must = F.floor((F.col('n') * num + (den - 1)) / den).cast('int')  # shared words at least, were the other line as long
    rows = rows.select('sid', 'n', 'bits', 'half', F.posexplode(F.slice('ranked', F.lit(1), F.col('n') - must + 1)).alias('i', 'token'))
    # a token of the highest count may be any hot one: dealt to so many groups that none is large
    most = max([0, *counts.values()])
    salts = F.when(F.shiftright('token', 48) == 32767, F.lit(most // GROUP + 1)).otherwise(F.lit(1))
    salt = F.pmod('sid', salts).cast('int')
    # dealt out in few columns; the others come from them afterwards
    place = F.shiftleft(F.col('n').cast('long'), 32).bitwiseOR(F.col('i').cast('long'))
    rows = rows.select('token', 'bits', 'sid', place.alias('place'), 'half').repartition('token', salt)
    return rows.select('token', salt.alias('salt'), (salts > 1).alias('split'), 'sid', F.shiftright('place', 32).cast('int').alias('n'),
                       F.col('place').bitwiseAND(F.lit(0x7FFFFFFF)).cast('int').alias('i'), 'bits', 'half')


def _part(hashes: str, k: int) -> Column:
    """The hashes of the k-th of eight bitmaps."""
    return F.filter(hashes, lambda t: F.shiftright(t, 26).bitwiseAND(F.lit(7)) == k)


def similar(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """sid of the pairs (sid, other) whose lines are similar, as a table; what it takes on the way is removed."""
    pairs = written(pairs.select('sid', 'other').distinct(), 'pairs')
    wanted = pairs.select('sid').unionByName(pairs.select(F.col('other').alias('sid'))).distinct()
    hashes = tokens(F.col('line'))
    lines = written(sets.join(wanted, 'sid', 'left_semi').select('sid', 'line', hashes.alias('h')).select(
        'sid', 'line', F.size('h').alias('n'), *[parity(_part('h', k), 20).alias(f'b{k}') for k in range(8)]), 'compared')
    # bitmaps of 512 bits first: they are small beside the lines
    maps = lines.drop('line')
    narrow = pairs.join(maps, 'sid').join(maps.withColumnsRenamed({c: f'o_{c}' for c in maps.columns}), F.col('other') == F.col('o_sid'))
    apart = sum((F.bit_count(F.col(f'b{k}').bitwiseXOR(F.col(f'o_b{k}'))) for k in range(1, 8)), F.bit_count(F.col('b0').bitwiseXOR(F.col('o_b0'))))
    narrow = narrow.where(_bits_allow(F.col('n'), F.col('o_n'), apart, num, den)).select('sid', 'other')
    texts = lines.select('sid', 'line')
    both = narrow.join(texts, 'sid').join(texts.withColumnsRenamed({'sid': 'other', 'line': 'other_line'}), 'other')
    # rows of a generator, else the condition would be evaluated on the lines, and take the words again wherever it names them
    both = both.select('sid', F.inline(F.array(F.struct(words(F.col('line')).alias('w'), words(F.col('other_line')).alias('v')))))
    shared = F.size(F.array_intersect('w', 'v'))
    found = both.where(shared * (num + den) >= (F.size('w') + F.size('v')) * num).select('sid').distinct()
    found = written(found, 'similar')
    discard(pairs, lines)
    return found


def near_repeats(sets: DataFrame, num: int, den: int, min_words: int) -> DataFrame:
    """sid of the different lines that an earlier different line is similar to."""
    # one order for all of them, so the postings are sorted once
    order = Window.partitionBy('token', 'salt').orderBy('sid')
    group = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = postings(sets, num, den, min_words).withColumns({
        'size': F.count('*').over(group), 'first': F.first(F.struct('sid', 'n', 'i', 'bits')).over(group),
        **{f'{c}{k}': F.lag(c, k, none).over(order) for k in range(1, NEAR + 1) for c, none in (('sid', None), ('n', 0), ('i', 0), ('bits', 0))}})

    # numbers, none of them null: the code for all places has to stay so short that the JVM compiles it
    def fits(n: Column, i: Column, bits: Column) -> Column:
        return _could_match(*(F.col(c) for c in ('n', 'i', 'bits')), n, i, bits, num, den)

    hub = (F.col('size') > NEAR + 1) & (F.col('first.sid') < F.col('sid')) & fits(*(F.col(f'first.{c}') for c in ('n', 'i', 'bits')))
    near = {f'sid{k}': fits(*(F.col(f'{c}{k}') for c in ('n', 'i', 'bits'))) for k in range(1, NEAR + 1)} | {'first.sid': hub}
    any_fits = reduce(Column.__or__, near.values())
    large = (F.col('size') > NEAR + 1) | F.col('split')
    # most lines meet none: theirs is an empty array without looking for others
    others = F.when(any_fits, F.array_except(F.array(*[F.when(fit, F.col(sid)) for sid, fit in near.items()]), F.array(F.lit(None).cast('long'))))
    others = F.coalesce(others, F.array().cast('array<bigint>'))
    met = met.where((F.col('size') > 1) | F.col('split')).where(any_fits | large).withColumns({'others': others, 'large': large})
    met = written(met.select('token', 'sid', 'n', 'i', 'bits', 'half', 'others', 'large'), 'postings')
    settled = similar(met.select('sid', F.explode('others').alias('other')), sets, num, den)
    # groups of a few have all met; in large ones, unsettled lines meet all earlier lines of the word
    own = ['sid', 'n', 'i', 'bits', 'half', 'others', 'settled']
    large = met.where('large').join(settled.withColumn('settled', F.lit(True)), 'sid', 'left').withColumn('settled', F.col('settled').isNotNull())
    left = large.select('token', *own)
    # of two similar lines the shorter one has their first common word among its first few
    first_few = (F.col('n') - F.col('i')) * (num + den) >= F.col('n') * (2 * num)
    right = large.where(first_few).select('token', *(F.col(c).alias(f'o_{c}') for c in own))
    one = F.col('half').bitwiseXOR(F.col('o_half'))
    apart = F.bit_count(one) + F.bit_count(one.bitwiseXOR(F.col('bits')).bitwiseXOR(F.col('o_bits')))
    later, longer = F.col('sid') > F.col('o_sid'), F.col('n') > F.col('o_n')
    pairs = left.join(right, (left['token'] == right['token']) & (longer | ((F.col('n') == F.col('o_n')) & later))
                      & ~F.when(later, F.col('settled')).otherwise(F.col('o_settled'))
                      & _could_match(*(F.col(c) for c in ('n', 'i', 'bits', 'o_n', 'o_i', 'o_bits')), num, den)
                      & F.coalesce(_bits_allow(F.col('n'), F.col('o_n'), apart, num, den), F.lit(True))
                      & ~F.when(later, F.array_contains('others', F.col('o_sid'))).otherwise(F.array_contains('o_others', F.col('sid'))))
    pairs = pairs.select(F.greatest('sid', 'o_sid').alias('sid'), F.least('sid', 'o_sid').alias('other'))
    more = similar(pairs, sets, num, den)
    discard(met)
    return settled.unionByName(more).distinct()


def dedup_lines(docs: DataFrame, text: str = 'text', key: str = 'doc_id', num: int = 4, den: int = 5, min_words: int = 1) -> DataFrame:
    """The documents without repeated lines, and n_lines, n_removed and removed (line numbers from 0, array<int>).

    A line goes if it has at least ``min_words`` different words and an earlier
    line has Jaccard similarity ``num / den`` or more on sets of words, whether
    that one stays or not; lines without so many words always stay.  Documents are
    ordered by key, null first; rows with the same key count as one document, of
    which equal lines at the same place are all first.  Null and empty texts stay as they are; a
    text that loses all lines becomes empty.  Columns n_lines, n_removed and
    removed of the input are replaced, all others stay; an empty table stays empty.
    """
    docs = docs.drop('n_lines', 'n_removed', 'removed')
    rows = line_rows(docs, text, key)
    sets = distinct_lines(rows)
    # every line has a word
    enough = F.size(words(F.col('line'))) >= min_words if min_words > 1 else F.lit(True)
    sets_of = sets.join(near_repeats(sets, num, den, min_words).withColumn('near', F.lit(True)), 'sid', 'left').where(enough)
    flags = sets_of.select('a', 'b', 'first', F.coalesce('near', F.lit(False)).alias('near'))
    places = rows.select('a', 'b', F.struct('doc', 'line_no').alias('at')).join(flags, ['a', 'b'])
    gone = (places.where(F.col('near') | ~F.col('at').eqNullSafe(F.col('first')))
            .groupBy('at.doc').agg(F.sort_array(F.collect_set('at.line_no')).alias('_removed')))
    lines, kept, doc = free_name(docs, '_lines', '_kept', '_doc')
    joined = docs.join(gone.withColumnRenamed('doc', doc), F.col(key).eqNullSafe(F.col(doc)), 'left').drop(doc)
    removed = F.coalesce('_removed', F.array().cast('array<int>'))
    joined = joined.withColumn('removed', removed).drop('_removed').withColumns({
        lines: F.split(F.col(text), '\n'), 'n_removed': F.size('removed').cast('long')})
    joined = joined.withColumn('n_lines', F.coalesce(F.size(F.filter(lines, lambda x: x != '')), F.lit(0)).cast('long'))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col('removed'))
    left = F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), '\n')
    return joined.withColumn(text, F.when(F.col('n_removed') > 0, left).otherwise(F.col(text))).drop(lines).select(
        *docs.columns, 'n_lines', 'n_removed', 'removed')
