"""N-gram Jaccard join by multiple global orders, to groups of linked documents.

A document is its set of word n-grams (64-bit hashes); equal sets are one class.
Two sets with Jaccard similarity num / den or more share a token among the first
n - ceil(n * num / den) + 1 of each, under any one order of all tokens.  Three
orders are used, rare tokens first in all of them, with ties and near ties
shuffled differently: candidates meet under the first order and must also share
such a token under the others before the sets themselves are compared.  A parity
bitmap of each set, which differs in at most as many bits as the sets in tokens,
rules out further pairs.

Only tokens with a low hash come first in the orders, so that frequencies are
counted of a fixed share of the tokens; sets with too few of those go on with
their other tokens in order of the hash.

A token's classes first meet the one of them with the fewest tokens of its own.
Links join classes to components, and only classes of a token that are in another
component than that one meet the rest: groups of near copies never meet pair by
pair, yet no link between components is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import components, written

ORDERS = 3
BITS = 512


def shingles(text: str | None, k: int) -> np.ndarray:
    """Distinct hashes in rising order; A-Z lower-cased, words split at ASCII white space.

    With fewer than ``k`` words the whole sequence is one shingle; without words there is none.
    """
    words = (text or '').encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b' '.join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    total = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        total = (total ^ h[i:i + len(total)]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(32)
    return np.unique(total)


def must_share(n: Column, num: int, den: int) -> Column:
    """Length of the front part of an order that two similar sets share a token of."""
    return n - F.floor((n * num + (den - 1)) / den).cast('int') + 1


def parity(tokens: np.ndarray) -> np.ndarray:
    """Bitmap in which every token turns one bit over, as eight 64-bit numbers."""
    odd = np.bincount((tokens >> np.uint64(20) & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_match(n: Column, bits: Column, m: Column, other: Column, num: int, den: int) -> Column:
    """Length and bitmap filters."""
    apart = sum((F.bit_count(F.get(bits, F.lit(i)).bitwiseXOR(F.get(other, F.lit(i)))) for i in range(1, BITS // 64)),
                F.bit_count(F.get(bits, F.lit(0)).bitwiseXOR(F.get(other, F.lit(0)))))
    return (n * den >= m * num) & (m * den >= n * num) & ((n + m - apart) * (num + den) >= (n + m) * (2 * num))


def _profiles(docs: DataFrame, text: str, key: str, k: int, num: int, den: int) -> DataFrame:
    """(doc, n, sig, low, bits): set size, digest, the tokens that can come first in the orders, and the parity bitmap."""
    limit = np.uint64(min(2 ** 64 - 1, int(2 ** 64 * 1.6 * (den - num) / den)))

    def run(texts: pa.Array) -> pa.Array:
        sizes, marks, low, bits = [], [], [], []
        for t in texts:
            s = shingles(t.as_py(), k)
            n = len(s)
            sizes.append(n)
            marks.append(xxhash.xxh3_128_digest(s.tobytes()))
            bits.append(parity(s))
            low.append(s[:max(n - (n * num + den - 1) // den + 1, int(np.searchsorted(s, limit)))].view(np.int64) if n else s.view(np.int64))
        offsets = np.r_[0, np.cumsum([len(a) for a in low])].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*low, np.empty(0, np.int64)])))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.array(marks, pa.binary()), lists,
                                           pa.array(bits, pa.list_(pa.int64()))], ['n', 'sig', 'low', 'bits'])

    # marked so, the function is evaluated once whatever reads its result
    profile = F.arrow_udf(run, 'struct<n: int, sig: binary, low: array<bigint>, bits: array<bigint>>').asNondeterministic()
    return docs.select(F.col(key).alias('doc'), profile(F.col(text)).alias('s')).select('doc', 's.n', 's.sig', 's.low', 's.bits')


def _fronts(classes: DataFrame, num: int, den: int) -> DataFrame:
    """(cid, n, own, bits, front0, front1, front2) of the classes that have a front token which another class has."""
    tokens = classes.select('cid', F.explode('low').alias('token'))
    seen = tokens.groupBy('token').agg(F.count('*').alias('c')).where('c > 1')
    hits = tokens.join(seen, 'token').groupBy('cid').agg(F.collect_list(F.struct('c', 'token')).alias('hits'))
    rows = hits.join(classes.select('cid', 'n', 'bits', F.size('low').alias('n_low')), 'cid')
    own = F.col('n_low') - F.size('hits')  # tokens of no other class come first
    room = must_share(F.col('n'), num, den) - own
    rows = rows.where(room > 0)

    def order(seed: int):
        def place(h: Column) -> Column:
            rare = h['c'] if seed == 0 else F.floor(F.log2(h['c'])).cast('long')
            return F.struct(rare.alias('c'), F.xxhash64(F.lit(seed), h['token']).alias('o'), h['token'].alias('token'))
        ranked = F.sort_array(F.transform('hits', place))
        return F.transform(F.slice(ranked, F.lit(1), room), lambda r: r['token'])

    return rows.select('cid', 'n', own.alias('own'), 'bits', *[order(i).alias(f'front{i}') for i in range(ORDERS)])


def _links(pairs: DataFrame, fronts: DataFrame, classes: DataFrame, docs: DataFrame, text: str, key: str, k: int,
           num: int, den: int) -> DataFrame:
    """(a, b) of the pairs that pass the bitmaps and the other orders and are similar."""
    pairs = pairs.distinct()
    for side in 'ab':
        own = [F.col('n').alias(f'{side}n'), F.col('bits').alias(f'{side}bits'), *[F.col(f'front{i}').alias(f'{side}{i}') for i in range(1, ORDERS)]]
        pairs = pairs.join(fronts.select(F.col('cid').alias(side), *own), side)
    pairs = pairs.where(may_match(F.col('an'), F.col('abits'), F.col('bn'), F.col('bbits'), num, den))
    for i in range(1, ORDERS):
        pairs = pairs.where(F.arrays_overlap(f'a{i}', f'b{i}'))
    pairs = written(pairs.select('a', 'b'), 'pairs')
    wanted = pairs.select(F.col('a').alias('cid')).unionByName(pairs.select(F.col('b').alias('cid'))).distinct()
    wanted = wanted.join(classes.select('cid', 'rep', 'sig'), 'cid')

    def run(texts: pa.Array) -> pa.Array:
        sets = [shingles(t.as_py(), k) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
             pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ['sig', 'tokens'])

    whole = F.arrow_udf(run, 'struct<sig: binary, tokens: array<bigint>>').asNondeterministic()
    sets = (docs.select(F.col(key).alias('rep'), F.col(text).alias('text')).join(wanted, 'rep')
            .select('cid', 'sig', whole('text').alias('s')).where('sig = s.sig')
            .select('cid', 's.tokens').dropDuplicates(['cid']))
    sets = written(sets, 'sets')
    both = pairs.join(sets.toDF('a', 'x'), 'a').join(sets.toDF('b', 'y'), 'b')
    shared = F.size(F.array_intersect('x', 'y'))
    return both.where(shared * den >= (F.size('x') + F.size('y') - shared) * num).select('a', 'b')


def linked_classes(classes: DataFrame, docs: DataFrame, text: str, key: str, k: int, num: int, den: int) -> DataFrame:
    """(a, b): links between classes, enough of them for all components."""
    fronts = written(_fronts(classes, num, den), 'fronts')
    posts = fronts.select(F.explode('front0').alias('token'), 'cid', 'n', 'own')
    hubs = posts.groupBy('token').agg(F.min(F.struct('own', 'cid', 'n')).alias('hub'), F.count('*').alias('size')).where('size > 1')

    def lengths(n: Column, m: Column) -> Column:
        return (n * den >= m * num) & (m * den >= n * num)

    first = posts.join(hubs, 'token').where((F.col('cid') != F.col('hub.cid')) & lengths(F.col('n'), F.col('hub.n')))
    first = first.select(F.least('cid', 'hub.cid').alias('a'), F.greatest('cid', 'hub.cid').alias('b'))
    stars = written(_links(first, fronts, classes, docs, text, key, k, num, den), 'links')
    # written without bitmaps and fronts: in the plan of what reads it four times, all that is before it would be there four times
    label = written(components(stars).toDF('cid', 'label'), 'labels')
    of_hubs = hubs.where('size > 2').select('token', F.col('hub.cid').alias('hub')).join(label.toDF('hub', 'hub_label'), 'hub', 'left')
    mixed = posts.select('token', 'cid', 'n').join(of_hubs, 'token').join(label, 'cid', 'left')
    mixed = written(mixed.withColumns({'label': F.coalesce('label', 'cid'), 'hub_label': F.coalesce('hub_label', 'hub')}), 'mixed')
    own = fronts.select('cid', 'bits', 'front0')
    apart = mixed.where('label <> hub_label')
    strays = apart.join(own, 'cid').select(
        'token', *[F.col(c).alias(a) for c, a in (('cid', 'x'), ('n', 'xn'), ('label', 'xl'), ('bits', 'xbits'), ('front0', 'xfront'))])
    # only the tokens that have strays, and not the hub, which all have met
    rest = mixed.where('cid <> hub').join(apart.select('token').distinct(), 'token', 'left_semi').join(own, 'cid')
    rest = rest.select(F.col('token').alias('t'), 'cid', 'n', 'label', 'hub_label', 'bits', 'front0')
    # all in the join's condition: a pair that cannot be similar is no row, the others are one, at their first common token
    meet = ((F.col('token') == F.col('t')) & (F.col('xl') != F.col('label'))
            & ((F.col('label') == F.col('hub_label')) | (F.col('x') < F.col('cid')))  # two strays meet once
            & may_match(F.col('xn'), F.col('xbits'), F.col('n'), F.col('bits'), num, den)
            & (F.array_min(F.array_intersect('xfront', 'front0')) == F.col('token')))
    second = (strays.join(rest, meet)
              .select(F.least('x', 'cid').alias('a'), F.greatest('x', 'cid').alias('b')))
    return stars.unionByName(_links(second, fronts, classes, docs, text, key, k, num, den))


def link_documents(docs: DataFrame, text: str = 'text', key: str = 'doc_id', k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(key, n_shingles, component_id), one row per row of ``docs``.

    Documents link when den * shared >= num * union of their distinct ``k``-word
    shingles; component_id is the smallest key reachable by links, itself
    included.  Null and empty texts, and texts without words, have no shingle and
    no link.  Rows with a null key have a null component and link nothing; rows of
    the same key are one document that has all their links.  Other columns are
    not returned; an empty table gives no rows.
    """
    profiles = written(_profiles(docs, text, key, k, num, den), 'profiles')
    usable = profiles.where('n > 0 and doc is not null')
    classes = usable.groupBy('sig', 'n').agg(F.min(F.struct('doc', 'low', 'bits')).alias('f')).select(
        'sig', 'n', F.col('f.doc').alias('rep'), F.col('f.low').alias('low'), F.col('f.bits').alias('bits'))
    classes = written(classes.withColumn('cid', F.monotonically_increasing_id()), 'classes')
    links = linked_classes(classes, docs, text, key, k, num, den)
    name = classes.select('cid', 'rep')
    between = (links.join(name.toDF('a', 'x'), 'a').join(name.toDF('b', 'y'), 'b').select(F.col('x').alias('a'), F.col('y').alias('b')))
    members = usable.join(classes.select('sig', 'n', 'rep'), ['sig', 'n']).where('doc <> rep').select(
        F.col('doc').alias('a'), F.col('rep').alias('b'))
    groups = components(between.unionByName(members))
    return (profiles.select('doc', 'n').join(groups.withColumnRenamed('node', 'doc'), 'doc', 'left')
            .select(F.col('doc').alias(key), F.col('n').cast('long').alias('n_shingles'),
                    F.coalesce('component', 'doc').alias('component_id')))
