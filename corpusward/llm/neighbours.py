"""Largest inner products by vantage-point trees, one tree per shard of the vectors.

With one more component, sqrt(M^2 - |x|^2), all vectors of a shard have the same
length M, and the largest inner product is the smallest distance, so the triangle
inequality holds.  A side of a node is skipped if its nearest possible point is
farther than the k-th found: exactly so at ``factor`` one; a larger factor skips
more and may miss some.  A second walk takes every point that is as near as the
k-th found, so that ties are decided by exact products and ids.

A shard's rows and the query rows come to one task, shard first: the tree is
built where it is used, and query rows stream past it in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

LEAF = 64


def build(vectors: np.ndarray, ids: np.ndarray, keep: int) -> dict:
    """Tree over the different vectors; of equal ones the ``keep`` smallest ids, which no others can be nearer than."""
    order = np.lexsort((ids, *vectors.T[::-1]))
    vectors, ids = vectors[order], ids[order]
    new = np.r_[True, (vectors[1:] != vectors[:-1]).any(1)]
    first = np.flatnonzero(new)
    counts = np.diff(np.r_[first, len(ids)])
    place = np.arange(len(ids)) - np.repeat(first, counts)
    kept = place < keep
    group = (np.cumsum(new) - 1)[kept]
    points, norms = vectors[first], (vectors[first] ** 2).sum(1)
    top = norms.max()
    lifted = np.hstack([points, np.sqrt(np.maximum(top - norms, 0))[:, None]])
    rng, nodes, perm = np.random.default_rng(1), [], np.arange(len(points))
    work = [(0, len(points), -1, 0)]
    while work:
        start, end, parent, side = work.pop()
        if parent >= 0:
            nodes[parent][2 + side] = len(nodes)
        nodes.append([-1, 0.0, -1, -1, start, end])
        if end - start <= LEAF:
            continue
        part = perm[start:end]
        at = part[rng.integers(len(part))]
        d = np.sqrt(((lifted[part] - lifted[at]) ** 2).sum(1))
        middle = (end - start) // 2
        ranked = np.argsort(d, kind='stable')
        perm[start:end] = part[ranked]
        nodes[-1][:2] = [int(at), float(d[ranked[middle - 1]]), ]
        nodes[-1].append(float(d[ranked[middle]]))
        here = len(nodes) - 1
        work += [(start, start + middle, here, 0), (start + middle, end, here, 1)]
    # points in the order of the leaves, ids by point
    position = np.empty(len(perm), np.int64)
    position[perm] = np.arange(len(perm))
    by_point = np.argsort(position[group], kind='stable')
    id_list = ids[kept][by_point]
    id_start = np.r_[0, np.cumsum(np.bincount(position[group], minlength=len(perm)))]
    for node in nodes:
        if node[0] >= 0:
            node[0] = int(position[node[0]])
    return {'points': points[perm], 'lifted': lifted[perm], 'nodes': nodes, 'ids': id_list, 'start': id_start, 'top': float(top)}


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, component after component, so that equal vectors have equal products."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


class Walk:
    """Squared distances of lifted queries in a tree, and how far rounding may put them off."""

    def __init__(self, tree: dict, queries: np.ndarray):
        self.tree, self.lifted = tree, np.hstack([queries, np.zeros((len(queries), 1))])
        self.size = (queries ** 2).sum(1) + tree['top']
        self.rounding = 1e-15 * (queries.shape[1] + 4) * self.size

    def squared(self, q: np.ndarray, start: int, end: int) -> np.ndarray:
        return np.maximum(self.size[q, None] - 2 * self.lifted[q] @ self.tree['lifted'][start:end].T, 0)

    def sides(self, q: np.ndarray, node: list, last: np.ndarray, factor: float) -> Iterator[tuple[int, np.ndarray]]:
        """Children that a squared distance of ``last`` does not rule out."""
        vantage, inner, inside, outside, _, _, outer = node
        d = np.sqrt(self.squared(q, vantage, vantage + 1)[:, 0])
        most = np.sqrt(last[q] + self.rounding[q]) + 2 * np.sqrt(self.rounding[q])
        yield inside, q[factor * (d - inner) <= most]
        yield outside, q[factor * (outer - d) <= most]


def search(tree: dict, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """(points, squared distances) per query: indexes of k nearest points, -1 where there are fewer; of equally near ones any."""
    n, walk = len(queries), Walk(tree, queries)
    best, point = np.full((n, k), np.inf), np.full((n, k), -1, np.int64)
    last = np.full(n, np.inf)  # squared distance of the k-th found

    def scan(q: np.ndarray, start: int, end: int) -> None:
        if not len(q):
            return
        d = walk.squared(q, start, end)
        nearer = d.min(1) <= last[q]
        q, d = q[nearer], d[nearer]
        both = np.hstack([best[q], d])
        names = np.hstack([point[q], np.broadcast_to(np.arange(start, end), d.shape)])
        if both.shape[1] > k:
            chosen = np.argpartition(both, k - 1, axis=1)[:, :k]
            both, names = np.take_along_axis(both, chosen, 1), np.take_along_axis(names, chosen, 1)
        best[q], point[q], last[q] = both, names, both.max(1)

    # first the leaf a query falls into, for a k-th distance to start from
    home, work = np.full(n, -1), [(0, np.arange(n))]
    while work:
        at, q = work.pop()
        vantage, inner, inside, outside, start, end, *outer = tree['nodes'][at]
        if vantage < 0:
            home[q] = at
            scan(q, start, end)
        elif len(q):
            near = np.sqrt(walk.squared(q, vantage, vantage + 1)[:, 0]) <= (inner + outer[0]) / 2
            work += [(inside, q[near]), (outside, q[~near])]
    # then every side that the k-th distance does not rule out, all queries of a node together
    work = [(0, np.arange(n))]
    while work:
        at, q = work.pop()
        node = tree['nodes'][at]
        if node[0] < 0:
            scan(q[home[q] != at], node[4], node[5])
        elif len(q):
            work += walk.sides(q, node, last, factor)
    return point, best


def within(tree: dict, queries: np.ndarray, last: np.ndarray, factor: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, point) indexes of all points that may be as near as ``last`` (squared), leaf by leaf."""
    walk = Walk(tree, queries)
    work = [(0, np.arange(len(queries)))]
    while work:
        at, q = work.pop()
        node = tree['nodes'][at]
        if node[0] >= 0:
            work += walk.sides(q, node, last, factor) if len(q) else []
        elif len(q):
            row, column = np.nonzero(walk.squared(q, node[4], node[5]) <= (last[q] + 2 * walk.rounding[q])[:, None])
            yield q[row], column + node[4]


def nearest_rows(tree: dict, ids: np.ndarray, queries: np.ndarray, k: int, factor: float, held: int = 1 << 20) -> pd.DataFrame:
    """(query_id, q, vec_id, score): the k nearest rows of the tree for every query, ties to the smaller id."""
    # k + 1 different points hold the k nearest rows: the query's own point may hold nothing else
    _, best = search(tree, queries, k + 1, factor)
    kept, waiting, size = None, [], 0

    def cut(pairs: list) -> pd.DataFrame:
        row, at = (np.concatenate(c) for c in zip(*pairs))
        n = np.diff(tree['start'])[at]
        source = np.repeat(tree['start'][at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        found = pd.DataFrame({'query_id': np.repeat(ids[row], n), 'q': np.repeat(row, n), 'vec_id': tree['ids'][source],
                              'score': np.repeat(exact(queries[row], tree['points'][at]), n)})
        found = pd.concat([found[found['query_id'] != found['vec_id']], *([kept] if kept is not None else [])])
        found = found.sort_values(['q', 'score', 'vec_id'], ascending=[True, False, True])
        return found[found.groupby('q').cumcount() < k]

    for pair in within(tree, queries, best.max(1), factor):
        waiting.append(pair)
        size += len(pair[0])
        if size > held:  # any number of ties: of those seen only the k nearest stay
            kept, waiting, size = cut(waiting), [], 0
    return cut(waiting) if waiting else kept if kept is not None else pd.DataFrame({'query_id': [], 'q': [], 'vec_id': [], 'score': []})


def nearest(vectors: DataFrame, id_column: str, vector: str, every: int = 20, k: int = 20, factor: float = 1.0,
            shard_rows: int = 16384, block_rows: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` its k nearest other rows.

    Nearest is the largest inner product in double precision, ties to the smaller
    id.  Null ids, and vectors that are null, empty, zero or hold null or
    non-finite components, take no part.  Rows equal in id and vector count once;
    vectors meet those of their own length only.  An empty table gives no rows.
    """
    v = F.col('v')
    rows = vectors.select(F.col(id_column).cast('long').alias('id'), F.col(vector).cast('array<double>').alias('v'))
    rows = rows.where('id is not null and v is not null').where(
        ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)) & F.exists(v, lambda x: x != 0))
    rows = rows.withColumn('dim', F.size('v')).dropDuplicates(['id', 'v'])
    sizes = rows.groupBy('dim').agg(F.count('*').alias('n')).withColumn('shards', F.ceil(F.col('n') / shard_rows).cast('int'))
    dims = sizes.collect()  # one row per vector length
    if not dims:
        return rows.select(F.col('id').alias('query_id'), F.lit(0).alias('rank'), F.col('id').alias('vec_id'), F.lit(0.0).alias('score'))
    shards = F.create_map(*[F.lit(x) for r in dims for x in (r['dim'], r['shards'])])
    # rows of equal id and different vectors are different queries: told apart by their hash
    rows = rows.withColumn('q', F.xxhash64('id', 'v'))
    points = rows.select('dim', F.pmod('q', shards[F.col('dim')]).cast('int').alias('shard'), F.lit(False).alias('asked'), 'id', 'q', 'v')
    asked = rows.where(F.col('id') % every == 0).select('dim', F.explode(F.sequence(F.lit(0), shards[F.col('dim')] - 1)).alias('shard'),
                                                         F.lit(True).alias('asked'), 'id', 'q', 'v')

    def matrix(parts: list[pd.DataFrame]) -> np.ndarray:
        return np.array([v for part in parts for v in part['v']])

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, own, made = None, [], None
        for batch in batches:
            for (dim, shard, is_asked), part in batch.groupby(['dim', 'shard', 'asked'], sort=True):
                if (dim, shard) != place:
                    place, own, made = (dim, shard), [], None
                if not is_asked:
                    own.append(part)
                    continue
                if made is None and own:
                    made, own = build(matrix(own), np.concatenate([o['id'].to_numpy() for o in own]), k + 1), []
                for at in range(0, len(part) if made else 0, block_rows):
                    block = part.iloc[at:at + block_rows]
                    found = nearest_rows(made, block['id'].to_numpy(), matrix([block]), k, factor)
                    yield found.assign(q=block['q'].to_numpy()[found['q'].to_numpy(np.int64)])[['query_id', 'q', 'vec_id', 'score']]

    met = points.unionByName(asked).repartition(max(1, min(sum(r['shards'] for r in dims), 4096)), 'dim', 'shard').sortWithinPartitions('dim', 'shard', 'asked')
    found = met.mapInPandas(find, 'query_id long, q long, vec_id long, score double')
    ranked = found.withColumn('rank', F.row_number().over(Window.partitionBy('query_id', 'q').orderBy(F.desc('score'), 'vec_id')))
    return ranked.where(F.col('rank') <= k).select('query_id', 'rank', 'vec_id', 'score')
