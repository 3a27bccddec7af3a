"""Product codes of vectors, with codebooks learned by integer k-means and assigned by pivots.

Components are integers and every vector is cut into equal parts.  The distances
of each part to a few fixed points (pivots) are computed once and stored.  In a
round, the distances between pivots and codebook entries bound every distance
between a part and an entry from below (triangle inequality).  Entries are tried
in order of their bound, by their exact integer distance, until the bound of the
next one is beyond the best found; so most distances are never computed, and the
result is the exact nearest entry.

A round is one pass over the stored table.  Only sums per entry and component
leave it, added up by Spark before they reach the driver: their number depends on
the codebooks alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import written

SCALE, PARTS, ENTRIES, ROUNDS, PIVOTS = 4096, 8, 16, 6, 4
#: Integers beyond this have no use as long sums; see ``integers``.
LARGEST = 2 ** 60


def integers(vector: Column) -> Column:
    """floor(4096 * x) of every component; null for a vector that takes no part.

    That is a null vector, one with a null or non-finite component, and one with
    a component whose integer is beyond 2**60.
    """
    def usable(x: Column) -> Column:
        value = x.cast('double') * SCALE
        return x.isNotNull() & ~F.isnan(value) & (F.abs(value) < float(LARGEST))
    whole = F.transform(vector, lambda x: F.floor(x.cast('double') * SCALE).cast('long'))
    return F.when(F.coalesce(F.forall(vector, usable), F.lit(False)), whole)


def bounds(width: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """Consecutive parts; equal ones if the width allows."""
    return [(i * width // parts, (i + 1) * width // parts) for i in range(parts)]


def far_apart(entries: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Up to ``n`` of the entries as pivots: the first, then each time the one farthest from those chosen."""
    points = entries.astype(float)
    chosen = [0] if len(points) else []
    while 0 < len(chosen) < min(n, len(points)):
        near = np.min([((points - points[c]) ** 2).sum(1) for c in chosen], axis=0)
        if not near.max():
            break
        chosen.append(int(near.argmax()))
    return entries[chosen]


def distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Rounded Euclidean distances, points x others."""
    return np.sqrt(((points.astype(float)[:, None, :] - others.astype(float)[None, :, :]) ** 2).sum(2))


def exact_kind(*arrays: np.ndarray) -> type:
    """int64 where no squared distance can overflow it, Python's integers elsewhere."""
    most = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    width = max((a.shape[-1] for a in arrays), default=0)
    return np.int64 if 4 * most * most * max(1, width) < 2 ** 62 else object


def assign(values: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of the nearest entry, squared distance, number of distances computed) of every row; ties to the lower index."""
    n, kind = len(values), exact_kind(values, entries)
    values, entries = values.astype(kind), entries.astype(kind)
    between = distances(pivots, entries)
    bound = np.zeros((n, len(entries)))
    for at in range(len(pivots)):
        own = to_pivots[:, at, None].astype(float)
        # stored distances are single precision: the bound gives way by more than their rounding
        np.maximum(bound, np.abs(own - between[at]) - 1e-6 * (own + between[at]) - 1e-6, out=bound)
    order = np.argsort(bound, axis=1, kind='stable')
    rows, tried = np.arange(n), 0
    index, best = np.zeros(n, np.int64), np.zeros(n, kind)
    for place in range(len(entries)):
        entry = order[rows, place]
        if place:
            near = bound[rows, entry] ** 2 <= best[rows].astype(float) * (1 + 1e-9)
            rows, entry = rows[near], entry[near]
        if not len(rows):
            break
        found = ((values[rows] - entries[entry]) ** 2).sum(1) if values.shape[1] else np.zeros(len(rows), kind)
        tried += len(rows)
        better = np.ones(len(rows), bool) if not place else (found < best[rows]) | ((found == best[rows]) & (entry < index[rows]))
        index[rows[better]], best[rows[better]] = entry[better], found[better]
    return index, best, tried


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _to_pivots(pivots: list[np.ndarray], cuts: list[tuple[int, int]], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch['_ints'], np.int64)
            if not len(values):
                continue
            found = np.concatenate([distances(values[:, a:b], p) for (a, b), p in zip(cuts, pivots)], axis=1).astype(np.float32)
            offsets = np.arange(len(values) + 1, dtype=np.int32) * found.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch[name] for name in schema.names[:-1]], lists], names=schema.names)
    return run


def _assigned(batch: pa.RecordBatch, books: list[np.ndarray], pivots: list[np.ndarray], cuts: list[tuple[int, int]]) -> Iterator[tuple]:
    """Per part: its values, the nearest entries and their squared distances."""
    values, stored, at = _matrix(batch['_ints'], np.int64), _matrix(batch['_to_pivots'], np.float32), 0
    for (a, b), book, own in zip(cuts, books, pivots):
        index, best, _ = assign(values[:, a:b], stored[:, at:at + len(own)], book, own)
        at += len(own)
        yield values[:, a:b], index, best


def _sums(books: list[np.ndarray], pivots: list[np.ndarray], cuts: list[tuple[int, int]]):
    """A row per entry and component of a task: how many parts the entry has and their sum there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(book), np.int64) for book in books]
        totals = [np.zeros(book.shape, object) for book in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            for part, (values, index, _) in enumerate(_assigned(batch, books, pivots, cuts)):
                counts[part] += np.bincount(index, minlength=len(books[part]))
                most = int(np.abs(values).max(initial=0))
                sums = np.zeros(books[part].shape, np.int64 if most * len(values) < 2 ** 62 else object)
                np.add.at(sums, index, values.astype(sums.dtype))
                totals[part] += sums.astype(object)
        rows = [(a + i, entry, int(counts[part][entry]), Decimal(int(totals[part][entry, i])))
                for part, (a, b) in enumerate(cuts) for entry in range(len(books[part])) if counts[part][entry] for i in range(b - a)]
        columns = list(zip(*rows)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([
            pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()),
            pa.array(columns[3], pa.decimal128(38, 0))], names=['place', 'entry', 'n', 'total'])
    return run


def _codes(books: list[np.ndarray], pivots: list[np.ndarray], cuts: list[tuple[int, int]], names: list[str]):
    digits = np.array([f'{i:02x}' for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code, error = np.full(batch.num_rows, '', dtype=f'U{2 * len(cuts)}'), np.zeros(batch.num_rows, object)
            for _, index, best in _assigned(batch, books, pivots, cuts):
                code, error = np.char.add(code, digits[index]), error + best.astype(object)
            yield pa.RecordBatch.from_arrays(
                [*[batch[name] for name in names], pa.array(code.tolist(), pa.string()),
                 pa.array([e if e < 2 ** 63 else None for e in error.tolist()], pa.int64())], names=[*names, 'code', 'error'])
    return run


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all entries' components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(','.join(str(int(x)) for book in books for entry in book for x in entry).encode()).hexdigest()


def compress(frame: DataFrame, key: str = 'vec_id', vector: str = 'embedding', label: str = 'label', parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every vector, and the codebooks (one array of entries per part).

    Codebooks start as the parts of the vectors with the smallest keys (fewer
    vectors, fewer entries; null keys come last, equal keys in order of their
    vectors).  Each round replaces every entry by the floored mean of the parts
    that it is nearest to; an entry that has none stays.

    Vectors without ``integers`` take no part, nor do those of another length
    than the first one's; a length that the number of parts does not divide gives
    parts that differ by one.  Repeated rows count each.  An error beyond a long
    is null.  Other columns are not looked at; no vectors, no rows and no books.
    """
    if entries > 256:
        raise ValueError('codes have two hexadecimal digits a part: at most 256 entries')
    kept = frame.select(F.col(key).alias('vec_id'), F.col(label).alias('label'), integers(F.col(vector)).alias('_ints')).where('_ints is not null')
    first = kept.orderBy(F.col('vec_id').asc_nulls_last(), '_ints').limit(1).collect()
    width = len(first[0]['_ints']) if first else 0
    kept = kept.where(F.size('_ints') == width)
    start = [r['_ints'] for r in kept.orderBy(F.col('vec_id').asc_nulls_last(), '_ints').limit(entries).collect()]
    cuts = bounds(width, parts)
    whole = np.array(start, np.int64).reshape(len(start), width)
    books = [whole[:, a:b] for a, b in cuts]
    fixed = [far_apart(book, pivots) for book in books]
    names = ['vec_id', 'label', '_ints', '_to_pivots']
    spark_schema = f'vec_id {kept.schema["vec_id"].dataType.simpleString()}, label {kept.schema["label"].dataType.simpleString()}'
    table = written(kept.mapInArrow(_to_pivots(fixed, cuts, pa.schema([(n, pa.null()) for n in names])),
                                    f'{spark_schema}, _ints array<bigint>, _to_pivots array<float>'), 'vectors')
    for _ in range(rounds if len(start) else 0):
        sums = table.mapInArrow(_sums(books, fixed, cuts), 'place int, entry int, n long, total decimal(38,0)')
        merged = sums.groupBy('place', 'entry').agg(F.sum('n').alias('n'), F.sum('total').alias('total')).collect()  # entries x width rows
        books = [book.copy() for book in books]
        part_of = {a + i: (part, i) for part, (a, b) in enumerate(cuts) for i in range(b - a)}
        for row in merged:
            part, i = part_of[row['place']]
            books[part][row['entry'], i] = int(row['total']) // row['n']
    return table.mapInArrow(_codes(books, fixed, cuts, ['vec_id', 'label']), f'{spark_schema}, code string, error long'), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds label_error: the errors of all rows of the same label added up, nulls together; null beyond a long.

    Labels that hold a thousandth of the rows or more are a thousand at most: these are broadcast, the others joined.
    """
    table = written(coded, 'codes')
    total = table.count()
    sums = table.groupBy('label').agg(F.try_sum('error').alias('label_error'), F.count('*').alias('_n'))
    sums = written(sums, 'label-errors').withColumnRenamed('label', '_label')
    hot = F.broadcast(sums.where(F.col('_n') * 1000 >= total))
    same = F.col('label').eqNullSafe(F.col('_label'))
    common = table.join(hot, same)
    rest = table.join(hot, same, 'left_anti').join(sums.where(F.col('_n') * 1000 < total), same)
    return common.unionByName(rest).drop('_label', '_n')
