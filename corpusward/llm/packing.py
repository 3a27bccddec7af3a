"""Best-fit packing of token sequences by minimum bin slack.

Per bin, a bitset subset-sum over the lengths still available finds the fullest
feasible combination around the longest one; that combination is taken as often
as the counts allow and removed.  Only the histogram of lengths (at most
``capacity`` numbers, whatever the size of the table) goes to the driver; the
plan that comes back says which ranks of a length go where, and its size depends
on the number of different lengths, not on the rows.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import free_name, written


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str):
    """Byte-level pair merging from a rank file."""
    import tiktoken

    with open(path, 'rb') as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: Column, path: str, pattern: str, end: int | None = 0) -> Column:
    """Ids of a text as little-endian unsigned 32-bit binary, then the end id.

    Null is the empty text; strings of special tokens are ordinary text.
    """
    last = b'' if end is None else np.array([end], '<u4').tobytes()

    def ids(texts: pa.Array) -> pa.Array:
        encode = tokenizer(path, pattern).encode_to_numpy
        return pa.array([encode(t.as_py() or '').astype('<u4', copy=False).tobytes() + last for t in texts], pa.binary())
    # marked so, the function is evaluated once whatever reads its result
    return F.arrow_udf(ids, 'binary').asNondeterministic()(text)


def cut(docs: DataFrame, ids: str = 'ids', size: int = 2048) -> DataFrame:
    """Pieces of at most ``size`` ids: columns piece, start, length and the piece's ``ids`` beside the document's.

    A document that fits is one piece.  A longer one is cut into full pieces, of
    which the first holds the remainder.  Documents without ids have no piece.
    Columns piece, start and length of the input are replaced.
    """
    n = (F.length(ids) / 4).cast('long')
    first = F.when(n % size == 0, F.lit(size)).otherwise(n % size)
    piece, all_ids = free_name(docs, '_piece', '_ids')
    rows = (docs.where(n > 0).withColumnRenamed(ids, all_ids).withColumns({'_n': (F.length(all_ids) / 4).cast('long')})
            .withColumn('_first', F.when(F.col('_n') % size == 0, F.lit(size)).otherwise(F.col('_n') % size).cast('long'))
            .withColumn(piece, F.explode(F.sequence(F.lit(0), ((F.col('_n') - 1) / size).cast('int')))))
    start = F.when(F.col(piece) == 0, F.lit(0)).otherwise(F.col('_first') + (F.col(piece) - 1) * size).cast('long')
    length = F.when(F.col(piece) == 0, F.col('_first')).otherwise(F.lit(size)).cast('long')
    return (rows.withColumns({'start': start, 'length': length})
            .withColumn(ids, F.substring(all_ids, (F.col('start') * 4 + 1).cast('int'), (F.col('length') * 4).cast('int')))
            .withColumn('piece', F.col(piece)).drop(piece, all_ids, '_n', '_first'))


def _fullest(counts: dict[int, int], lengths: list[int], room: int, long_first: bool) -> dict[int, int]:
    """Lengths (rising) whose sum comes nearest to ``room``, as length -> uses.

    Of equally full combinations, ``long_first`` takes the one with the longest
    pieces; else the one whose shortest piece is longest.
    """
    mask = (1 << room + 1) - 1
    reached, steps = 1, []
    for size in lengths if long_first else reversed(lengths):
        if size > room:
            if long_first:
                break
            continue
        left, uses = min(counts[size], room // size), 1
        while left:
            uses = min(uses, left)
            steps.append((size, uses, reached))
            reached |= reached << size * uses & mask
            left -= uses
            uses *= 2
        if reached >> room and not long_first:
            break
    at, found = reached.bit_length() - 1, {}
    for size, uses, before in reversed(steps):
        weight = size * uses
        # without the step the sum is out of reach, or the step's long pieces are wanted and the rest can be reached
        if not before >> at & 1 or (long_first and at >= weight and before >> at - weight & 1):
            found[size] = found.get(size, 0) + uses
            at -= weight
    return found


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, uses, bins, first bin, offset) of the plan with the fewest bins.

    ``uses * bins`` ranks of the length from the first rank on go to ``bins``
    bins: rank r is at use ``(r - first) // bins`` of bin ``first bin + (r - first) % bins``.
    Which of equally full combinations leaves the better rest depends on the
    histogram, so a plan is made either way.
    """
    if any(not 0 < size <= capacity for size in histogram):
        raise ValueError(f'lengths must be 1 to {capacity}')
    plans = [_plan(histogram, capacity, long_first) for long_first in (True, False)]
    return min(plans, key=lambda rows: max((r[4] + r[3] for r in rows), default=0))


def _plan(histogram: dict[int, int], capacity: int, long_first: bool) -> list[tuple[int, int, int, int, int, int]]:
    counts = {size: n for size, n in histogram.items() if n > 0}
    taken, rows, bins = dict.fromkeys(counts, 0), [], 0
    lengths = sorted(counts)
    while lengths:
        top = lengths[-1]
        counts[top] -= 1
        use = _fullest(counts, [s for s in lengths if counts[s]], capacity - top, long_first)
        counts[top] += 1
        use[top] = use.get(top, 0) + 1
        times = min(counts[size] // n for size, n in use.items())
        offset = 0
        for size in sorted(use, reverse=True):
            rows.append((size, taken[size], use[size], times, bins, offset))
            taken[size] += use[size] * times
            counts[size] -= use[size] * times
            offset += size * use[size]
        bins += times
        lengths = [size for size in lengths if counts[size]]
    return rows


def pack(pieces: DataFrame, capacity: int, length: str = 'length', rows_per_range: int = 200_000) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` (both long) so that no sequence is longer than ``capacity``.

    Lengths must be 1 to ``capacity``; others, also null ones, are an error.
    Pieces of one length are numbered range by range, so that a length that most
    pieces have is no single task.  Result columns replace input columns of their
    names; an empty table stays empty; repeated rows are rows of their own.  The
    same table, read again, is packed alike.
    """
    pieces = pieces.drop('sequence_id', 'offset')
    salt, size, rank = free_name(pieces, '_salt', '_size', '_rank')
    kept = written(pieces.withColumn(salt, F.floor(F.rand(11) * 1048576)), 'pieces')
    histogram = {r[0]: r[1] for r in kept.groupBy(F.col(length)).count().collect()}  # at most capacity rows
    if None in histogram:
        raise ValueError('a length is null')
    layout = plan(histogram, capacity)
    ranges = max(1, sum(histogram.values()) // rows_per_range)
    kept = kept.withColumns({salt: F.col(salt) % ranges, size: F.col(length).cast('long')})
    counts = kept.groupBy(size, salt).agg(F.count('*').alias('_n'))
    before = counts.withColumn('_before', F.sum('_n').over(
        Window.partitionBy(size).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)))
    # by all columns, so that a task run again after a lost executor gives the same numbers
    order = [c for c in pieces.columns if 'map<' not in pieces.schema[c].dataType.simpleString()]
    numbered = (kept.withColumn(rank, F.row_number().over(Window.partitionBy(size, salt).orderBy(*order)) - 1)
                .join(before.select(size, salt, F.coalesce('_before', F.lit(0)).alias('_before')), [size, salt])
                .withColumn(rank, F.col(rank) + F.col('_before')).drop('_before', salt))
    table = pieces.sparkSession.createDataFrame(
        layout, '_length long, _first long, _uses long, _bins long, _bin long, _offset long')
    at = F.col(rank) - F.col('_first')
    return (numbered.join(F.broadcast(table), (F.col(size) == F.col('_length')) & (at >= 0) & (at < F.col('_uses') * F.col('_bins')))
            .withColumns({'sequence_id': F.col('_bin') + at % F.col('_bins'),
                          'offset': F.col('_offset') + F.floor(at / F.col('_bins')).cast('long') * F.col(size)})
            .drop('_length', '_first', '_uses', '_bins', '_bin', '_offset', size, rank))
