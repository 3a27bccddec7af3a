"""Sliding-log admission: per key, a request passes if fewer than ``limit`` passed in the window.

Rejected requests leave no trace.  ``requests(key, ts, event_id [, reset])``.

In batch a key's time line is cut wherever its log is certain; what lies between
two cuts, a stretch, is folded in order by array functions.  A stretch longer
than a piece is cut further: its pieces are folded one per round, each from the
log that the one before left, so no row holds more than a piece and its rows are
spread over the cluster.  The number of rounds is that of the pieces of the
longest stretch; all stretches go through them side by side.
"""

from __future__ import annotations

import sys
import uuid
from collections import deque
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import bound
from ..plans.shared import materialize, shared_folder

# the processor goes to workers as it is: they may not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DECISION = 'admitted boolean, remaining int'
#: Requests in one row, and in one inner fold (the work of a fold grows with the square of its length).
PIECE, CHUNK = 1 << 15, 128
#: A window of one key is sorted in that many time slices.
SLICES = 32


def exempt_trusted(requests: DataFrame) -> DataFrame:
    """Requests the limiter looks at: no trusted key, no static path, no icon.

    ``requests`` has ``path`` and ``trusted``.
    """
    static = F.startswith('path', F.lit('/static')) | (F.col('path') == '/favicon.ico')
    return requests.where(~(static | F.coalesce('trusted', F.lit(False))))


# --- stretches ------------------------------------------------------------------------------

def stretches(timed: DataFrame, limit: int) -> DataFrame:
    """Where the requests of a slice stand in their key's time line: a row per key and slice.

    Time is cut into buckets as long as the window, so only the bucket before
    matters.  A bucket starts a stretch if the one before is empty, or if that
    one is certain: it and its own predecessor together hold no more requests
    than the limit, so all of its requests passed, and they seed the new stretch.

    Columns: key, _slice, _n (its requests), _stretch, _before (requests of the
    stretch up to the slice) and _seeds (whether its requests seed the next one).
    """
    sliced = timed.groupBy('key', '_slice').agg(F.count('*').alias('_n')).withColumn('_bucket', F.floor(F.col('_slice') / SLICES))
    by_time = Window.partitionBy('key').orderBy('_bucket')
    buckets = sliced.groupBy('key', '_bucket').agg(F.sum('_n').alias('_n'), F.sort_array(F.collect_list(F.struct('_slice', '_n'))).alias('_slices'))

    def at(offset: int) -> Column:
        """Requests of the bucket so many windows ago."""
        there = F.lag('_bucket', offset).over(by_time) == F.col('_bucket') - offset
        # two windows ago may be the row before, if the last window is empty
        nearer = F.lag('_bucket', 1).over(by_time) == F.col('_bucket') - offset
        return F.when(there, F.lag('_n', offset).over(by_time)).when(nearer, F.lag('_n', 1).over(by_time)).otherwise(F.lit(0))

    placed = buckets.withColumns({'_last': at(1), '_last_but_one': at(2)})
    certain = (F.col('_last') > 0) & (F.col('_last') + F.col('_last_but_one') <= limit)
    placed = placed.withColumns({'_start': (F.col('_last') == 0) | certain, '_seeded': certain})
    placed = placed.withColumns({
        '_stretch': F.sum(F.col('_start').cast('int')).over(by_time.rowsBetween(Window.unboundedPreceding, 0)),
        '_seeds': F.coalesce(F.lead('_seeded').over(by_time) & (F.lead('_bucket').over(by_time) == F.col('_bucket') + 1), F.lit(False))})
    in_stretch = Window.partitionBy('key', '_stretch').orderBy('_bucket').rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn('_before', F.coalesce(F.sum('_n').over(in_stretch), F.lit(0)))
    each = placed.select('key', '_stretch', '_seeds', '_before', F.posexplode('_slices').alias('_at', '_own'), '_slices')
    return each.select('key', F.col('_own._slice').alias('_slice'), F.col('_own._n').alias('_n'), '_stretch', '_seeds', (F.col('_before') + F.aggregate(
        F.slice('_slices', 1, F.col('_at')), F.lit(0).cast('long'), lambda n, s: n + s['_n'])).alias('_before'))


def timed(requests: DataFrame, window_us: int) -> DataFrame:
    """Requests that have a time, with it in microseconds and the number of its slice."""
    found = requests.withColumn('_us', F.unix_micros(F.col('ts').cast('timestamp'))).where('_us is not null')
    within = F.pmod('_us', F.lit(window_us))
    return found.withColumn('_slice', (F.col('_us') - within) / window_us * SLICES + F.floor(within * SLICES / window_us)).withColumn(
        '_slice', F.col('_slice').cast('long'))


def pieces(requests: DataFrame, limit: int, window_us: int, piece: int) -> DataFrame:
    """(key, _stretch, _piece, _rows): requests in order, at most ``piece`` and the seeds in a row."""
    requests = timed(requests, window_us)
    columns = [c for c in requests.columns if c not in ('reset', '_us', '_slice')]
    row = F.struct('_us', 'event_id', F.coalesce('reset', F.lit(False)).alias('reset'),
                   F.struct(*columns).alias('own')).alias('_row')
    places = stretches(requests, limit).drop('_n').withColumnsRenamed({'key': '_key', '_slice': '_at'})
    joined = requests.join(places, F.col('key').eqNullSafe(F.col('_key')) & (F.col('_slice') == F.col('_at')))
    rank = F.row_number().over(Window.partitionBy('key', '_slice').orderBy('_us', 'event_id'))
    placed = joined.select('key', row, '_stretch', '_seeds', F.floor((F.col('_before') + rank - 1) / piece).alias('_piece'))
    # the requests of a certain bucket are needed twice: for themselves, and first in the next stretch
    here = F.struct('_stretch', '_piece', F.lit(False).alias('seed'))
    there = F.struct((F.col('_stretch') + 1).alias('_stretch'), F.lit(0).cast('long').alias('_piece'), F.lit(True).alias('seed'))
    dealt = placed.select('key', '_row', F.explode(F.when(F.col('_seeds'), F.array(here, there)).otherwise(F.array(here))).alias('_to'))
    rows = F.collect_list(F.struct('_row._us', '_row.event_id', '_to.seed', '_row.reset', '_row.own'))
    unordered = 'map<' in requests.select(row).schema.simpleString()  # such columns can't stand in a natural order
    return dealt.groupBy('key', '_to._stretch', '_to._piece').agg((F.array_sort(rows, _earlier) if unordered else F.sort_array(rows)).alias('_rows'))


def _earlier(a: Column, b: Column) -> Column:
    less, more = F.lit(-1), F.lit(1)
    return (F.when(a['_us'] < b['_us'], less).when(a['_us'] > b['_us'], more)
            .when(a['event_id'] < b['event_id'], less).when(a['event_id'] > b['event_id'], more)
            .when(a['event_id'].isNull() & b['event_id'].isNotNull(), less)
            .when(a['event_id'].isNotNull() & b['event_id'].isNull(), more).otherwise(F.lit(0)))


# --- the fold ---------------------------------------------------------------------------------

def folded(rows: Column, log: Column, limit: int, window_us: int) -> Column:
    """struct<log, decided> of requests in order, from the times that passed before.

    The log never holds more than ``limit`` times; a reset empties it.  Decisions
    are collected chunk by chunk, as an array that grows by one costs its length.
    """
    decided = 'array<struct<admitted: boolean, remaining: int>>'

    def step(state: Column, r: Column) -> Column:
        def decide(live: Column) -> Column:
            passed = ~r['reset'] & (F.size(live) < limit)
            after = F.when(r['reset'], F.array().cast('array<bigint>')).when(passed, F.concat(live, F.array(r['_us']))).otherwise(live)
            return bound(after, lambda now: F.struct(now.alias('log'), F.concat(state['decided'], F.array(F.struct(
                passed.alias('admitted'), (F.lit(limit) - F.size(now)).alias('remaining')))).alias('decided')))
        return bound(F.filter(state['log'], lambda t: t > r['_us'] - window_us), decide)

    def chunk(state: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(state['log'].alias('log'), F.array().cast(decided).alias('decided')), step)
        return bound(inner, lambda done: F.struct(done['log'].alias('log'), F.concat(state['parts'], F.array(done['decided'])).alias('parts')))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / CHUNK).cast('int')), lambda i: F.slice(rows, i * CHUNK + 1, CHUNK))
    start = F.struct(log.alias('log'), F.array().cast(f'array<{decided}>').alias('parts'))
    return F.aggregate(chunks, start, chunk, lambda s: F.struct(s['log'].alias('log'), F.flatten(s['parts']).alias('decided')))


def _decided(table: DataFrame) -> DataFrame:
    """Own requests of folded pieces, with their decisions."""
    both = F.zip_with('_rows', '_done.decided', lambda r, d: F.struct(
        r['seed'].alias('seed'), r['reset'].alias('reset'), r['own'].alias('own'), d['admitted'].alias('admitted'), d['remaining'].alias('remaining')))
    rows = table.select(F.inline(F.filter(both, lambda r: ~r['seed'] & ~r['reset'])))
    return rows.select('own.*', 'admitted', 'remaining')


def limit_requests(requests: DataFrame, limit: int = 100, window_seconds: float = 60, piece: int = PIECE) -> DataFrame:
    """Adds ``admitted`` and ``remaining`` (requests left right after) to every request.

    Equal times go in order of ``event_id``.  A true ``reset`` empties the key's
    log; such rows are not requests and not returned, a null one is none.  A null
    key is a key of its own.  A request without a time is not admitted and has no
    remaining.  Stretches over ``piece`` requests make one Spark job a piece.
    """
    window_us = int(window_seconds * 1_000_000)
    if 'reset' not in requests.columns:
        requests = requests.withColumn('reset', F.lit(False))
    untimed = requests.where(F.col('ts').isNull() & ~F.coalesce('reset', F.lit(False))).drop('reset').withColumns(
        {'admitted': F.lit(False), 'remaining': F.lit(None).cast('int')})
    no_log = F.array().cast('array<bigint>')
    table = pieces(requests, limit, window_us, piece)
    keys = ['key', '_stretch']

    def fold(frame: DataFrame, log: Column) -> DataFrame:
        return frame.withColumn('_done', folded(F.col('_rows'), log, limit, window_us))

    if not _longer(requests, limit, window_us, piece):
        return _decided(fold(table, no_log)).unionByName(untimed)
    # the long stretches, dealt by the number of the piece: a round reads its own pieces only
    last = Window.partitionBy(*keys)
    path = f'{shared_folder(requests.sparkSession)}/pieces-{uuid.uuid4().hex}'
    numbered = table.withColumn('_last', F.max('_piece').over(last))
    numbered.withColumn('_round', F.when(F.col('_last') > 0, F.col('_piece')).otherwise(-1)).repartition('_round', *keys) \
        .write.partitionBy('_round').parquet(path)
    stored = requests.sparkSession.read.parquet(path)
    done, logs = [fold(stored.where('_round = -1'), no_log)], None
    for at in range(stored.agg(F.max('_round')).first()[0] + 1):
        now = stored.where(F.col('_round') == at)
        if logs is None:
            now = now.withColumn('_log', no_log)
        else:
            before = logs.select(F.col('key').alias('_key'), F.col('_stretch').alias('_of'), '_log')
            now = now.join(before, F.col('key').eqNullSafe(F.col('_key')) & (F.col('_stretch') == F.col('_of'))).drop('_key', '_of')
        now = materialize(fold(now, F.col('_log')).drop('_log'))
        done.append(now)
        logs = now.where('_last > _piece').select(*keys, F.col('_done.log').alias('_log'))
    return reduce(DataFrame.unionByName, [_decided(d) for d in done]).unionByName(untimed)


def _longer(requests: DataFrame, limit: int, window_us: int, piece: int) -> bool:
    """Whether any stretch holds more requests than a piece, from the counts alone."""
    return bool(stretches(timed(requests.select('key', 'ts'), window_us), limit).where(F.col('_before') + F.col('_n') > piece).head(1))


# --- stream -----------------------------------------------------------------------------------

class SlidingLog(StatefulProcessor):
    """The same decision on a stream; a key's state is its log, at most ``limit`` times long.

    Only time, id and reset of a key's rows in one micro-batch are held, as
    arrays, to put them in order; the trigger's input limit bounds them.  A
    timer lets a key's state go once the watermark is a window past the last
    time that passed: no later request can see it.
    """

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window_us = limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getListState('log', 'at long')

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, ids, resets = (np.concatenate(c) for c in zip(*[
            (b['at_us'].to_numpy(np.int64), b['event_id'].to_numpy(np.int64), b['reset'].to_numpy(bool)) for b in rows]))
        order = np.lexsort((ids, at))
        at, ids, resets = at[order], ids[order], resets[order]
        log = deque(t for (t,) in self.log.get())
        admitted, remaining = np.zeros(len(at), bool), np.zeros(len(at), np.int32)
        for i, now in enumerate(at.tolist()):
            while log and log[0] <= now - self.window_us:
                log.popleft()
            if resets[i]:
                log.clear()
            elif len(log) < self.limit:
                log.append(now)
                admitted[i] = True
            remaining[i] = self.limit - len(log)
        self._keep(log)
        shown = ~resets
        for a in range(0, int(shown.sum()), 10_000):
            part = slice(a, a + 10_000)
            yield pd.DataFrame({'key': key[0], 'ts': pd.to_datetime(at[shown][part], unit='us'), 'event_id': ids[shown][part],
                                'admitted': admitted[shown][part], 'remaining': remaining[shown][part]})

    def _keep(self, log: deque) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if log:
            self.log.put([(t,) for t in log])
            self.handle.registerTimer((log[-1] + self.window_us) // 1000 + 1)
        else:
            self.log.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.log.clear()
        return iter([])

    def close(self) -> None:
        pass


def limit_request_stream(requests: DataFrame, limit: int = 100, window_seconds: float = 60, late: str = '1 hour') -> DataFrame:
    """Streaming form (needs the RocksDB state store): (key, ts, event_id, admitted, remaining).

    A key's requests arrive in time order from one micro-batch to the next.  The
    watermark is ``late`` behind the latest time seen; what is older is dropped.
    Requests without key, time or id are not decided.
    """
    window_us = int(window_seconds * 1_000_000)
    if 'reset' not in requests.columns:
        requests = requests.withColumn('reset', F.lit(False))
    key_type = requests.schema['key'].dataType.simpleString()
    narrow = requests.select('key', F.col('ts').cast('timestamp').alias('ts'), F.col('event_id').cast('long').alias('event_id'),
                             F.coalesce('reset', F.lit(False)).alias('reset')).where('key is not null and ts is not null and event_id is not null')
    return (narrow.withWatermark('ts', late).withColumn('at_us', F.unix_micros('ts')).groupBy('key')
            .transformWithStateInPandas(
                SlidingLog(limit, window_us), outputMode='append', timeMode='EventTime',
                outputStructType=f'key {key_type}, ts timestamp, event_id long, {DECISION}'))
