import datetime as dt
import random

from pyspark.sql import functions as F

from corpusward.streaming.files import (FILE_SCHEMA, analyze_stream, read_file_stream, stream_batch_progress, stream_scan_files, streamed_findings,
                                        streamed_progress, write_findings)
from corpusward.streaming.limiter import SLICES, exempt_trusted, limit_request_stream, limit_requests, stretches, timed
from corpusward.operators.scan import scan_files

START = dt.datetime(2024, 1, 1)
SCHEMA = 'key string, ts timestamp, event_id long, reset boolean'


def requests(n=4000, seed=1):
    """A hot key with bursts and pauses, quiet keys, equal times and resets."""
    rng = random.Random(seed)
    rows, now = [], 0.0
    for i in range(n):
        now += rng.choice([0, 0, 0.1, 0.5, 2, 2, 5, 30])
        key = 'hot' if rng.random() < 0.6 else f'k{rng.randint(0, 20)}'
        rows.append((key, START + dt.timedelta(seconds=now), i, rng.random() < 0.01))
    return rows


def folded(rows, limit, window):
    logs, out = {}, {}
    for key, ts, i, reset in sorted(rows, key=lambda r: (r[1], r[2])):
        if reset:
            logs[key] = []
            continue
        log = [t for t in logs.get(key, []) if t > ts - dt.timedelta(seconds=window)]
        passed = len(log) < limit
        logs[key] = log + [ts] if passed else log
        out[i] = (passed, max(0, limit - len(logs[key])))
    return out


def test_batch_equals_a_plain_fold(spark):
    rows = requests()
    frame = spark.createDataFrame(rows, SCHEMA)
    for limit, window in [(10, 10), (1, 3), (3, 60), (100, 60)]:
        got = {r.event_id: (r.admitted, r.remaining) for r in limit_requests(frame, limit, window).collect()}
        assert got == folded(rows, limit, window), (limit, window)


def test_long_stretches_are_handed_on(spark):
    """Stretches of many pieces, some of them cut inside a burst of equal times."""
    rows = requests(3000, seed=7)
    frame = spark.createDataFrame(rows, SCHEMA)
    for limit, window, piece in [(10, 10, 64), (3, 60, 200)]:
        got = {r.event_id: (r.admitted, r.remaining) for r in limit_requests(frame, limit, window, piece).collect()}
        assert got == folded(rows, limit, window), (limit, window, piece)


def test_a_hot_key_is_cut_where_its_log_is_certain(spark):
    frame = timed(spark.createDataFrame(requests(), SCHEMA), 10_000_000)
    cut = stretches(frame, 10).where("key = 'hot'")
    assert cut.select('_stretch').distinct().count() > 20
    assert cut.selectExpr('sum(_n)').first()[0] == frame.where("key = 'hot'").count()
    assert SLICES > 1


def test_a_million_requests_over_the_limit(spark):
    """One key, one stretch: folded in pieces of bounded size, without Python in the plan."""
    n = 1_000_000
    frame = spark.range(n).select(F.lit('hot').alias('key'), (F.lit(START).cast('timestamp') + F.make_dt_interval(secs=F.col('id') * 0.01)).alias('ts'),
                                  F.col('id').alias('event_id'))
    decided = limit_requests(frame, 5, 60, piece=100_000)
    assert 'Python' not in decided._jdf.queryExecution().toString() and 'Pandas' not in decided._jdf.queryExecution().toString()
    assert decided.count() == n
    # 100 a second: five pass every minute, the first five of it
    passed = [r.event_id for r in decided.where('admitted').orderBy('event_id').collect()]
    assert passed == [i for i in range(n) if i % 6000 < 5]


def test_nulls_ties_and_other_columns(spark):
    start = START
    rows = [(None, start, 1, None, 'a'), (None, start, 1, None, 'b'), (None, start, None, False, 'c'), ('k', None, 7, None, 'd'),
            ('k', start, 2, True, 'e'), ('k', start, 3, None, None), ('k', None, 8, True, 'f')]
    frame = spark.createDataFrame(rows, 'key string, ts timestamp, event_id long, reset boolean, admitted_by string')
    frame = frame.withColumn('tags', F.create_map(F.lit('x'), 'admitted_by'))
    got = limit_requests(frame, 2, 60)
    assert got.columns == ['key', 'ts', 'event_id', 'admitted_by', 'tags', 'admitted', 'remaining']
    found = sorted(((r.key or '', str(r.event_id), r.admitted, str(r.remaining)) for r in got.collect()))
    assert found == [('', '1', False, '0'), ('', '1', True, '0'), ('', 'None', True, '1'), ('k', '3', True, '1'), ('k', '7', False, 'None')]
    assert limit_requests(frame.where('false'), 2, 60).collect() == []


def test_exemption(spark):
    rows = [('/static/a', False), ('/favicon.ico', False), ('/api', True), ('/api', None), ('/', False)]
    kept = exempt_trusted(spark.createDataFrame(rows, 'path string, trusted boolean')).collect()
    assert [tuple(r) for r in kept] == [('/api', None), ('/', False)]


def run_in_steps(spark, tmp_path, steps, limit, window, late):
    """Each step is one file and one micro-batch; returns the rows and the finished query."""
    source, out = str(tmp_path / 'requests'), str(tmp_path / 'out')
    for rows in steps:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode('append').parquet(source)
    stream = spark.readStream.schema(SCHEMA).option('maxFilesPerTrigger', 1).parquet(source)
    query = (limit_request_stream(stream, limit, window, late).writeStream.format('parquet').option('path', out)
             .option('checkpointLocation', str(tmp_path / 'ck')).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(out), query


def test_stream_equals_batch(spark, tmp_path):
    rows = requests(600)
    found, _ = run_in_steps(spark, tmp_path, [rows[at:at + 200] for at in range(0, 600, 200)], 3, 20, '1 hour')
    assert {r.event_id: (r.admitted, r.remaining) for r in found.collect()} == folded(rows, 3, 20)


def test_state_of_idle_keys_goes(spark, tmp_path):
    def at(seconds):
        return START + dt.timedelta(seconds=seconds)
    crowd = [(f'k{i}', at(i % 5), i, False) for i in range(50)]
    later = [[('other', at(100 * n), 1000 + n, False)] for n in range(1, 5)]
    found, query = run_in_steps(spark, tmp_path, [crowd, *later], 3, 20, '0 seconds')
    assert found.count() == 54
    kept = [p['stateOperators'][0]['numRowsTotal'] for p in query.recentProgress if p['stateOperators']]
    rows = spark.read.format('statestore').option('stateVarName', 'log').load(str(tmp_path / 'ck'))
    assert {r.key[0] for r in rows.select('key').collect()} <= {'other'}
    assert max(kept) >= 50


def test_file_stream_equals_batch(spark, tmp_path):
    rows = [(i, 'http://h.io/a.js', f'password = "secret{i}"; el.innerHTML = a{i}; eval(x)', f'b{i % 2}') for i in range(6)]
    frame = spark.createDataFrame(rows, FILE_SCHEMA)
    source = str(tmp_path / 'files')
    frame.repartition(3).write.parquet(source)
    families = ['credentials', 'xss_sinks', 'sink_calls', 'parameters']
    out, check = str(tmp_path / 'found'), str(tmp_path / 'check')
    write_findings(stream_scan_files(read_file_stream(spark, source, 1), families), out, check).awaitTermination()
    batch = scan_files(frame, families)
    assert sorted(map(str, spark.read.schema(batch.schema).parquet(out).collect())) == sorted(map(str, batch.collect()))
    seen = (stream_batch_progress(read_file_stream(spark, source)).writeStream.format('memory').queryName('progress')
            .outputMode('complete').trigger(availableNow=True).start())
    seen.awaitTermination()
    assert sorted(map(tuple, spark.table('progress').collect())) == [('b0', 3), ('b1', 3)]


def test_a_micro_batch_run_again_doubles_nothing(spark, tmp_path):
    """The last micro-batch is written but not committed, as after a failure; the restarted stream runs it again."""
    rows = [(i, 'http://h.io/a.js', f'password = "secret{i}"; eval(x)', f'b{i % 2}') for i in range(6)]
    frame = spark.createDataFrame(rows, FILE_SCHEMA)
    source, out, check = str(tmp_path / 'files'), str(tmp_path / 'out'), tmp_path / 'check'
    frame.repartition(3).write.parquet(source)
    families = ['credentials', 'sink_calls']

    def run():
        analyze_stream(read_file_stream(spark, source, 1), out, str(check), families).awaitTermination()
    run()
    last = max((check / 'commits').glob('[0-9]*'), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f'.{last.name}.crc').unlink(missing_ok=True)
    run()
    found = streamed_findings(spark, out)
    batch = scan_files(frame, families)
    assert found.columns == batch.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, batch.collect()))
    assert sorted(map(tuple, streamed_progress(spark, out).collect())) == [('b0', 3), ('b1', 3)]
