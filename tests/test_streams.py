"""Registered streams on tables that are one file or a folder of files, in a session with Spark's own settings."""

import datetime as dt
import shutil

import pytest

import __spark_entry__ as entry_module

QUERIES = entry_module.queries()
PROVIDER = 'spark.sql.streaming.stateStore.providerClass'
PLAIN = 'org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider'
START = dt.datetime(2024, 1, 1)


def write(frame, folder, name, as_folder):
    """The table as a folder of three files, or as one file."""
    path = folder / f'{name}.parquet'
    if as_folder:
        frame.repartition(3).write.parquet(str(path))
    else:
        frame.coalesce(1).write.parquet(f'{path}-folder')
        shutil.copy(next((folder / f'{name}.parquet-folder').glob('part-*')), path)


@pytest.mark.parametrize('as_folder', [True, False])
def test_request_stream(spark, tmp_path, as_folder):
    rows = [(i, START + dt.timedelta(hours=7 * i), i % 3, 'view') for i in range(60)]
    write(spark.createDataFrame(rows, 'event_id long, ts timestamp, user_id long, event_type string'), tmp_path, 'events', as_folder)
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, PLAIN)
    try:
        found = QUERIES['limit_request_stream'](spark, str(tmp_path)).collect()
        assert spark.conf.get(PROVIDER) == PLAIN
    finally:
        spark.conf.set(PROVIDER, before)
    passed = {r.event_id: r.admitted for r in QUERIES['limit_requests'](spark, str(tmp_path)).collect()}
    left = {r.event_id: r.remaining for r in QUERIES['remaining_quota'](spark, str(tmp_path)).collect()}
    assert len(found) == 60
    assert {r.event_id: (r.admitted, r.remaining) for r in found} == {i: (passed[i], left[i]) for i in passed}


@pytest.mark.parametrize('as_folder', [True, False])
def test_page_streams(spark, tmp_path, as_folder):
    rows = [(i, f'http://h{i}.io/{"ab"[i % 2]}/x', f'<p>mail{i}@corp.io</p>') for i in range(12)]
    write(spark.createDataFrame(rows, 'page_id long, url string, html string'), tmp_path, 'pages', as_folder)
    found = QUERIES['stream_scan_files'](spark, str(tmp_path))
    batch = QUERIES['union_all_findings'](spark, str(tmp_path)).select(*found.columns)
    assert found.count() > 12
    assert sorted(map(str, found.collect())) == sorted(map(str, batch.collect()))
    progress = QUERIES['stream_batch_progress'](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, progress)) == [('a', 6), ('b', 6)]
