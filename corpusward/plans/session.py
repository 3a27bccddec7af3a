"""Session settings the engine is tuned for."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


_PROVIDER = 'spark.sql.streaming.stateStore.providerClass'
_ROCKSDB = 'org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider'


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams begun inside keep their state in RocksDB, whatever the session's own setting; list state and timers need it."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings that hold at any size; sizes of the cluster stay the caller's choice."""
    settings = {
        'spark.sql.adaptive.enabled': 'true',
        'spark.sql.adaptive.skewJoin.enabled': 'true',
        'spark.sql.session.timeZone': 'UTC',
        _PROVIDER: _ROCKSDB,
        # a file's text is one value: small splits keep scan tasks short and within memory
        'spark.sql.files.maxPartitionBytes': '32m',
        # expressions are built in bulk; recording a call site for each doubles planning time
        'spark.python.sql.dataFrameDebugging.enabled': 'false',
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder
