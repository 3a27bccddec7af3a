"""Results that several steps read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only a session whose executors are threads of this process gets one of its own
    where none is set; on a cluster a local folder would lose results.
    """
    context = spark.sparkContext
    named = spark.conf.get('spark.checkpoint.dir', None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith('local[') and context.master != 'local':
            raise ValueError('set spark.checkpoint.dir to a folder that the driver and all executors share')
        named = tempfile.mkdtemp(prefix='corpusward-')
        context.setCheckpointDir(named)
    return named


def materialize(frame: DataFrame, *keys: str) -> DataFrame:
    """Compute once and keep in the shared folder, partitioned by the keys.

    Consumers that join or group by the keys then read it without a shuffle, and
    a lost executor costs a read instead of the scan.
    """
    spark = frame.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return (frame.repartition(*keys) if keys else frame).checkpoint()
