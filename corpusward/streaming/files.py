"""Analysing files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.scan import ALL_FAMILIES, scan_files
from ..sources.files import in_short_tasks

FILE_SCHEMA = 'file_id long, url string, content string, batch_id string'


def read_file_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(FILE_SCHEMA).option('maxFilesPerTrigger', files_per_trigger).parquet(path)


def stream_scan_files(files: DataFrame, families: list[str] = ALL_FAMILIES, **options) -> DataFrame:
    """Findings of arriving files.

    The scan is stateless - de-duplication is inside a file - so this is the batch
    operator, in append mode.
    """
    return scan_files(files, families, **options)


def stream_batch_progress(files: DataFrame) -> DataFrame:
    """Running number of completed files per batch (update or complete mode)."""
    return files.groupBy('batch_id').agg(F.count('*').alias('completed'))


def analyze_stream(files: DataFrame, path: str, checkpoint: str, families: list[str] = ALL_FAMILIES, **options) -> StreamingQuery:
    """Findings and then progress of every micro-batch, from one stream of files with a ``batch_id``.

    Each micro-batch writes folders of its own number, findings first; one that is
    run again after a failure replaces them, so nothing is doubled and no progress
    is told whose findings are not there.
    """
    def both(arrived: DataFrame, number: int) -> None:
        found = scan_files(in_short_tasks(arrived), families, **options)
        found.write.mode('overwrite').parquet(f'{path}/findings/micro_batch={number}')
        stream_batch_progress(arrived).write.mode('overwrite').parquet(f'{path}/progress/micro_batch={number}')
    return (files.writeStream.foreachBatch(both).option('checkpointLocation', checkpoint).trigger(availableNow=True).start())


def streamed_findings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f'{path}/findings').drop('micro_batch')


def streamed_progress(spark: SparkSession, path: str) -> DataFrame:
    """Completed files per batch over all micro-batches."""
    return spark.read.parquet(f'{path}/progress').groupBy('batch_id').agg(F.sum('completed').alias('completed'))


def write_findings(findings: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (findings.writeStream.format('parquet').option('path', path).option('checkpointLocation', checkpoint)
            .outputMode('append').trigger(availableNow=True).start())
