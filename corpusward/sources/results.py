"""Writing and looking up results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def sink_results(results: DataFrame, path: str, batch_id: str, fmt: str = 'parquet') -> None:
    """Append one batch; batches are directories, so looking one up reads no other."""
    results.withColumn('batch_id', F.lit(batch_id)).write.mode('append').partitionBy('batch_id').format(fmt).save(path)


def sink_results_json(results: DataFrame, path: str) -> None:
    results.write.mode('overwrite').json(path)


def sink_text_report(report: DataFrame, path: str) -> None:
    """Report lines in reading order."""
    ordered = report.orderBy('file_id', 'section', 'item', 'part_no')
    ordered.select('text').write.mode('overwrite').text(path)


def lookup_batch(spark: SparkSession, path: str, batch_id: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col('batch_id') == batch_id)


def lookup_file(spark: SparkSession, path: str, batch_id: str, file_id: int) -> DataFrame:
    return lookup_batch(spark, path, batch_id).where(F.col('file_id') == file_id)


def write_bucketed(files: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """Corpus or findings as a table bucketed by file, a file per bucket; per-file steps on it need no shuffle.

    Tables with the same number of buckets join without one too.  The table is
    in the warehouse, or at ``path``.
    """
    dealt = files.repartition(buckets, 'file_id').write.mode('overwrite').bucketBy(buckets, 'file_id').sortBy('file_id')
    (dealt.option('path', path) if path else dealt).saveAsTable(table)
    return files.sparkSession.table(table)
