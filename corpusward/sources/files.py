"""Reading corpora and crawls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def spread(frame: DataFrame, key: str = 'file_id') -> DataFrame:
    """Spread rows over the cluster where the input has fewer partitions than cores.

    The scan is bound by processor time; one small input file would otherwise
    run in one task.  Inputs with enough partitions are not shuffled.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame if frame.rdd.getNumPartitions() >= cores else frame.repartition(cores, key)


#: Tasks of a scan by all rules, for each partition the input is read in.
TASKS_PER_PARTITION = 16
#: More tasks where such a task would have more text than this.
CHARS_PER_TASK = 1 << 20


def in_short_tasks(frame: DataFrame, key: str = 'file_id', text: str = 'content') -> DataFrame:
    """Rows for the scan, whose rules take a core seconds to minutes per MB of what the input's files hold.

    A partition that is right for reading is too much text for one such task; cut
    in parts by the text there is, the tasks stay short however large the input is
    and however few files it comes in, and cores that are done take over from slower
    ones.  The price is a pass that adds up the lengths, and a shuffle of the files.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    chars = frame.agg(F.sum(F.length(text)).alias('chars')).first()['chars'] or 0
    return frame.repartition(max(cores, TASKS_PER_PARTITION * frame.rdd.getNumPartitions(), -(-chars // CHARS_PER_TASK)), key)


def scan_code_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """files(file_id, url, content) from a tree of source files.

    Bytes that are not UTF-8 are dropped.  The id is a hash of the path, which
    needs no pass over all files; ``order_by_file_id`` gives running numbers.
    """
    raw = (spark.read.format('binaryFile').option('recursiveFileLookup', str(recursive).lower()).load(path)
           .select('path', F.col('content').alias('bytes')))
    return raw.select(F.xxhash64('path').alias('file_id'), F.col('path').alias('url'), decode_lenient(F.col('bytes')).alias('content'))


def decode_lenient(data):
    """UTF-8 text of bytes, without whatever is not UTF-8.

    Invalid bytes become the replacement mark first; marks that were in the file
    as such are kept by decoding the valid case on its own.
    """
    text = data.cast('string')
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit('�'), F.lit('')))


RESPONSE_SCHEMA = 'url string, status int, headers map<string,string>, body string, ip string'


def scan_crawl_responses(spark: SparkSession, path: str, fmt: str = 'parquet') -> DataFrame:
    """responses(url, status, headers MAP, body, ip, error) from a crawl dump.

    A line of JSON that is no record becomes a row of nulls with the line in
    ``error``: it is counted with the failed fetches and stops nothing.
    """
    if fmt != 'json':
        return spark.read.schema(RESPONSE_SCHEMA).format(fmt).load(path).withColumn('error', F.lit(None).cast('string'))
    rows = (spark.read.schema(f'{RESPONSE_SCHEMA}, _line string').option('mode', 'PERMISSIVE')
            .option('columnNameOfCorruptRecord', '_line').json(path))
    good = F.col('_line').isNull()
    return rows.select(*[F.when(good, F.col(c)).alias(c) for c in rows.columns if c != '_line'],
                       F.concat(F.lit('Unreadable record: '), '_line').alias('error'))
