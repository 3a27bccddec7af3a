"""Helpers the operators share: written intermediate tables, folds, column names, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Words of the contracts: everything but the six ASCII white-space characters.
SPACE = r'[\x20\x09-\x0D]+'


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of our own only where it is unset and all executors are threads of this process."""
    master, named = spark.sparkContext.master, spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not master.startswith('local[') and master != 'local':
            raise ValueError('set spark.checkpoint.dir to a folder that the driver and all executors share')
        named = tempfile.mkdtemp(prefix='corpusward-')
        spark.sparkContext.setCheckpointDir(named)
    return named


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, in case it is not installed there."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        target = f'{tempfile.mkdtemp()}/{package.name}.zip'
        with zipfile.ZipFile(target, 'w') as archive:
            for file in sorted(package.rglob('*.py')):
                archive.write(file, file.relative_to(package.parent))
        context.addPyFile(target)
        _SHIPPED.add(context.applicationId)


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, and no lineage behind it.

    Its shuffle files are removed with the end of the write; those of earlier steps
    once the driver's garbage is collected, which else may take half an hour.
    """
    path = f'{shared_folder(frame.sparkSession).rstrip("/")}/{name}-{uuid.uuid4().hex}'
    with _own_shuffles_removed(frame.sparkSession):
        frame.write.option('compression', 'zstd').parquet(path)
    gc.collect()
    frame.sparkSession.sparkContext._jvm.System.gc()
    table = frame.sparkSession.read.schema(frame.schema).parquet(path)
    table.written_at = path
    return table


_CLEANUP = 'spark.sql.classic.shuffleDependency.fileCleanup.enabled'


@contextmanager
def _own_shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries run inside remove their shuffle files when they end, whatever the session's own setting."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, 'true')
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def discard(*tables: DataFrame) -> None:
    """Remove tables that came from ``written`` and that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.written_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id is in no fold (-1)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast('string')) % n, F.lit(-1))


def gathered(frame: DataFrame) -> list[dict]:
    """Rows of a small frame; arrays stay slices of one numpy array instead of lists of Python numbers."""
    table, columns = frame.toArrow(), {}
    for name in table.column_names:
        column = table[name].combine_chunks()
        if pa.types.is_list(column.type):
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
            columns[name] = [flat[int(a):int(b)] for a, b in zip(np.r_[0, ends], ends)]
        else:
            columns[name] = column.to_pylist()
    return [dict(zip(columns, row)) for row in zip(*columns.values())]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f'{sf_dir}/documents.parquet')


def least_hashed(rows: DataFrame, key: str, group: str, n: int) -> DataFrame:
    """Of every group the ``n`` rows whose key has the smallest hash; rows of equal key count once.

    Only rows below a hash that a few times ``n`` of a group's rows are below are
    ranked, so no task gets a group.  Groups are as many as a model has outputs.
    """
    share = F.xxhash64(key).cast('double') / 2.0 ** 64 + 0.5
    group_of, size, rank = free_name(rows, '_group', '_size', '_rank')
    sizes = rows.groupBy(F.col(group).alias(group_of)).agg(F.count('*').alias(size))
    few = rows.join(F.broadcast(sizes), F.col(group) == F.col(group_of)).where(share * F.col(size) < 4 * n + 100)
    few = few.drop(group_of, size).dropDuplicates([key])
    order = Window.partitionBy(group).orderBy(F.xxhash64(key), key)
    return few.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= n).drop(rank)


def free_name(frame: DataFrame, *wanted: str) -> list[str]:
    """Names near the wanted ones that no column of the frame has (names compare without case)."""
    taken, found = {c.lower() for c in frame.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f'_{name}'
        taken.add(name.lower())
        found.append(name)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b) rows; component is the smallest node.

    Alternating large-star and small-star steps: each keeps connectivity and
    ends in stars, after a number of rounds logarithmic in the longest path.
    Every round is written, so a lost executor costs one round at most.  Nodes
    without an edge are not in the result.
    """
    pairs = edges.select(F.least('a', 'b').alias('b'), F.greatest('a', 'b').alias('a')).where('a <> b').distinct()
    pairs = written(pairs, 'edges')

    def signature(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count('*'), F.bit_xor(F.xxhash64('a', 'b')), F.sum(F.xxhash64('b', 'a') % 1000003)).first())

    state = signature(pairs)
    while state[0]:
        # large star: larger neighbours point to the smallest of the neighbourhood
        both = pairs.select('a', 'b').unionByName(pairs.select(F.col('b').alias('a'), F.col('a').alias('b')))
        least = both.groupBy('a').agg(F.min('b').alias('m')).select('a', F.least('a', 'm').alias('m'))
        large = both.where('b > a').join(least, 'a').select(F.col('b').alias('a'), F.col('m').alias('b'))
        large = large.unionByName(least.where('m < a').select('a', F.col('m').alias('b'))).where('a <> b').distinct()
        # small star: a node and its smaller neighbours point to the smallest of them
        low = large.groupBy('a').agg(F.min('b').alias('m'))
        small = large.join(low, 'a').select(F.when(F.col('b') == F.col('m'), F.col('a')).otherwise(F.col('b')).alias('a'),
                                            F.col('m').alias('b')).where('a <> b').distinct()
        pairs = written(small, 'edges')
        state, before = signature(pairs), state
        if state == before:
            break
    return pairs.select(F.col('a').alias('node'), F.col('b').alias('component')).unionByName(
        pairs.select(F.col('b').alias('node'), F.col('b').alias('component')).distinct())
