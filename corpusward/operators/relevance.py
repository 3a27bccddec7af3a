"""Relevance of files: size heuristics and the optional trained model."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..catalog import words as W


def heuristic_relevance(content: Column, predicted: Column) -> Column:
    """Short files are irrelevant, very long and empty ones relevant, the rest as predicted."""
    size = F.length(content)
    return (F.when(F.coalesce(size, F.lit(0)) == 0, F.lit(True)).when(size < W.RELEVANCE_MIN_CHARS, F.lit(False))
            .when(size > W.RELEVANCE_MAX_CHARS, F.lit(True)).otherwise(predicted))


def filter_relevance_heuristic(files: DataFrame) -> DataFrame:
    """Relevance decided by size alone (null where the model has to decide)."""
    return files.withColumn('relevant', heuristic_relevance(F.col('content'), F.lit(None).cast('boolean')))


def train_relevance_model(spark: SparkSession) -> PipelineModel:
    """Linear classifier over the presence of hashed tokens, from the fixed samples."""
    rows = [(t, 1.0) for t in W.RELEVANT_SAMPLES] + [(t, 0.0) for t in W.IRRELEVANT_SAMPLES]
    samples = spark.createDataFrame(rows, 'content string, label double')
    stages = [
        RegexTokenizer(inputCol='content', outputCol='tokens', pattern=r'\b\w\w+\b', gaps=False, toLowercase=True),
        HashingTF(inputCol='tokens', outputCol='presence', numFeatures=2 ** 14, binary=True),
        Normalizer(inputCol='presence', outputCol='features', p=2.0),
        LinearSVC(maxIter=5, regParam=1e-3, standardization=False)]
    return Pipeline(stages=stages).fit(samples)


def score_relevance(files: DataFrame, model: PipelineModel | None = None, size_limits: bool = False) -> DataFrame:
    """Adds ``relevant`` and ``relevance_score``; without a model every file is relevant.

    With ``size_limits`` the size decides first, as in ``heuristic_relevance``;
    else the model decides every file that is not empty.
    """
    if model is None:
        return files.withColumns({'relevant': F.lit(True), 'relevance_score': F.lit(1.0)})
    scored = model.transform(files)
    margin = vector_to_array('rawPrediction')[1]
    score = F.when(F.coalesce(F.length('content'), F.lit(0)) == 0, F.lit(1.0)).otherwise(1 / (1 + F.exp(-margin)))
    predicted = F.col('prediction') == 1.0
    relevant = heuristic_relevance(F.col('content'), predicted) if size_limits else (
        F.when(F.coalesce(F.length('content'), F.lit(0)) == 0, F.lit(True)).otherwise(predicted))
    return scored.select(*files.columns, relevant.alias('relevant'),
                         score.alias('relevance_score'))


def gate_skipped_files(scored: DataFrame) -> DataFrame:
    """Adds ``skipped`` and an error line for irrelevant files, which later scans leave out."""
    skipped = ~F.col('relevant')
    message = F.format_string('Skipped by ML Filter (Low relevance score: %.2f)', F.col('relevance_score'))
    return scored.withColumn('skipped', skipped).withColumn('errors', F.array_compact(F.array(F.when(skipped, message))))


def gate_sink_scan_size(files: DataFrame) -> DataFrame:
    """Error lines of files too large for the sink-call scan."""
    mb = F.length('content') / (1024 * 1024)
    text = F.format_string('Skipped AST analysis for large file (%.2fMB). Regex analysis still performed.', mb)
    return files.where(F.length('content') > W.MAX_SINK_SCAN_CHARS).select('file_id', 'url', text.alias('error'))


def union_errors(*frames: DataFrame) -> DataFrame:
    """Per-file error arrays from frames with (file_id, error), in the order of the frames."""
    rows = None
    for i, frame in enumerate(frames):
        part = frame.where(F.col('error').isNotNull()).select('file_id', F.struct(F.lit(i).alias('step'), 'error').alias('e'))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy('file_id').agg(F.array_sort(F.collect_list('e')).alias('e')).select(
        'file_id', F.transform('e', lambda e: e['error']).alias('errors'))
