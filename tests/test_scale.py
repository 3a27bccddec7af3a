"""How the registered scans are cut into tasks and files."""

import re
from collections import defaultdict
from pathlib import Path

import pytest

import __spark_entry__ as entry_module
from corpusward.plans import queries as Q
from corpusward.plans.shared import shared_folder

QUERIES = entry_module.queries()


@pytest.fixture
def folder(spark, tmp_path):
    """Pages in as many files as there are cores, as a cluster reads a larger table."""
    rows = [(i, f'http://h{i}.io/a/x', f'<p>page {i}</p>') for i in range(400)]
    spark.createDataFrame(rows, 'page_id long, url string, html string').repartition(8).write.parquet(str(tmp_path / 'pages.parquet'))
    rows = [(i, f'mail{i}@corp.io') for i in range(400)]
    spark.createDataFrame(rows, 'doc_id long, text string').repartition(8).write.parquet(str(tmp_path / 'documents.parquet'))
    return str(tmp_path)


def test_a_scan_has_short_tasks(spark, folder):
    sizes = Q.corpus(spark, folder).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 400
    assert max(sizes) <= 20


def test_a_scan_of_documents_has_short_tasks(spark, folder):
    found = QUERIES['scan_documents'](spark, folder)
    sizes = found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 400
    assert max(sizes) <= 20


def test_tasks_of_a_scan_grow_with_the_text(spark, tmp_path):
    """One file that holds much text is cut in more tasks than one that holds little."""
    pages = spark.range(64, numPartitions=1).selectExpr('id as page_id', "'http://h.io/a' as url", "repeat('x ', 200000) as html")
    pages.write.parquet(str(tmp_path / 'pages.parquet'))
    corpus = Q.corpus(spark, str(tmp_path))
    assert corpus.rdd.getNumPartitions() >= 64 * 400_000 / 2 ** 20
    assert corpus.count() == 64
    assert Q.corpus(spark, str(tmp_path)).limit(0).count() == 0


def test_a_folder_of_the_tree_is_one_tasks(spark, folder):
    there = set(Path(shared_folder(spark)).glob('tree-*'))
    rows = QUERIES['scan_code_files'](spark, folder).collect()
    assert sorted((r.page_id, r.n_chars) for r in rows) == [(i, len(f'<p>page {i}</p>') + 1) for i in range(400)]
    tree, = set(Path(shared_folder(spark)).glob('tree-*')) - there
    files = [str(f.relative_to(tree)) for f in tree.rglob('*.txt')]
    tasks = defaultdict(set)
    for f in files:
        place, _, name = f.split('/')
        tasks[place].add(re.match('part-([0-9]+)', name)[1])
    assert len(files) == 400
    assert len(tasks) <= 256 and {len(numbers) for numbers in tasks.values()} == {1}


def test_pages_are_dealt_out_as_they_are_read(spark, folder):
    """What makes source code of a page is no work of the task that reads it."""
    plan = Q.corpus(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert 'md5' in plan and 'RepartitionByExpression' in plan
    assert 'md5' not in plan[plan.index('RepartitionByExpression'):]
