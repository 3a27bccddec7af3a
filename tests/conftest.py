import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusward.plans.session import tuned  # noqa: E402

SMALL = '/root/testdata/sf0.001'
MEDIUM = '/root/testdata/sf0.01'


@pytest.fixture(scope='session')
def spark(tmp_path_factory):
    session = (tuned(SparkSession.builder.master('local[8]')).config('spark.sql.shuffle.partitions', '8')
               .config('spark.driver.memory', '6g').config('spark.ui.enabled', 'false')
               .config('spark.ui.showConsoleProgress', 'false')
               .config('spark.checkpoint.dir', str(tmp_path_factory.mktemp('shared'))).getOrCreate())
    session.sparkContext.setLogLevel('ERROR')
    yield session
    session.stop()


@pytest.fixture
def files(spark):
    def make(*texts, url='https://www.host.io/js/app.js'):
        rows = [(i, url, t) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, 'file_id long, url string, content string')
    return make
