import pytest


@pytest.fixture
def documents(spark):
    def make(*texts, **columns):
        rows = [(i, t, *(v[i] for v in columns.values())) for i, t in enumerate(texts)]
        kinds = ''.join(f', {name} string' for name in columns)
        return spark.createDataFrame(rows, f'doc_id long, text string{kinds}')
    return make


@pytest.fixture
def labels(spark):
    def make(*rows):
        return spark.createDataFrame(list(rows), 'doc_id long, quality int, toxic int')
    return make
