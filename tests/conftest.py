import os
import sys

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")  # as the package does, before a test imports numpy

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from orbifold.session import session

    s = session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make_points(spark):
    """A DataFrame (id, vec, label) of arrays."""

    def make(x, labels=None):
        rows = [(i, [float(v) for v in row], None if labels is None else int(labels[i])) for i, row in enumerate(x)]
        return spark.createDataFrame(rows, "id long, vec array<double>, label long")

    return make
