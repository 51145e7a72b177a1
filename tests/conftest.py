import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    import tempfile
    from cubewright.session import get_spark
    wh = tempfile.mkdtemp(prefix="cubewright-warehouse-")
    s = get_spark("local[4]", shuffle_partitions=4, extra={"spark.sql.warehouse.dir": wh})
    yield s


@pytest.fixture
def tmp(tmp_path):
    return str(tmp_path)
