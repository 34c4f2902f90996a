import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from mooclens.session import builder

    b = builder("local[8]", 8).config("spark.sql.shuffle.partitions", "8")
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="mooclens-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def hot(spark):
    """Force the skew path of the ordered scans: every group with more
    than 3 rows counts as hot and is cut into up to 4 key ranges."""
    from mooclens.session import BUCKETS_KEY, HOT_ROWS_KEY

    spark.conf.set(HOT_ROWS_KEY, "3")
    spark.conf.set(BUCKETS_KEY, "4")
    yield spark
    spark.conf.unset(HOT_ROWS_KEY)
    spark.conf.unset(BUCKETS_KEY)
