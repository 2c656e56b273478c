import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rowwarden.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        4, app="tests", **{
            "spark.sql.shuffle.partitions": "4",
            "spark.default.parallelism": "4",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
            "spark.driver.memory": "4g",
        })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def warehouse(spark, tmp_path_factory):
    """The generated warehouse at scale 1, stored and read back."""
    from rowwarden.sources import warehouse as source
    from rowwarden.sources.tables import load_frames, parquet_reader

    root = str(tmp_path_factory.mktemp("warehouse"))
    source.write_warehouse(source.generate(spark), root)
    return load_frames(spark, source.registry(), parquet_reader(root))


@pytest.fixture
def no_broadcast(spark):
    """Every size check says no, so joins take the path for large sides."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
