import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from ledgerlens.session import local_session

    s = local_session(
        master="local[*]",
        shuffle_partitions=8,
        checkpoint_dir=str(tmp_path_factory.mktemp("checkpoints")),
    )
    yield s
    s.stop()


@pytest.fixture(scope="module", autouse=True)
def nothing_stays_cached():
    """Plans of later modules would read a table that this one has cached."""
    yield
    from pyspark.sql import SparkSession

    s = SparkSession.getActiveSession()
    if s is not None:
        s.catalog.clearCache()


@pytest.fixture
def make_ct(spark):
    """Build a customer_transactions frame from a few hand-made rows given
    as dicts; missing columns are NULL, cid/tid default to a counter."""
    from ledgerlens.schema import CT_COLUMNS, CT_SCHEMA

    def build(rows):
        full = []
        for i, r in enumerate(rows):
            d = {c: None for c in CT_COLUMNS}
            d["cid"] = i
            d["tid"] = i
            d.update(r)
            full.append(tuple(d[c] for c in CT_COLUMNS))
        return spark.createDataFrame(full, CT_SCHEMA)

    return build
