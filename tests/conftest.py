import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from checks.session import local_session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
AS_OF = datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    return local_session("8")


@pytest.fixture(scope="session")
def fact(spark):
    from tallyhouse.session import materialize
    from tallyhouse.sources import warehouse
    return materialize(warehouse.retail_fact(spark, FOLDER), "fact")


@pytest.fixture(scope="session")
def dirty(spark):
    from tallyhouse.session import materialize
    from tallyhouse.sources import warehouse
    return materialize(warehouse.retail_dirty(spark, FOLDER), "dirty")


def column(df):
    return [row[0] for row in df.collect()]
