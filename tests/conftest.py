import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from perilake.plans.medallion import open_lake  # noqa: E402
from perilake.session import build_session, shared_root  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    shared_root(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lake(spark):
    return open_lake(spark, SMALL)


def values(df, *names):
    return [tuple(r) for r in (df.select(*names) if names else df).collect()]
