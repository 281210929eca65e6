import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from storyframe.session import HOT_ROWS_CONF, build_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
           "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["plain", "hot"])
def sizes(spark, request):
    """Run a test twice: with the plain plans, and with every group of more than three rows split."""
    if request.param == "hot":
        spark.conf.set(HOT_ROWS_CONF, "3")
    yield request.param
    spark.conf.unset(HOT_ROWS_CONF)
