import os
import signal
import sys
from pathlib import Path

import pytest

LIMIT = 900  # seconds that a test may take; one that hangs fails, and the others still run
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))
    session = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.hookimpl(wrapper=True)
def pytest_runtest_call(item):
    def late(*_):
        raise TimeoutError(f"{item.name} took more than {LIMIT} s")

    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(LIMIT)
    try:
        return (yield)
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)
