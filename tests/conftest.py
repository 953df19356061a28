import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.sql.warehouse.dir", str(shared / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Lines as a LineFrame; ``parts``: over how many partitions."""
    from lineloom.operators.frame import LineFrame

    def make(lines, parts=1):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "at long, value string")
        return LineFrame.of(df.repartition(parts, "value") if parts > 1 else df, "at")

    return make


@pytest.fixture
def lines():
    """The lines of a LineFrame, in order."""
    return lambda f: [r[0] for r in f.lines().collect()]
