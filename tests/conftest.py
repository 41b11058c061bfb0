import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="inventra-test-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


def frame_of(rel):
    """Rows of a DuckDB result or a Spark DataFrame as sorted tuples of texts, so both compare."""
    import pandas as pd

    df = rel if isinstance(rel, pd.DataFrame) else rel.toArrow().to_pandas()
    df = df[sorted(df.columns)]

    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and pd.isna(v):
            return "null"
        if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
            return str(bool(v))
        if isinstance(v, float):
            return str(int(v)) if v == int(v) else repr(round(v, 9))
        return str(v)

    return list(df.columns), sorted(tuple(text(v) for v in row) for row in df.itertuples(index=False, name=None))
