import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(frame):
    columns = sorted(frame.columns)

    def plain(v):
        if v is None or str(v) in ("<NA>", "nan", "NaT"):
            return None
        if hasattr(v, "tolist"):
            v = v.tolist()
        return round(v, 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted((tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="session")
def same():
    def check(spark_frame, duck_frame):
        assert sorted(spark_frame.columns) == sorted(duck_frame.columns)
        assert rows(spark_frame) == rows(duck_frame)

    return check
