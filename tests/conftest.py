import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def check(spark, sf_dir):
    """Compare a registered query with its SQL on the same tables."""
    import math
    from decimal import Decimal

    import duckdb

    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
    con = duckdb.connect()
    for name in names.split():
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")

    def norm(v):
        if isinstance(v, Decimal):
            v = float(v)
        if isinstance(v, float):
            return None if math.isnan(v) else float(f"{v:.9g}")
        return int(v) if isinstance(v, int) else v

    def compare(build, sql):
        frame = build(spark, sf_dir)
        columns = sorted(frame.columns)
        got = sorted((tuple(norm(r[c]) for c in columns) for r in frame.collect()), key=repr)
        if not sql:
            return got
        answer = con.execute(sql)
        theirs = [c[0] for c in answer.description]
        assert sorted(theirs) == columns
        want = sorted((tuple(norm(r[theirs.index(c)]) for c in columns) for r in answer.fetchall()), key=repr)
        assert got == want
        return got

    return compare
