import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    root = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{root}/shared").config("spark.sql.warehouse.dir", f"{root}/warehouse")
        .config("spark.driver.extraJavaOptions", f"-Dderby.system.home={root}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}{'/*.parquet' if t.is_dir() else ''}'")
    return con


def plain(rows):
    """Rows as sorted text, floats to six places."""
    return sorted(str(tuple("~" if x is None else round(x, 6) if isinstance(x, float) else str(x) for x in r)) for r in rows)


def same(df, con, sql):
    names = sorted(df.columns)
    got = con.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({sql})")
    assert plain(df.select(*names).collect()) == plain(got.fetchall())
