"""Every registered query of the main package against its SQL oracle, on the smallest tables."""

import os

import duckdb
import pytest

from oligoflow.plans import registry

SF = "/root/testdata/sf0.001"
QUICK = sorted(registry.ORACLES)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_oracle(spark, duck, tmp_path, name):
    path = str(tmp_path / "r")
    registry.QUERIES[name](spark, SF).write.parquet(path)
    duck.execute(f"CREATE OR REPLACE TEMP TABLE o AS {registry.ORACLES[name]}")
    duck.execute(f"CREATE OR REPLACE TEMP TABLE r AS SELECT * FROM '{path}/*.parquet'")
    columns = sorted(x[0] for x in duck.sql("DESCRIBE r").fetchall())
    assert columns == sorted(x[0] for x in duck.sql("DESCRIBE o").fetchall())
    c = ", ".join(f'"{x}"' for x in columns)
    for a, b in (("o", "r"), ("r", "o")):
        assert duck.sql(f"SELECT {c} FROM {a} EXCEPT ALL SELECT {c} FROM {b} LIMIT 3").fetchall() == []
    assert duck.sql("SELECT count(*) FROM r").fetchall()[0][0] > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["ID", "Rank", "Reads", "RPU", "length", "sequences"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
