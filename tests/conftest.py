import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.host": "127.0.0.1"}
    session = SparkSession.builder.master("local[6]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def oracle():
    """SQL on the tables of a scale, as sorted rows of text with the column names."""
    import duckdb

    def run(sf: str, sql: str):
        con = duckdb.connect()
        for name in os.listdir(f"{DATA}/{sf}"):
            con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{sf}/{name}'")
        return same_form(con.sql(sql).df())

    return run


def same_form(df):
    df = df[sorted(df.columns)]
    df = df.astype(object).where(df.notna(), None)
    plain = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    return list(df.columns), sorted(repr([plain(x.item() if hasattr(x, "item") else x) for x in row]) for row in df.values.tolist())
