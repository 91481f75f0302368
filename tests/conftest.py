import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def oracle():
    """Runs DuckDB SQL over the smallest tables; gives sorted rows by sorted column names."""
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")

    def run(sql: str) -> tuple[list[str], list[tuple]]:
        found = connection.execute(sql)
        names = [d[0] for d in found.description]
        return in_order(names, found.fetchall())

    return run


def in_order(names: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    by_name = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(round(v, 9) if isinstance(v := row[i], float) else v for i in by_name) for row in rows]
    return [names[i] for i in by_name], sorted(plain, key=repr)
