"""Tables as streams: one file, a folder of several, or one with folders by column."""

import duckdb
import pytest

from tests.test_queries import plain
from weirgate.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize(("name", "table", "by"), [("stream_inspect_conversations", "conversations", ()), ("stream_inspect_conversations", "conversations", ("role",)), ("stream_frequency_available", "events", ())])
def test_table_in_several_files(spark, small, tmp_path, name, table, by):
    """The same rows as of one file: large tables are folders."""
    spark.read.parquet(f"{small}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet", partitionBy=by)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    assert plain(QUERIES[name](spark, str(tmp_path)).toPandas()) == plain(duck.sql(ORACLE_SQL[name]).df())
