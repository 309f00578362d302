import duckdb
import pytest

from lexiloom.llm.queries import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_and_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        db.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    found, sql = QUERIES[name](spark, SF_DIR), db.sql(ORACLE_SQL[name])
    rows = sorted(map(tuple, found.select(sorted(found.columns)).collect()), key=str)
    assert sorted(found.columns) == sorted(sql.columns)
    assert rows == sorted(sql.select(",".join(f'"{c}"' for c in sorted(sql.columns))).fetchall(), key=str) and rows
