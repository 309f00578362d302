"""Every query against its SQL, on the tables of the driver's correctness run."""

import math

import duckdb
import pytest

from lexiloom.registry import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return connection


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([round(r[k], 6) if isinstance(r[k], float) and not math.isnan(r[k]) else r[k] for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    found = QUERIES[name](spark, SF_DIR)
    rows = found.collect()
    assert rows
    if name in ORACLE_SQL:
        sql = db.execute(ORACLE_SQL[name])
        columns = [c[0] for c in sql.description]
        assert sorted(columns) == sorted(found.columns)
        assert _rows(found.columns, rows) == _rows(columns, sql.fetchall())


def test_last_status_of_users_with_ties(spark, tmp_path):
    rows = [(1, 5, 1, "a"), (3, 9, 1, "c"), (2, 9, 1, "b"), (4, 7, 2, "d"), (5, 7, 2, "e"), (6, 8, 2, "f"), (7, 1, 3, "g"), (7, 1, 3, "g")]
    spark.createDataFrame(rows, "event_id long, ts long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    found = QUERIES["last_status_by_key"](spark, str(tmp_path)).collect()
    assert sorted((r.user_id, r.event_type, r.ts) for r in found) == [(1, "c", 9), (2, "f", 8), (3, "g", 1)]


def test_numbers_at_line_ends(spark, tmp_path):
    spark.createDataFrame([(1, "12\n 3,5 word 7\t x12"), (2, "12\n")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["numeric_or_code_filter"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in found) == [(1, "12\n", 1), (1, "3,5", 1), (1, "7\t", 1), (2, "12\n", 1)]


@pytest.mark.parametrize("name", ["script_spans", "show_text_spans"])
def test_lines_that_begin_like_code(spark, tmp_path, name):
    """Lines of running text by the SQL's rule, whatever word they begin with: "this." is a word with its stop."""
    lines = ["this. | eaanst. | threwhha", "NULL", "nan", "const it", "async on", "functional", "if (x > 1) go", "new Things", "Math. 1", "a && b", "12 345", "-", "+1 2", "x != y", '=> "q"', "$x \\ y", "１２", "voice_"]
    rows = [(n, "\n".join(lines[n:] + lines[:n]), "en") for n in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found, connection = QUERIES[name](spark, str(tmp_path)), duckdb.connect()
    connection.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    sql = connection.execute(ORACLE_SQL[name])
    assert _rows(found.columns, found.collect()) == _rows([c[0] for c in sql.description], sql.fetchall())
