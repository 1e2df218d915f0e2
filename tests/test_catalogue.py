"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math

import duckdb
import pytest

from wordloom.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else round(float(v), 6)
    return v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    cur = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    want = sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_read_every_line(spark, small):
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    assert not any("l_quantity" in sql for sql in ORACLE_SQL.values())
    assert sum(r["score"] for r in QUERIES["score_gcf"](spark, small).collect()) == lines.count()
    assert sum(r["n_images"] for r in QUERIES["class_sizes"](spark, small).collect()) == lines.select("l_orderkey").distinct().count()


def test_sparse_classes_leave_cells_empty(spark, small):
    rows = QUERIES["score_ced_sparse"](spark, small).collect()
    assert sum(r["df"] == 0 for r in rows) > 100 < sum(r["df"] > 0 for r in rows)
    assert all(r["score"] == 0 for r in rows if r["df"] <= 1)
