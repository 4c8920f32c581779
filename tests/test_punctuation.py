"""Marks and their share of a text agree with SQL, also for texts without a character but blanks."""

import math

import check_queries as tool
import duckdb

import __spark_entry__ as entry_module

TEXTS = ["", " ", " \n\t\r ", None, "?!", " a, b. ", "a b", "«¿Qué?» — 、。", "x" * 3 + "."]


def test_blank_texts_agree_with_sql(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = entry_module.queries()["txt_04_punctuation_ratio"](spark, str(tmp_path))
    got = [tuple(r) for r in df.collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    sql = con.execute(entry_module.oracle_sql()["txt_04_punctuation_ratio"])
    assert tool.rows_of(df.columns, got) == tool.rows_of([d[0] for d in sql.description], sql.fetchall())
    found = {i: (marks, ratio) for i, marks, ratio in got}
    assert all(found[i][0] == 0 and math.isnan(found[i][1]) for i in range(3))
    assert found[3] == (None, None) and found[4] == (2, 1.0) and found[6] == (0, 0.0)
