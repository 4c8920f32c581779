"""One Latin-1 misreading is undone whatever the script, and texts that were read rightly stay."""

import check_queries as tool
import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from chartspark.functions import clean

TEXTS = ["Ändern", "ÄÃÂ", "EINÄ!!", "가나다", "š", "5 €", "naïve Ä", "plain", "", None, "日本 Ä", "�"]


def test_every_text_agrees_with_sql(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = entry_module.queries()["prj_13_mojibake"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    expected = con.execute(entry_module.oracle_sql()["prj_13_mojibake"]).fetchall()
    assert tool.rows_of(df.columns, [tuple(r) for r in df.collect()]) == tool.rows_of(["doc_id", "suspicious", "repaired"], expected)


def test_texts_read_rightly_stay(spark):
    right = ["café", "Ä", "Ändern", "d’or", "가나", "plain"]
    df = spark.createDataFrame([(t,) for t in right], "t string")
    assert [r[0] for r in df.select(clean.redecode_latin1("t")).collect()] == right
