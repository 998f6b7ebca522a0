"""Summaries of bodies that the given documents do not hold."""

import duckdb
import pytest

from atrium.functions import scalars
from atrium.plans import record_queries

#: A text and its summary.
TEXTS = {"": "", "   ": "", "\u3000駅  構内\u3000": "駅 構内", "\u00a0a\tb\u2003": "a b", "x" * 81: "x" * 80 + "…", "𠮷" * 80: "𠮷" * 80, "𠮷" * 81: "𠮷" * 80 + "…", "a (b\nc)": "a (b"}


def test_summaries_of_odd_texts_equal_sql(spark, tmp_path):
    rows = [*enumerate(TEXTS), (len(TEXTS), None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.summary for r in record_queries.markdown_summary(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(con.execute(record_queries.ORACLES["markdown_summary"]).fetchall())
    assert [got[n] for n in range(len(TEXTS))] == list(TEXTS.values()) and got[len(TEXTS)] is None


@pytest.mark.parametrize("body, summary", [("![a](b\nc) d", "![a](b"), ("![a](b)\r\n\r c", "c"), ("![a](b)", "")])
def test_summaries_of_bodies(spark, body, summary):
    frame = spark.createDataFrame([(body,)], "body string")
    assert frame.select(scalars.markdown_summary(frame.body)).collect()[0][0] == summary
