"""Read lengths against known values."""

from strandlake.operators import abundance as ab
from strandlake.plans.views import query


def test_n50_of_groups_with_nulls(spark):
    rows = [("x", 10), ("x", 6), ("x", 4), ("x", None), (None, 3), (None, 3), (None, 9), ("y", None), ("z", 0)]
    got = {(r.lang, r.n50) for r in ab.n50(spark.createDataFrame(rows, "lang string, len int"), "len", ["lang"]).collect()}
    assert got == {("x", 10), (None, 9), ("z", 0)}
    assert [r.n50 for r in ab.n50(spark.createDataFrame([(5,), (4,)], "len int"), "len", []).collect()] == [5]


def test_dealt_out_documents_keep_their_columns(spark, tmp_path):
    spark.createDataFrame([(1, "ab", "en", "web", 2)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in query(spark, str(tmp_path), "SELECT lang, source, n_chars FROM documents").collect()] == [("en", "web", 2)]
    plan = query(spark, str(tmp_path), "SELECT doc_id FROM documents")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan
