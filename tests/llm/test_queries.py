"""Queries of this subpackage: those with SQL give the same rows as DuckDB, the others one row for each that their contract names."""

import os

import pytest
from oracle import connect, difference

from strandlake.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
ROW_FOR_ROW = {"op2_line_dedup": "documents", "op3_bpe_codec": "documents", "op5_quality_rules": "documents", "op7_simhash": "documents", "op8_html_text": "pages", "op9_quality_classifier": "documents", "op10_token_files": "documents"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    if name in queries.ORACLE_SQL:
        assert difference(df, connect(SF), queries.ORACLE_SQL[name]) is None
    elif name in ROW_FOR_ROW:
        assert df.count() == spark.read.parquet(f"{SF}/{ROW_FOR_ROW[name]}.parquet").count()
    else:
        assert df.groupBy("doc_id").count().count() == spark.read.parquet(f"{SF}/documents.parquet").count()
