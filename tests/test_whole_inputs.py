"""Queries see all rows and whole sequences of the tables they name."""

import os

import pytest

import __spark_entry__ as entry
from strandlake.plans.views import query

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_all_documents_take_part(spark):
    docs = query(spark, SF, "SELECT doc_id FROM dna WHERE length(seq) > 0").count()
    assert entry.queries()["hmm_log_likelihood"](spark, SF).count() == docs
    long = query(spark, SF, "SELECT doc_id FROM dna WHERE length(seq) >= 11").count()
    assert entry.queries()["minimizer_index"](spark, SF).select("doc_id").distinct().count() >= long


def test_whole_sequences_take_part(spark):
    longest = query(spark, SF, "SELECT max(length(seq)) AS n FROM dna").first()["n"]
    assert longest > 400
    assert entry.queries()["state_segments"](spark, SF).agg({"stop": "max"}).first()[0] == longest
