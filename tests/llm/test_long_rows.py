from strandlake.llm import exact_dedup, quality_rules


def test_readers_hold_few_rows_at_once(spark, tmp_path):
    """A batch of the Parquet reader is bounded by rows only, so rows of long texts fill the memory."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    spark.createDataFrame([(k, f"text {k} " * 50, "en") for k in range(300)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for operator in (exact_dedup.keep_first_copies, quality_rules.keep_good):
        spark.conf.set(name, "4096")
        operator(docs).count()
        assert int(spark.conf.get(name)) <= 64
    spark.conf.set(name, "16")
    quality_rules.keep_good(docs).count()
    assert spark.conf.get(name) == "16"
    spark.conf.unset(name)
