from tissuelake.streaming.ingest import ingest_available


def test_files_are_ingested_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    spark.range(10).coalesce(1).write.parquet(src)
    ingest_available(spark, src, "id long", out, ck)
    spark.range(10, 15).coalesce(1).write.mode("append").parquet(src)
    ingest_available(spark, src, "id long", out, ck)
    assert sorted(r[0] for r in spark.read.parquet(out).collect()) == list(range(15))
