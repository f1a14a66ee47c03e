from tablewarden.streaming.scorecards import completeness_stream, scorecard_stream


def test_counts_of_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    for part in ([(1, "a"), (2, None)], [(3, "N/A"), (4, "b"), (5, "")]):
        spark.createDataFrame(part, "id long, v string").coalesce(1).write.mode("append").parquet(src)
    seen = []
    stream = spark.readStream.schema("id long, v string").option("maxFilesPerTrigger", 1).parquet(src)
    q = completeness_stream(stream, "id", lambda df, i: seen.extend((i, *r) for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sum(t for _, c, _, t in seen if c == "v") == 5 and sum(m for _, c, m, _ in seen if c == "v") == 3
    assert len({i for i, *_ in seen}) == 2


def test_scorecard_of_each_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    for part in ([(1, "5"), (2, "7")], [(3, "N/A"), (4, "6"), (5, None), (6, "8")]):
        spark.createDataFrame(part, "id long, price string").coalesce(1).write.mode("append").parquet(src)
    seen = {}
    stream = spark.readStream.schema("id long, price string").option("maxFilesPerTrigger", 1).parquet(src)
    scorecard_stream(stream, "id", lambda r, i: seen.update({i: (r.table.n_rows, r.scorecard.columns["price"]["completeness"])}), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen.values()) == [(2, 100.0), (4, 50.0)]
