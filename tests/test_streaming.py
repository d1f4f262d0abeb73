from pyspark.sql import functions as F

from spanloom.streaming.live import answered_in_batches, coverage_windows, first_deliveries, score_batches, scored_with_retries


def test_stream_of_spans(spark, tmp_path):
    rows = [("s", 0.0, 5.0, "2025-01-01 00:00:01"), ("s", 0.0, 5.0, "2025-01-01 00:00:01"), ("s", 5.0, 9.0, "2025-01-01 00:11:00")]
    spark.createDataFrame(rows, "source_id string, start double, end double, t string").withColumn("t", F.to_timestamp("t")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source_id string, start double, end double, t timestamp").parquet(str(tmp_path / "in"))
    query = coverage_windows(first_deliveries(stream, ["source_id", "start"], "t"), "t", late=None).writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    assert query.exception() is None
    scores = score_batches(stream.select("source_id", "start"), lambda b: b.withColumn("score", F.lit(1.0)), str(tmp_path / "out"), str(tmp_path / "c2"))
    scores.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_rounds_of_scoring(spark):
    df = spark.createDataFrame([("s", i) for i in range(10)], "source_id string, ordinal int")
    sizes = []

    def scorer(left, size):
        sizes.append(size)
        return left.filter(F.col("ordinal") % 2 == 0) if size == 8 else left

    assert scored_with_retries(df, scorer, 8).count() == 10
    assert sizes == [8, 8, 8, 4]


def test_answers_of_batches(spark):
    """Accepted at 60 %; halved after three attempts; the best partial answer where both halves fail."""
    df = spark.createDataFrame([("s", i, i // 8, i % 8) for i in range(32)], "source_id string, ordinal int, batch_no int, place int")
    asked = []

    def ask(left, number):
        asked.append({r.node: r.n for r in left.groupBy("node").agg(F.count("*").alias("n")).collect()})
        o, p = F.col("ordinal"), F.col("place")
        good = (F.col("batch_no") == 0) & (p < 5)  # 5 of 8 are enough
        good = good | ((F.col("batch_no") == 1) & (number == 2))  # the third attempt
        good = good | ((F.col("batch_no") == 2) & ((number < 3) & (p <= number) | (F.col("node") == "2/0")))  # one half
        good = good | ((F.col("batch_no") == 3) & (number == 1) & (p < 3))  # never, but for 3 of 8 once
        return left.filter(good).select("source_id", "node", "ordinal")

    found = sorted(r.ordinal for r in answered_in_batches(df, ask).collect())
    assert found == [*range(5), *range(8, 16), *range(16, 20), 24, 25, 26]
    assert asked[0] == {"0/": 8, "1/": 8, "2/": 8, "3/": 8} and asked[1] == {"1/": 8, "2/": 8, "3/": 8} and asked[3] == {"2/0": 4, "2/1": 4, "3/0": 4, "3/1": 4}
    assert set(asked[-1]) == {"2/10", "2/11", "3/00", "3/01", "3/10", "3/11"}
