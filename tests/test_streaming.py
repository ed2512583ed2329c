"""Streams over the smallest tables."""

from pyspark.sql import functions as F

from arborlake.streaming import queue


def test_drained_stream_has_every_row(spark, sf_dir, tmp_path):
    stream = queue.events_stream(spark, sf_dir).select("event_id")
    rows = queue.drained(stream, str(tmp_path / "all"))
    assert rows.count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()
    # a second run over the same input finds nothing new
    assert queue.drained(stream, str(tmp_path / "all")).count() == rows.count()


def test_late_windows_stay_open(spark, sf_dir, tmp_path):
    rows = queue.drained(queue.windowed(queue.events_stream(spark, sf_dir)), str(tmp_path / "hours"))
    last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("ts").cast("timestamp")).first()[0]
    assert rows.where(F.col("hour") + F.expr("interval 3 hours") > F.lit(last)).isEmpty()
    assert rows.count() > 0


def test_enqueue_keeps_the_first_status(spark):
    old = spark.createDataFrame([(1, 7, 2, "completed")], "run_id long, source_id long, link_depth int, status string")
    new = spark.createDataFrame([(1, 7, 1), (1, 8, 0)], "run_id long, source_id long, link_depth int")
    found = {tuple(r) for r in queue.enqueue(old, new).collect()}
    assert found == {(1, 7, 1, "completed"), (1, 8, 0, "pending")}


def test_retry_delays(spark):
    rows = spark.createDataFrame([(n,) for n in range(4)], "retries int").withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    out = queue.after_failure(rows).orderBy("retries").collect()
    assert [r["status"] for r in out] == ["retry"] * 3 + ["failed"]
    assert [(r["next_attempt_at"] - r["created_at"]).seconds for r in out[:3]] == [60, 120, 240]


def test_connector(spark):
    from arborlake.sources import connectors

    rows = connectors.paged(spark, "tests.fake_service.Client", pagesize="3", total="8").collect()
    assert sorted(int(r["doc_id"]) for r in rows) == list(range(8))


def test_paged_source_pushes_filters(spark, tmp_path):
    from arborlake.sources import connectors

    log = tmp_path / "log"
    old = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = connectors.paged(spark, "tests.fake_service.Filtering", pagesize="4", log=str(log)).where("doc_type = 'b' AND content <> '3'").collect()
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", old)
    assert sorted(int(r["doc_id"]) for r in rows) == [1, 5, 7, 9, 11, 13, 15, 17, 19]
    asked = log.read_text().splitlines()
    assert len(asked) == 3 and all(a.startswith("[('doc_type', '=', 'b')]") for a in asked)


def test_paged_stream_reads_each_item_once(spark, tmp_path):
    from arborlake.sources import connectors

    count, out = tmp_path / "count", str(tmp_path / "out")
    for n, seen in ((7, 7), (7, 7), (18, 18)):
        count.write_text(str(n))
        stream = connectors.paged_stream(spark, "tests.fake_service.Growing", pagesize="5", count=str(count))
        query = stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/at").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert sorted(int(r["doc_id"]) for r in spark.read.parquet(f"{out}/data").collect()) == list(range(seen))
