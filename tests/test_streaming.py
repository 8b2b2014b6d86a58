"""Streams of a few files, run to their end."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from assayer.streaming import scan_cycle, windows

SCAN = "device string, scan_no long, elapsed_ms long, command boolean, permissive boolean, stop boolean, interlock boolean, pulse boolean, reset boolean"


def finished(stream, name, mode="append", tmp=None):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp)).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_drive_scans_keep_state_between_batches(spark, tmp_path):
    t, f = True, False
    batches = [[("d", 1, 40, t, t, f, t, t, f), ("d", 2, 60, t, t, f, t, f, f)], [("d", 3, 10, f, t, f, t, t, f), ("d", 2, 99, f, f, t, f, f, f)], [("d", 4, 10, f, t, t, t, t, t), ("d", 5, 10, t, f, f, t, t, f)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCAN).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", scan_cycle.ROCKSDB)
    try:
        stream = spark.readStream.schema(SCAN).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in" / "*"))
        finished(scan_cycle.drive_scans(stream, 100), "drive", tmp=tmp_path / "state")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    found = [tuple(r)[1:] for r in spark.table("drive").orderBy("scan_no").collect()]
    assert found == [(1, t, t, 40, f, 0), (2, t, f, 100, t, 0), (3, t, f, 0, f, 1), (4, f, f, 0, f, 0), (5, f, t, 10, f, 1)]


def test_windows_and_sessions(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, "a" if i % 2 else "b", start + timedelta(minutes=m)) for i, m in enumerate((0, 1, 2, 11, 12, 45, 300, 600))]
    spark.createDataFrame(rows, "id int, kind string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("id int, kind string, ts timestamp").parquet(str(tmp_path / "in"))
    finished(windows.windowed(read(), "ts", "5 minutes", "10 minutes", ["kind"], [F.count("id").alias("n")]), "tumbling", "complete", tmp_path / "c1")
    assert {(r["window_start"].minute, r["kind"], r["n"]) for r in spark.table("tumbling").where("window_start < '2024-01-01 00:20:00'").collect()} == {(0, "a", 1), (0, "b", 2), (10, "a", 1), (10, "b", 1)}
    finished(windows.sessions(read().withColumn("all", F.lit(1)), "ts", "5 minutes", "15 minutes", ["all"], [F.count("id").alias("n")]), "sessions", "complete", tmp_path / "c2")
    assert sorted(r["n"] for r in spark.table("sessions").collect()) == [1, 1, 1, 5]
    finished(windows.first_seen(read(), "ts", "20 hours", ["kind"]), "first", tmp=tmp_path / "c3")
    assert spark.table("first").count() == 2
