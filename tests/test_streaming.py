import datetime as dt

from tidewright.operators.windows import transitions
from tidewright.streaming import online


def test_online_transitions_equal_the_batch(spark, tmp_path):
    rows = [(u, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), "abc"[(i * (u + 2)) // 3 % 3]) for i in range(30) for u in (1, 2)]
    kind = "user_id int, ts timestamp, event_type string"
    for k, part in enumerate((rows[:30], rows[30:])):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    for k in (0, 1):
        for p in (tmp_path / f"in/{k}").glob("*.parquet"):
            (tmp_path / "src").mkdir(exist_ok=True)
            p.rename(tmp_path / f"src/{k}.parquet")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
    q = online.online_transitions(stream, "user_id", "ts", "event_type").writeStream.format("memory").queryName("moves").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["label"], r["next"]): r["n"] for r in spark.sql("select label, next, count(*) n from moves group by 1, 2").collect()}
    batch = {(r["history"][0], r["next"]): r["n"] for r in transitions(spark.createDataFrame(rows, kind), ["user_id"], ["ts"], "event_type").collect()}
    assert got == batch


def test_windowed_mean(spark, tmp_path):
    d = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 10), "a", 1.0), (dt.datetime(2024, 1, 1, 0, 50), "a", 3.0), (dt.datetime(2024, 1, 1, 5), "a", 9.0)], "ts timestamp, k string, v double")
    d.write.parquet(str(tmp_path / "w"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "w"))
    q = online.windowed_mean(s, "ts", ["k"], "v").writeStream.format("memory").queryName("means").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["n"], r["mean"]) for r in spark.sql("select * from means").collect()] == [(2, 2.0)]


def test_online_transitions_of_late_rows(spark, tmp_path):
    begin = dt.datetime(2024, 1, 1)
    rows = [(u, begin + dt.timedelta(hours=6 * i, microseconds=1), "abc"[(i * (u + 2)) // 3 % 3]) for i in range(24) for u in (1, 2)]
    # Days late and out of order; the last rows only move the watermark.
    late = [rows[i] for i in (*range(8, 16), *range(8), *range(40, 28, -1), *range(16, 29), *range(41, 48))] + [(3, begin + dt.timedelta(days=30), "a")]
    kind = "user_id int, ts timestamp, event_type string"
    (tmp_path / "src").mkdir()
    for k in range(0, len(late), 9):
        spark.createDataFrame(late[k : k + 9], kind).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        for p in (tmp_path / f"in/{k}").glob("*.parquet"):
            p.rename(tmp_path / f"src/{k:03d}.parquet")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
    q = online.online_transitions(stream, "user_id", "ts", "event_type", late="7 days").writeStream.format("memory").queryName("late_moves").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["label"], r["next"]): r["n"] for r in spark.sql("select label, next, count(*) n from late_moves group by 1, 2").collect()}
    batch = {(r["history"][0], r["next"]): r["n"] for r in transitions(spark.createDataFrame(rows, kind), ["user_id"], ["ts"], "event_type").collect()}
    assert got == batch
