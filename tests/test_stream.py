"""A real stream of files: late events count while the watermark lets them, and a finished window equals the batch's."""

import datetime as dt
import time

from pyspark.sql import functions as F

from alphaloom.streaming.bars import windowed_bars

SCHEMA = "ts timestamp, event_type string, value double, event_id long"


def test_bars_of_a_stream_with_late_events(spark, tmp_path):
    at = lambda day, hour: dt.datetime(2024, 1, day, hour)
    files = [
        [(at(1, 9), "a", 1.0, 1), (at(1, 12), "a", 3.0, 2), (at(2, 9), "b", 5.0, 3), (at(2, 9), None, None, 9)],
        [(at(1, 8), "a", 2.0, 4), (at(3, 1), "a", 7.0, 5)],  # the first is late by a day and still counts
        [(at(9, 1), "a", 9.0, 6)],  # moves the watermark to the 7th
        [(at(2, 10), "b", 99.0, 7)],  # too late
        [(at(20, 1), "a", 1.0, 8)],
    ]
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = windowed_bars(stream).writeStream.format("memory").queryName("late_bars").outputMode("append").option("checkpointLocation", str(tmp_path / "check"))
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"f{n}"))
        next((tmp_path / f"f{n}").glob("part-*.parquet")).rename(source / f"{n}.parquet")
        running = query.start() if n == 0 else running
        running.processAllAvailable()
    end = time.time() + 60
    while spark.table("late_bars").count() < 4 and time.time() < end:  # a batch without data closes the last windows
        time.sleep(0.5)
    running.stop()
    got = sorted(map(tuple, spark.table("late_bars").collect()))
    kept = spark.createDataFrame([r for f in files[:3] for r in f], SCHEMA)
    want = sorted(map(tuple, windowed_bars(kept).where(F.col("start") < "2024-01-19").collect()))
    assert got == want and [r[1:] for r in got] == [("a", 2.0, 3.0, 1.0, 3.0, 3), ("b", 5.0, 5.0, 5.0, 5.0, 1), ("a", 7.0, 7.0, 7.0, 7.0, 1), ("a", 9.0, 9.0, 9.0, 9.0, 1)]
