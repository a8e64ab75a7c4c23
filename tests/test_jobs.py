from datetime import UTC, datetime, timedelta

from pagegrain.operators import catalog
from pagegrain.streaming import event_stream
from pagegrain.streaming.jobs import outcomes

SCHEMA = "job string, ts timestamp, status string"
START = datetime(2026, 1, 1, tzinfo=UTC)


def put(spark, folder, rows):
    spark.createDataFrame([(j, START + timedelta(seconds=s), x) for j, s, x in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def go(spark, folder, out, checkpoint):
    """Reads what is there, in batches of a file, and stops."""
    stream = outcomes(event_stream(spark, folder, SCHEMA))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(120)


def found(spark, out):
    rows = spark.read.parquet(out).collect()
    return sorted((r["job"], r["outcome"], r["attempts"], int(r["at"].replace(tzinfo=UTC).timestamp() - START.timestamp())) for r in rows)


def test_outcomes_over_a_restart(spark):
    folder, out, checkpoint = (catalog.shared_folder(spark) for _ in range(3))
    put(spark, folder, [("good", 0, "in progress"), ("bad", 0, "queued"), ("slow", 0, "running"), ("many", 0, "x"), ("once", 1, "DONE"), (None, 1, "done")])
    put(spark, folder, [("good", 1, None), ("bad", 2, "Failed"), ("many", 1, "x"), ("once", 3, "failed")])
    go(spark, folder, out, checkpoint)
    assert found(spark, out) == [("bad", "failure", 2, 2), ("once", "success", 1, 1)]
    # A restart: counts go on, what follows an outcome is ignored.
    put(spark, folder, [("good", 5, "Succeeded"), ("bad", 6, "done"), ("once", 7, "done"), *(("many", 2 + i, "x") for i in range(12))])
    go(spark, folder, out, checkpoint)
    assert found(spark, out) == [("bad", "failure", 2, 2), ("good", "success", 3, 5), ("many", "timeout", 12, 11), ("once", "success", 1, 1)]
    # Time runs out for the slow one; a job whose next poll comes too late is out of time as well, and a poll behind the watermark counts for nothing.
    put(spark, folder, [("late", 50, "x"), ("clock", 100, "x")])
    put(spark, folder, [("late", 129, "done"), ("clock", 140, "ok")])
    put(spark, folder, [("slow", 3, "done"), ("clock", 400, "x")])
    put(spark, folder, [("other", 401, "ok")])
    go(spark, folder, out, checkpoint)
    got = found(spark, out)
    assert [r for r in got if r[0] in ("slow", "late", "clock", "other")] == [("clock", "success", 2, 140), ("late", "timeout", 1, 128), ("other", "success", 1, 401), ("slow", "timeout", 1, 78)]
    assert len(got) == 8
