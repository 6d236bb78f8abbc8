"""The streaming outbox gives what the batch fold gives."""

import pytest
from pyspark.sql import functions as F

from cairn.operators import state
from cairn.streaming import outbox

SCHEMA = "event_id string, seq long, cmd string, at long, token string, error string, reconcile boolean"


def test_stream_equals_batch(spark, tmp_path):
    rows = [("e1", 1, "insert", 0, None, None, False), ("e2", 1, "insert", 0, None, None, False), ("e1", 2, "claim", 1, "t", None, False), ("e1", 3, "retry", 2, "t", "x", False), ("e2", 2, "claim", 3, "u", None, False), ("e1", 4, "claim", 40, "v", None, False), ("e1", 5, "complete", 41, "v", None, False)]
    source, out = tmp_path / "in", tmp_path / "out"
    for k, part in enumerate((rows[:3], rows[3:5], rows[5:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        stream = outbox.outbox(spark.readStream.schema(SCHEMA).parquet(str(source)))
        query = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(str(out))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(out)).collect())
    want = sorted(tuple(r) for r in state.outbox(spark.createDataFrame(rows, SCHEMA)).collect())
    assert [g[:6] for g in got] == [w[:6] for w in want]


def test_windows_drop_late_rows(spark, tmp_path):
    spark.sql("SELECT timestamp'2026-01-01 00:05:00' AS ts, 1 AS page, 'a' AS set_fp UNION ALL SELECT timestamp'2026-01-01 00:06:00', 1, 'b'").write.parquet(str(tmp_path / "v"))
    schema = "ts timestamp, page int, set_fp string"
    df = outbox.observation_windows(spark.readStream.schema(schema).parquet(str(tmp_path / "v")))
    query = df.writeStream.outputMode("complete").format("memory").queryName("visits").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r["page"], r["n_visits"], r["n_sets"]) for r in spark.sql("SELECT * FROM visits").collect()] == [(1, 2, 2)]


@pytest.fixture
def timers(spark):
    before = spark.conf.get(outbox.STORE[0], None)
    spark.conf.set(*outbox.STORE)
    yield
    spark.conf.unset(outbox.STORE[0]) if before is None else spark.conf.set(outbox.STORE[0], before)


def run_parts(spark, folder, schema, parts, transform):
    """Rows that a stream gives for parts of its input, one run on the same checkpoint for each."""
    for part in parts:
        rows = spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds("at"))
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = transform(spark.readStream.schema(f"{schema}, ts timestamp").parquet(f"{folder}/in"))
        query = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(f"{folder}/out")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect()), key=str)


def test_only_time_frees_a_claim(spark, timers, tmp_path):
    other = [(f"o{i}", 1, "insert", at, None, None, False) for i, at in enumerate((1100, 1101, 1200, 1201))]
    first = [("e1", 1, "insert", 1000, None, None, False), ("e1", 2, "claim", 1001, "t", None, False), ("e2", 1, "insert", 1000, None, None, False), ("e2", 2, "claim", 1002, "u", None, False), ("e2", 3, "complete", 1003, "u", None, False)]
    last = [("e1", 3, "complete", 1202, "t", None, False), ("e1", 4, "claim", 1203, "v", None, False)]
    got = run_parts(spark, tmp_path, SCHEMA, (first, other[:1], other[1:2], other[2:], last), outbox.expiring_outbox)
    # The batch form with a row of the clock at the end of the lease; nothing of e1 had come in between.
    clock = [("e1", 3, "clock", 1061, None, None, False)]
    moved = [(k, s + 1 if k == "e1" else s, *rest) for k, s, *rest in last]
    want = [tuple(r) for r in state.outbox(spark.createDataFrame(first + other + clock + moved, SCHEMA)).collect()]
    want = [(k, None if cmd == "clock" else s - (k == "e1" and s > 3), cmd, *rest) for k, s, cmd, *rest in want]
    assert got == sorted(want, key=str)
    freed = next(r for r in got if r[2] == "clock")
    assert freed[:5] == ("e1", None, "clock", "EXPIRED", "RETRY") and sum(r[2] == "clock" for r in got) == 1
    assert [r[3] for r in got if r[0] == "e1" and r[2] in ("complete", "claim")] == ["OK", "LEASE_LOST", "OK"]


def test_the_last_attempt_and_leases_end_by_time(spark, timers, tmp_path):
    schema = "portal_id string, seq long, cmd string, owner string, at long, ttl long, generation long, baseline string"
    first = [("p", 1, "acquire", "a", 1000, 50, None, None), ("q", 1, "acquire", "a", 1000, 50, None, None), ("q", 2, "renew", "a", 1040, 500, 1, None)]
    later = [("r", 1, "acquire", "c", 1100, 1000, None, None)], [("s", 1, "acquire", "c", 1110, 1000, None, None)], [("p", 2, "renew", "a", 1120, 50, 1, None), ("p", 3, "acquire", "b", 1121, 50, None, None)]
    got = run_parts(spark, tmp_path, schema, (first, *later), outbox.expiring_leases)
    rows = {(r[0], r[2], r[1]): r for r in got}
    assert rows["p", "clock", None][3:6] == ("EXPIRED", None, 1) and not any(k[0] == "q" and k[1] == "clock" for k in rows)
    assert rows["p", "renew", 2][3] == "LEASE_LOST" and rows["p", "acquire", 3][3:6] == ("OK", "b", 2)


def test_expiry_changes_nothing_that_commands_can_see():
    for attempts in range(1, state.MAX_ATTEMPTS + 1):
        for cmd, token in (("claim", "v"), ("complete", "t"), ("renew", "t"), ("retry", "t")):
            lazy = state.Outbox("IN_FLIGHT", attempts, 5, 61, "t")
            eager = state.Outbox("IN_FLIGHT", attempts, 5, 61, "t")
            assert eager.expire(60) == "NOT_DUE" and eager.expire(61) == "EXPIRED" and eager.expire(62) == "NOT_DUE"
            assert lazy.step(cmd, 70, token, None, False) == eager.step(cmd, 70, token, None, False)
            if cmd == "claim":
                assert (lazy.status, lazy.attempts, lazy.lease_until, lazy.token) == (eager.status, eager.attempts, eager.lease_until, eager.token)
