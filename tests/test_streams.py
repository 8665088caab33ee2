"""Streaming state: that it begins with a history, ends, survives restarts, and that late rows reopen hours."""

import random
import time

import pytest
from pyspark.sql import functions as F

from chainsignals.operators import baseline, greedy
from chainsignals.streaming import jobs
from chainsignals.streaming.window_sum import WindowSum

HOUR = 3_600_000_000
#: Rows before 1970 would count as late.
START = 500_000 * HOUR
EVENT = "event_id long, chain string, pool string, type string, wallet string, us long, usd double"


def events(spark, rows):
    return spark.createDataFrame(rows, EVENT).withColumn("ts", F.timestamp_micros("us"))


def fed(spark, folder, *parts):
    """Write each part as files of their own and give the stream of the folder."""
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(parts[0].schema).parquet(f"{folder}/in")


def test_window_sum():
    rng = random.Random(2)
    own, queue = [], WindowSum()
    for _ in range(4000):
        if own and rng.random() < 0.48:
            own.pop(0)
            queue.popleft()
        else:
            own.append(rng.random() * 10 ** rng.randrange(0, 9))
            queue.append(own[-1])
        assert len(queue) == len(own) and queue.total == pytest.approx(sum(own), rel=1e-12)
    queue = WindowSum([1e16, 1.0])
    queue.popleft()
    assert queue.total == 1.0


def test_seeded_stream_goes_on_where_the_history_ends(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, "c", f"p{i % 3}", "swap", "w", int(i * HOUR / 4 + rng.random() * HOUR / 4), rng.random() * 100) for i in range(1200)]
    # one key has history only, one begins after it
    rows += [(5000 + i, "c", "old", "swap", "w", i * HOUR, 5.0 + i) for i in range(40)] + [(6000 + i, "c", "new", "swap", "w", (200 + i) * HOUR, 5.0 + i) for i in range(60)]
    half = 150 * HOUR + HOUR // 2
    ev = events(spark, rows)
    live = fed(spark, tmp_path, ev.where(F.col("us") >= half))
    got = jobs.run_once(jobs.seeded_score(ev.where(F.col("us") < half), live), f"{tmp_path}/out", f"{tmp_path}/cp")
    batch = baseline.score_events(ev, baseline.rolling_baseline(baseline.hourly_volume(ev))).where(F.col("us") >= half)
    want = {r.event_id: r.z for r in batch.collect()}
    found = {r.event_id: None if r.z != r.z else r.z for r in got.collect()}
    assert found.keys() == want.keys() and any(v is not None for v in want.values())
    assert all((found[k] is None) == (want[k] is None) and (want[k] is None or found[k] == pytest.approx(want[k], rel=1e-9)) for k in want)


def state_keys(spark, checkpoint, name):
    rows = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    return {tuple(r.key) for r in rows.select("key").distinct().collect()}


def test_cooldown_state_ends_with_the_cooldown(spark, tmp_path):
    first = events(spark, [(i, "c", f"p{i % 40}", "swap", "w", START + i * 60_000_000, 1.0) for i in range(80)])
    later = events(spark, [(100, "c", "p1", "swap", "w", START + 9 * HOUR, 1.0), (101, "c", "p1", "swap", "w", START + 9 * HOUR + 1, 1.0)])
    for part in (first, later):
        stream = fed(spark, tmp_path, part)
        rows = jobs.run_once(jobs.cooldown(stream, ("pool",), HOUR, ["event_id", "us"], late="10 minutes"), f"{tmp_path}/out", f"{tmp_path}/cp")
    batch = greedy.emit_with_cooldown(first.unionByName(later), ("pool",), HOUR)
    assert sorted(r.event_id for r in rows.collect()) == sorted(r.event_id for r in batch.collect())
    assert state_keys(spark, f"{tmp_path}/cp", "last") == {("p1",)}


def test_windows_of_idle_keys_leave_the_state(spark, tmp_path):
    rng = random.Random(7)
    # bursts of three events of a pool's wallets within an hour of their own
    rows = [(i, "c", f"p{i % 5}", "swap", f"w{rng.randrange(6)}", START + i // 15 * HOUR + i % 15 * 60_000_000, 50 + 400 * rng.random()) for i in range(1500)]
    more = [(9000 + i, "c", "p0", "swap", f"w{i}", START + 110 * HOUR + i * 1_000_000, 500.0) for i in range(4)]
    options = {"min_usd": 250.0, "limit": 0.5}
    for part in (rows, more):
        stream = fed(spark, tmp_path, events(spark, part))
        got = jobs.run_once(jobs.wallet_alerts(stream, late="10 minutes", **options), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert state_keys(spark, f"{tmp_path}/cp", "recent") == {("c", "p0", "swap")}
    assert len(state_keys(spark, f"{tmp_path}/cp", "baseline")) == 5
    # the same stream without timers
    plain = fed(spark, tmp_path / "plain", events(spark, rows + more))
    want = jobs.run_once(jobs.wallet_alerts(plain, **options), f"{tmp_path}/plain/out", f"{tmp_path}/plain/cp")
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 3


def _run_held(spark, folder, seconds, until=None, pause=0):
    """Run the delayed stream for at most so long, or until so many rows are out."""
    with jobs.rocksdb_state(spark):
        stream = spark.readStream.schema("id long, pool string, deliver_us long").parquet(f"{folder}/in")
        running = jobs.delayed(stream, ("pool",)).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(processingTime="1 second").start()
        end = time.time() + seconds
        while time.time() < end and running.isActive:
            out = released(spark, folder)
            if until is not None and len(out) >= until:
                break
            time.sleep(1)
        # let the batch end, so that none is left to be repeated after the restart
        time.sleep(pause)
        assert running.isActive, running.exception()
        running.stop()
    return released(spark, folder)


def released(spark, folder):
    try:
        return spark.read.parquet(f"{folder}/out").collect()
    except Exception:
        return []


def test_held_rows_leave_when_they_are_due_and_survive_a_restart(spark, tmp_path):
    now = int(time.time() * 1e6)
    soon, later = now - 1_000_000, now + 45_000_000
    rows = [(i, f"p{i % 3}", soon if i < 4 else later + i) for i in range(10)]
    spark.createDataFrame(rows, "id long, pool string, deliver_us long").write.parquet(f"{tmp_path}/in")
    out = _run_held(spark, tmp_path, 40, until=4, pause=6)
    assert sorted(r.id for r in out) == [0, 1, 2, 3]
    out = _run_held(spark, tmp_path, 100, until=10)
    assert sorted(r.id for r in out) == list(range(10))
    assert all(r.released_us >= r.deliver_us for r in out)


def test_late_rows_reopen_their_hours(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, "c", f"p{i % 2}", "swap", "w", rng.randrange(50) * HOUR + i, float(i)) for i in range(300)]
    parts = [[r for r in rows if r[0] % 3 == k] for k in range(3)]
    for k, part in enumerate(parts):
        stream = fed(spark, tmp_path, events(spark, part))
        jobs.hour_versions(stream, f"{tmp_path}/hours", f"{tmp_path}/cp").awaitTermination()
        versions = jobs.read_versions(spark, f"{tmp_path}/hours")
        so_far = events(spark, [r for p in parts[: k + 1] for r in p])
        want = {(r.pool, r.hour * HOUR): r.volume for r in baseline.hourly_volume(so_far).collect()}
        assert {(r.pool, r.hour_us): r.volume for r in jobs.current_hours(versions).collect()} == want
    changes = jobs.corrections(versions).collect()
    assert {r.op for r in changes} == {"insert", "retract", "replace"}
    net: dict = {}
    for r in changes:
        net[r.pool, r.hour_us] = net.get((r.pool, r.hour_us), 0.0) + (-r.volume if r.op == "retract" else r.volume)
    assert net == want
