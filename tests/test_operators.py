"""Scenarios of single operators on small tables."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chainsignals.functions import keccak, payloads, texts, words
from chainsignals.operators import baseline, billing, classify, greedy, matching, multiwallet, outcomes, prices, reliability
from chainsignals.sources import io
from chainsignals.streaming import jobs

MINUTE, HOUR = 60_000_000, 3_600_000_000
T0 = 472_000 * HOUR


def history(mean=1000.0, hours=48, pool="p"):
    rng = random.Random(7)
    return [("mantle", pool, "swap", f"h{i % 3}", T0 + i * HOUR, mean * rng.uniform(0.6, 1.4)) for i in range(hours)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "chain string, pool string, type string, wallet string, us long, usd double")


def scored(spark, rows):
    df = frame(spark, rows)
    return baseline.score_events(df, baseline.rolling_baseline(baseline.hourly_volume(df)))


def burst(wallets, usd=20_000.0, at=T0 + 50 * HOUR, gap=MINUTE, pool="p", kind="swap"):
    return [("mantle", pool, kind, w, at + i * gap, usd) for i, w in enumerate(wallets)]


def groups(spark, rows, **options):
    windows = multiwallet.coordinated(multiwallet.wallet_windows(scored(spark, rows)), **options)
    return sorted(greedy.emit_with_cooldown(windows, ("chain", "pool", "type"), 30 * MINUTE, signature="wallets").collect(), key=lambda r: r.us)


def test_baseline_needs_history_and_spread(spark):
    few = scored(spark, history(hours=10) + burst(["w"], at=T0 + 11 * HOUR))
    assert few.where("wallet = 'w' and z is not null").count() == 0
    level = [("mantle", "p", "swap", "h", T0 + i * HOUR, 100.0) for i in range(48)]
    assert scored(spark, level + burst(["w"], at=T0 + 48 * HOUR)).where("wallet = 'w' and z is not null").count() == 0
    assert scored(spark, history() + burst(["w"])).where("wallet = 'w'").first().is_anomaly


def test_baseline_by_model(spark):
    rng = random.Random(3)
    rows = [("mantle", "p", "swap", "w", T0 + rng.randrange(400 * 60) * MINUTE + i, rng.uniform(1, 100)) for i in range(300)]
    sums: dict[int, float] = {}
    for *_, us, usd in rows:
        sums[us // HOUR] = sums.get(us // HOUR, 0.0) + usd
    first = min(sums)
    for r in baseline.rolling_baseline(baseline.hourly_volume(frame(spark, rows))).collect():
        n = min(336, r.hour - first)
        values = [sums.get(h, 0.0) for h in range(r.hour - n, r.hour)]
        if n:
            mean = sum(values) / n
            assert r.baseline_mean == pytest.approx(mean)
            if n >= 24:
                assert r.baseline_std == pytest.approx((sum((v - mean) ** 2 for v in values) / n) ** 0.5)


def test_wallets_that_act_together(spark):
    found = groups(spark, history() + burst([f"w{i}" for i in range(6)]))
    assert len(found) == 1 and found[0].n_wallets >= 2
    assert groups(spark, history() + burst(["w"] * 6)) == []
    many = [f"w{i:02}" for i in range(16)]
    assert groups(spark, history() + burst(many, usd=6_300.0)) == []
    assert len(groups(spark, history() + burst(many[:15], usd=6_700.0))) == 1
    assert groups(spark, history() + burst(["a", "b"], usd=100.0)) == []


def test_group_cooldown(spark):
    first = burst(["a", "b"], usd=60_000.0)
    again = burst(["c", "d"], usd=60_000.0, at=T0 + 50 * HOUR + 10 * MINUTE)
    later = burst(["c", "d"], usd=60_000.0, at=T0 + 50 * HOUR + 40 * MINUTE)
    assert len(groups(spark, history() + first + again)) == 1
    assert len(groups(spark, history() + first + later)) == 2


def test_same_wallets_at_exactly_the_cooldown(spark):
    rows = spark.createDataFrame([("k", 0, ["a", "b"]), ("k", 30, ["a", "b"]), ("k", 60, ["a", "c"])], "k string, us long, wallets array<string>")
    assert [r.us for r in greedy.emit_with_cooldown(rows, ("k",), 30, signature="wallets").orderBy("us").collect()] == [0, 60]
    assert [r.us for r in greedy.emit_with_cooldown(rows, ("k",), 30).orderBy("us").collect()] == [0, 30, 60]


def test_exact_windows_with_cap_and_ties(spark):
    rows = [("mantle", "p", "swap", f"w{i % 4}", T0 + 50 * HOUR + i // 3 * MINUTE, 1.0 + i) for i in range(90)]
    df = scored(spark, history() + rows).withColumn("nth", F.row_number().over(__import__("pyspark").sql.Window.orderBy("us", "usd")))
    got = {r.nth: r for r in multiwallet.exact_wallet_windows(df, order=("us", "nth"), block_us=60 * MINUTE, cap=20).collect()}
    model = sorted((r.us, r.nth, r.wallet, r.usd) for r in df.where("z is not null").collect())
    for i, (us, nth, _, _) in enumerate(model):
        inside = [x for x in model[: i + 1] if us - x[0] <= 30 * MINUTE][-20:]
        assert got[nth].n_events == len(inside)
        assert got[nth].n_wallets == len({x[2] for x in inside})
        assert got[nth].window_usd == pytest.approx(sum(x[3] for x in inside))


def test_anchor_clusters(spark):
    rows = [("p", "swap", "a", 0, 10.0, 3.0), ("p", "swap", "b", 5 * MINUTE, 10.0, 5.0), ("p", "swap", "c", 6 * MINUTE, 10.0, 3.0), ("q", "mint", "d", 100 * MINUTE, 50.0, 4.5), ("q", "mint", "b", 200 * MINUTE, 50.0, 4.5)]
    found = greedy.anchor_clusters(spark.createDataFrame(rows, "pool string, type string, wallet string, us long, usd double, z double"), ("pool", "type"), order=("us",)).collect()
    assert sorted(r.wallets for r in found) == [["a", "b", "c"], ["d"]]


def test_budget(spark):
    rows = spark.createDataFrame([(1, i, 90.0, i != 1) for i in range(4)], "day int, us long, amount double, ok boolean")
    got = {r.us: r.allowed for r in greedy.within_budget(rows, "amount", "ok", 200.0).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False}


def test_asof_blocks_and_age(spark):
    ticks = spark.createDataFrame([("k", 10, 1.0), ("k", 3 * prices.DAY_US, 2.0)], "k string, us long, price double")
    rows = spark.createDataFrame([("k", 5), ("k", 10), ("k", 2 * prices.DAY_US), ("k", 3 * prices.DAY_US + 1), ("z", 99)], "k string, us long")
    got = {(r.k, r.us): r.price for r in prices.asof(rows, ticks, ("k",)).collect()}
    assert got == {("k", 5): None, ("k", 10): 1.0, ("k", 2 * prices.DAY_US): 1.0, ("k", 3 * prices.DAY_US + 1): 2.0, ("z", 99): None}
    fresh = {r.us: r.price for r in prices.asof(rows, ticks, ("k",), max_age_us=5).collect()}
    assert fresh[2 * prices.DAY_US] is None and fresh[10] == 1.0


def test_zero_entry_price_completes_without_change(spark):
    signals = spark.createDataFrame([(1, "c", "accumulation", 100)], "id long, chain string, signal_type string, detected_us long")
    ticks = spark.createDataFrame([("c", 50, 0.0), ("c", HOUR, 5.0)], "chain string, us long, price double")
    done = outcomes.resolve_outcomes(signals, ticks, 2 * HOUR).where("horizon = '1h'").first()
    assert done.status == "completed" and done.pct_change is None


def test_words(spark):
    values = [0, 1, 2**63, 2**128 + 2**64, 2**256 - 1, -1, -(2**64), -(2**64) + 1, -(2**130), -(2**255)]
    rows = spark.createDataFrame([(str(v), f"{v % 2**256:064x}", v < 0) for v in values], "v string, w string, s boolean")
    for r in rows.select("v", words.to_double(F.col("w"), F.col("s")).alias("d"), F.when(F.col("s"), words.to_decimal_text(F.col("w"), True)).otherwise(words.to_decimal_text(F.col("w"))).alias("t")).collect():
        assert r.d == pytest.approx(float(int(r.v)), rel=1e-15)
        assert r.t == r.v
    dual = spark.createDataFrame([("0x1F",), ("31",)], "x string").select(words.flexible_int(F.col("x")).alias("n"))
    assert [r.n for r in dual.collect()] == [31, 31]


def test_keccak():
    assert keccak.keccak256([b""]) == ["c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"]
    assert keccak.keccak256([b"Transfer(address,address,uint256)"])[0].startswith("ddf252ad1be2c89b69c2b068fc378daa")
    assert keccak.keccak256([b"a" * 136, b"b" * 400]) == [keccak.keccak256([b"a" * 136])[0], keccak.keccak256([b"b" * 400])[0]]


REPLIES = [
    ('{"summary": "s", "confidence": 120, "signal_type": "WHALE_ENTRY", "key_factors": ["a", "", "b"]}', ("s", 100, "whale_entry", ["a", "b"])),
    ('```json\n{"summary": "s", "confidence": -5, "signal_type": "x"}\n```', ("s", 0, "unusual_volume", ["Unusual on-chain activity detected"])),
    ('{"summary": " ", "confidence": 5}', None),
    ('{"summary": "s", "confidence": "n/a"}', None),
    ('{"summary": "s", "confidence": null}', None),
    ('{"summary": "s", "confidence": "1e2"}', None),
    ('{"summary": "s", "confidence": {"a": 1}}', None),
    ('{"summary": "s", "confidence": false}', ("s", 0, "unusual_volume", ["Unusual on-chain activity detected"])),
    ('{"summary": "s", "confidence": -3.7e0}', ("s", 0, "unusual_volume", ["Unusual on-chain activity detected"])),
    ('{"summary": "s", "confidence": " +12 "}', ("s", 12, "unusual_volume", ["Unusual on-chain activity detected"])),
    ('{"summary": "s", "confidence": 1e300}', ("s", 100, "unusual_volume", ["Unusual on-chain activity detected"])),
    ("not json", None),
    ("", None),
    (None, None),
]


@pytest.mark.parametrize("raw,want", REPLIES)
def test_replies(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "raw string").select(payloads.parse_reply(F.col("raw")).alias("r")).first().r
    assert (tuple(got) if got else None) == want


def test_texts(spark):
    row = spark.range(1).select(texts.format_usd(F.lit(1_250_000.0)).alias("a"), texts.format_usd(F.lit(999.6)).alias("b"), texts.confidence_bar(F.lit(82)).alias("c"), texts.wallet_list(F.array(*[F.lit("0x" + str(i) * 20) for i in range(7)])).alias("d")).first()
    assert (row.a, row.b) in {("$1.2M", "$1000"), ("$1.3M", "$1000")}
    assert row.c == "🟢 ████████░░ 82%"
    assert row.d.count("\n") == 5 and row.d.endswith("\nand 2 more")


def test_guards_in_order(spark):
    rows = spark.createDataFrame([(60.0, 100.0, 0.05, 5.0, "bad"), (4.0, 100.0, 0.05, 0.0, "bad"), (4.0, 100.0, 0.0, 0.0, "BAD"), (60.0, 5000.0, 0.01, 5.0, "p"), (4.0, 100.0, 0.02, 5.0, "p")], "amount_usd double, balance_usd double, max_slippage double, max_position_pct double, pool string")
    bad = spark.createDataFrame([("Bad",)], "pool string")
    assert [r.guard_failed for r in matching.guard(rows, bad).collect()] == ["position_cap", "slippage_check", "blacklist", "absolute_trade_cap", None]


def test_stacked_expiry(spark):
    day = billing.DAY_US
    rows = spark.createDataFrame([(1, 1, 0, 30), (1, 2, 5 * day, 30), (1, 3, 100 * day, 180)], "sub_id long, payment_id long, us long, days int")
    assert [r.expires_us // day for r in billing.stacked_expiry(rows).orderBy("payment_id").collect()] == [30, 60, 280]
    opened = billing.stacked_expiry(rows.withColumn("open", F.lit(50 * day)), opening="open").orderBy("payment_id").collect()
    assert [r.expires_us // day for r in opened] == [80, 110, 290]


def test_tiers_and_streaks(spark):
    got = spark.createDataFrame([(28.98,), (28.995,), (165.295,), (313.195,), (1000.0,)], "a double").select(billing.tier_days(F.col("a")).alias("d")).collect()
    assert [r.d for r in got] == [None, 30, 180, 365, 365]
    rows = spark.createDataFrame([("k", i, ok) for i, ok in enumerate([False, False, True, False])], "k string, us long, ok boolean")
    assert [r.streak for r in reliability.failure_streaks(rows, ("k",)).orderBy("us").collect()] == [1, 2, 0, 1]
    assert all(r.allowed for r in reliability.rate_limited(rows, ("k",), 100, 0).collect())


def test_hits(spark):
    rows = spark.createDataFrame([("accumulation", 1.0), ("whale_exit", 1.0), ("unusual_volume", 1.0), ("accumulation", None)], "signal_type string, pct_change double")
    assert [r.h for r in rows.select(classify.is_hit().alias("h")).collect()] == [True, False, None, None]


def anchor_model(rows, window, least):
    """Clusters of one key's (us, wallet) by looking at every anchor's window anew."""
    rows, known, out = sorted(rows), set(), []
    for i, (us, _) in enumerate(rows):
        part = [r for r in rows[i:] if r[0] <= us + window]
        new = {w for _, w in part} - known
        if len(new) >= least:
            known |= new
            out.append((us, part[-1][0], len(part), tuple(sorted(new))))
    return out


def test_anchor_clusters_by_model(spark):
    rng = random.Random(4)
    rows = [(rng.choice("pq"), rng.randrange(4000), f"w{rng.randrange(25)}") for _ in range(400)]
    df = spark.createDataFrame([(p, "swap", w, us, 1.0, 3.0) for p, us, w in rows], "pool string, type string, wallet string, us long, usd double, z double")
    found = greedy.anchor_clusters(df, ("pool", "type"), 60, 2, order=("us", "wallet")).collect()
    want = [x for p in "pq" for x in anchor_model([(us, w) for k, us, w in rows if k == p], 60, 2)]
    assert sorted((r.first_us, r.last_us, r.event_count, tuple(r.wallets)) for r in found) == sorted(want)


def test_rules_meet_signals_by_keys(spark):
    """Broadcast or shuffled, with every kind of filter, and without cartesian products."""
    sig = spark.createDataFrame([(1, "c", "t", "p", 70), (2, None, "t", "q", 70), (3, "d", None, "p", 10)], "id long, chain string, signal_type string, protocol string, confidence int")
    subs = spark.createDataFrame([(i, "x", False, None, 50, *f) for i, f in enumerate([(None, [], None), (["c", "c", "e"], None, None), (["mantle"], ["t"], ["q", "r"]), (["d"], None, ["p"])])], "sub_id int, channel string, is_pro boolean, pro_expires_at timestamp, min_confidence int, chains array<string>, signal_types array<string>, protocols array<string>")
    hooks = spark.createDataFrame([(1, True, ("c", None, None)), (2, True, (None, "t", 60)), (3, True, (None, None, None)), (4, False, (None, None, None))], "webhook_id int, active boolean, filters struct<chain:string,signal_type:string,min_confidence:int>")
    few = matching.BROADCAST_RULES
    try:
        for limit in (few, -1):
            matching.BROADCAST_RULES = limit
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m" if limit == few else "-1")
            found = matching.match_subscriptions(sig, subs)
            assert sorted((r.id, r.sub_id) for r in found.collect()) == [(1, 0), (1, 1), (2, 0), (2, 2)]
            pairs = matching.match_webhooks(sig, hooks)
            assert sorted(map(tuple, pairs.collect())) == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3)]
            for df in (found, pairs):
                assert "Cartesian" not in df._jdf.queryExecution().toString() and "NestedLoop" not in df._jdf.queryExecution().toString()
    finally:
        matching.BROADCAST_RULES = few
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")


def test_deliveries_that_are_over(spark):
    """A failure that a retry mends is none; what is still retried is not over."""
    tries = [(1, 1, 0, False), (1, 1, 1, True), (1, 2, 2, False), (1, 2, 3, False), (1, 3, 4, False), (1, 4, 5, False), (1, 4, 6, False), (1, 4, 7, True)]
    rows = spark.createDataFrame(tries, "webhook_id long, signal_id long, us long, ok boolean")
    over = reliability.finished_deliveries(rows, 2)
    assert sorted((r.signal_id, r.us, r.ok) for r in over.collect()) == [(1, 1, True), (2, 3, False), (4, 6, False)]
    assert [r.disabled_us for r in reliability.disabled_at(over, ("webhook_id",), 2).collect()] == [6]


def test_every_table_makes_the_round_trip(spark, tmp_path):
    for name, schema in io.TABLES.items():
        rows = spark.createDataFrame([tuple(None for _ in StructType.fromDDL(schema))], schema)
        io.append_table(rows, f"{tmp_path}/{name}", schema)
        io.append_table(rows, f"{tmp_path}/{name}", schema)
        back = io.read_table(spark, f"{tmp_path}/{name}", schema)
        assert back.schema == rows.schema and back.count() == 2


def test_jdbc_table_by_ranges(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.range(1, 101).selectExpr("id", "id * 1.5 as amount").write.jdbc(url, "payments", properties={"driver": driver})
    back = io.read_jdbc(spark, url, "payments", "id", 1, 101, 4, driver=driver)
    assert back.rdd.getNumPartitions() == 4 and back.agg(F.sum("id")).first()[0] == 5050


def test_stream_goes_on_after_a_failed_batch(spark, tmp_path):
    """A batch whose sink fails half-way is repeated after a restart and counts once."""
    for part in range(3):
        spark.range(part * 10, part * 10 + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    calls = []

    def fails_once(batch):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("the sink is down")
        return batch

    sinks = {"first": lambda b: b, "second": fails_once}
    with pytest.raises(Exception, match="the sink is down"):
        jobs.fan_out(source(), sinks, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/first").count() == 20 and spark.read.parquet(f"{tmp_path}/out/second").count() == 10
    jobs.fan_out(source(), sinks, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    for name in sinks:
        assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out/{name}").collect()) == list(range(30))


def test_streams_leave_the_session_as_it_was(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    with jobs.rocksdb_state(spark):
        assert spark.conf.get(name) == jobs.ROCKSDB
    assert spark.conf.get(name) == before


def test_proxies_from_a_table_of_any_size(spark):
    from chainsignals.plans import ingestion

    rows = [(7, 2010, 1), (8, 2010, 2), (9, 1990, 3), (10, 2011, 4)]
    frame = spark.createDataFrame(rows, "event_id long, user_id long, k int").selectExpr("event_id", "timestamp'2024-01-01' as ts", "user_id", "'click' as event_type", "1.0D as value")
    path = __import__("tempfile").mkdtemp()
    frame.write.parquet(f"{path}/events.parquet")
    found = {r.event_id: r.wallet for r in ingestion.jn2_wallet_attribution(spark, path).collect()}
    assert found == {7: "0xorigin2010", 8: "0xorigin2010", 9: "0x" + "1990".zfill(40), 10: "0x" + "2011".zfill(40)}


def test_lists_of_wallets_leave_in_parts(monkeypatch):
    import numpy as np

    parts = list(multiwallet._parts(np.array([3, 3, 20, 1, 1, 9]), 7))
    assert parts == [(0, 2), (2, 3), (3, 5), (5, 6)]
    assert list(multiwallet._parts(np.array([], int), 7)) == []
