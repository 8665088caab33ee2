"""Rules that share their needs are matched once: totals, caps, guards and budgets without all pairs."""

from pyspark.sql import functions as F

from chainsignals.operators import matching

DAY = matching.DAY_US


def signals(spark, n):
    """Signals over ten days, with ties in time and without some values."""
    i = F.col("id")
    pick = lambda k, *v: F.element_at(F.array(*map(F.lit, v)), (F.floor(i / k) % len(v) + 1).cast("int"))
    return spark.range(n).select("id", pick(1, "mantle", "arbitrum", None).alias("chain"), pick(3, "a", "b", None).alias("signal_type"), pick(2, "x", "y").alias("protocol"), F.when(i % 17 != 0, (i * 7 % 101).cast("int")).alias("confidence"), (F.floor(i * 10 / n) * DAY + i * 7919 % 97 * 600_000_000).alias("detected_us"))


def subscriptions(spark, n):
    i = F.col("id")
    listed = lambda k, *v: F.when(i % k == 0, F.array(*map(F.lit, v))).when(i % k == 1, F.array().cast("array<string>"))
    ends = F.when(i % 4 != 0, F.timestamp_micros(i % 13 * DAY + i % 3 * 7_000_000_000))
    return spark.range(n).select((i - (i % 50 == 49).cast("int")).alias("sub_id"), F.lit("line").alias("channel"), (i % 5 * 20).cast("int").alias("min_confidence"), listed(3, "mantle", "mantle").alias("chains"), listed(4, "a", "b").alias("signal_types"), listed(5, "y").alias("protocols"), F.when(i % 7 != 0, i % 2 == 0).alias("is_pro"), ends.alias("pro_expires_at"))


def same(got, want):
    columns = want.columns
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.collect()))


def test_subscription_totals_are_those_of_the_pairs(spark):
    sig, subs = signals(spark, 900), subscriptions(spark, 150)
    want = matching.match_subscriptions(sig, subs).groupBy("sub_id", "channel").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.sum("id").alias("ids"))
    assert want.count() > 100
    same(matching.subscription_totals(sig, subs), want)


def test_subscription_totals_without_ten_billion_pairs(spark):
    found = matching.subscription_totals(signals(spark, 300_000), subscriptions(spark, 100_000))
    assert found.agg(F.sum("n")).first()[0] > 1e9


def test_delivered_totals_are_those_of_the_pairs(spark):
    """Ties in time, ends within a day and at its edge, accounts listed twice are left out."""
    sig, subs = signals(spark, 900), subscriptions(spark, 150).dropDuplicates(["sub_id"])
    for per_day in (1, 3):
        want = matching.cap_free_tier(matching.match_subscriptions(sig, subs), per_day).groupBy("sub_id").agg(F.count("*").alias("delivered"), F.sum("id").alias("ids"))
        assert want.count() > 100
        same(matching.delivered_totals(sig, subs, per_day), want)


def test_delivered_totals_without_ten_billion_pairs(spark):
    found = matching.delivered_totals(signals(spark, 200_000), subscriptions(spark, 100_000))
    assert found.agg(F.sum("delivered")).first()[0] > 1e8


def acting(spark, n_signals, n_agents):
    i = F.col("id")
    sig = signals(spark, n_signals).withColumns({"pool": F.concat(F.lit("P"), i % 9), "z_score": i % 37 / 10})
    some = lambda k, v: F.when(i % k != 0, v)
    rules = F.struct(some(3, (i % 10 * 10).cast("int")).alias("min_confidence"), some(4, F.array(F.lit("a"), F.lit("b"))).alias("signal_types"), some(2, F.array(F.lit("x"))).alias("protocols"), some(5, i % 40 / 10).alias("min_z_score"), F.lit("swap").alias("action"), some(7, (i % 70 + 10).cast("double")).alias("amount_usd"), some(2, i % 3 / 50).alias("max_slippage"), some(6, (i % 4).cast("double")).alias("max_position_pct"))
    agents = spark.range(n_agents).select((i - (i % 50 == 49).cast("int")).alias("agent_id"), (i % 10 != 9).alias("active"), (i % 90 * 100).cast("double").alias("balance_usd"), rules.alias("rules"))
    return sig, agents, spark.createDataFrame([("p3",), ("P5",)], "pool string")


def test_guard_totals_are_those_of_the_requests(spark):
    sig, agents, bad = acting(spark, 900, 150)
    rows = matching.guard(matching.execution_requests(sig, agents), bad)
    want = rows.groupBy("agent_id", F.coalesce("guard_failed", F.lit("passed")).alias("guard")).agg(F.count("*").alias("n"))
    assert want.select("guard").distinct().count() == 5
    same(matching.guard_totals(sig, agents, bad), want)
    passed = rows.where("guard_failed is null").drop("guard_failed")
    assert passed.count() > 100
    same(matching.passed_requests(sig, agents, bad).na.fill("-"), passed.na.fill("-"))


def test_guard_totals_without_ten_billion_pairs(spark):
    assert matching.guard_totals(*acting(spark, 200_000, 100_000)).agg(F.sum("n")).first()[0] > 1e8


def test_requests_are_made_by_all_tasks(spark):
    """Signals are small, what they stand for is not: their partitions stay apart."""
    sig, agents, bad = acting(spark, 900, 150)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for found in (matching.execution_requests(sig, agents), matching.passed_requests(sig, agents, bad)):
        assert n > 1 and found.select(F.spark_partition_id()).distinct().count() == n


def test_requests_of_few_and_of_many_agents_are_the_same(spark, monkeypatch):
    sig, agents, bad = acting(spark, 900, 150)
    asked = lambda: matching.execution_requests(sig, agents).na.fill("-").na.fill(-1)
    passed = lambda: matching.passed_requests(sig, agents, bad).na.fill("-").na.fill(-1)
    few = asked(), passed()
    monkeypatch.setattr(matching, "BROADCAST_RULES", 10)
    many = asked(), passed()
    for got, want in zip(few, many):
        assert want.count() > 100
        same(got, want)


def test_requests_are_the_same_however_signals_are_cut(spark, monkeypatch):
    sig, agents, bad = acting(spark, 900, 150)
    plain = lambda found: sorted(map(tuple, found.na.fill("-").na.fill(-1).collect()))
    whole = plain(matching.execution_requests(sig, agents)), plain(matching.passed_requests(sig, agents, bad))
    monkeypatch.setattr(matching, "CHUNK", 10)
    monkeypatch.setattr(matching, "LIST", 16)
    assert len(whole[0]) > 1000 and whole == (plain(matching.execution_requests(sig, agents)), plain(matching.passed_requests(sig, agents, bad)))
    for n in (0, 1, 7, 8, 15, 16, 17, 24, 39):
        parts = spark.range(1).select(matching._cut(F.expr(f"slice(sequence(0, 99), 1, {n})")).alias("p")).first().p
        assert sum(parts, []) == list(range(n)) and all(0 < len(x) <= 16 for x in parts) and all(len(x) % 8 == 0 for x in parts[:-1])


def test_budgeted_requests_are_those_of_the_rows(spark, monkeypatch):
    """Equal to the walk over all rows, of which few blocks are made for it; times of an agent differ."""
    from chainsignals.operators import blocks, greedy

    of_blocks, made = blocks.of_blocks, []
    sig, agents, bad = acting(spark, 900, 150)
    sig, agents = sig.withColumn("detected_us", F.col("detected_us") + F.col("id")), agents.dropDuplicates(["agent_id"])
    rows = matching.passed_requests(sig, agents, bad).select("agent_id", "signal_id", "us", "amount_usd", F.floor(F.col("us") / DAY).alias("day"), (F.col("agent_id") % 5 != 0).alias("succeeds"))
    for budget in (-1.0, 5.0, 95.0):
        want = greedy.within_budget(rows, "amount_usd", "succeeds", budget, order=("us", "agent_id")).select("agent_id", "signal_id", "allowed", "spent_before")
        found = matching.budgeted_requests(sig, agents, bad, F.col("agent_id") % 5 != 0, budget, (10.0, 20.0))
        assert want.where("allowed").count() > 0 or budget < 10
        same(found, want)
    monkeypatch.setattr(blocks, "of_blocks", lambda rows, table, group: made.append(table.count()) or of_blocks(rows, table, group))
    matching.budgeted_requests(sig, agents, bad, F.col("agent_id") % 5 != 0, 95.0, (10.0, 20.0))
    walked, still, moving = made
    assert 0 < moving < still / 5 and moving < walked < still


def test_stored_requests_are_small(spark, tmp_path):
    """A list of signals repeats for all orders of a profile, so rows take a fraction of a byte."""
    sig, agents, _ = acting(spark, 9000, 6000)
    matching.execution_requests(sig, agents).select("agent_id", "signal_id", "action_type", "amount_usd", "max_slippage", "max_position_pct").write.parquet(str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).count()
    assert rows > 1_000_000 and sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 0.7 * rows


def test_a_new_key_of_a_cooldown_asks_state_once():
    import pandas as pd

    from chainsignals.streaming import jobs

    calls = []

    class Value:
        last = None

        def get(self):
            calls.append("get")
            return self.last

        def update(self, value):
            self.last = value

    class Handle:
        def getValueState(self, *_):
            return Value()

        def listTimers(self):
            calls.append("list")
            return iter([5])

        def registerTimer(self, ms):
            calls.append(("register", ms))

        def deleteTimer(self, ms):
            calls.append(("delete", ms))

    rule = jobs.Cooldown(1_000_000, ["us"], True)
    rule.init(Handle())
    run = lambda *us: [u for f in rule.handleInputRows(("k",), iter([pd.DataFrame({"us": list(us)})]), None) for u in f["us"]]
    assert run(7_000_000) == [7_000_000] and calls == ["get", ("register", 8001)]
    assert run(7_500_000, 8_000_000) == [8_000_000] and calls[2:] == ["get", "list", ("delete", 5), ("register", 9001)]
