"""Cooldowns and budgets by blocks against walks row by row."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chainsignals.operators import blocks, greedy, multiwallet, sketches

MINUTE = 60_000_000


def walk_cooldown(rows, cooldown):
    last, out = {}, []
    for i, key, us in sorted(rows, key=lambda r: (r[2], r[0])):
        if key not in last or us - last[key] >= cooldown:
            last[key] = us
            out.append(i)
    return sorted(out)


def walk_budget(rows, budget):
    spent, out = {}, {}
    for i, key, us, amount, spends in sorted(rows, key=lambda r: (r[2], r[0])):
        before = spent.get(key, 0.0)
        ok = amount is not None and before + amount <= budget
        out[i] = (ok, before)
        if ok and spends:
            spent[key] = before + amount
    return out


@pytest.mark.parametrize(("cooldown", "block"), [(30 * MINUTE, None), (30 * MINUTE, 30 * MINUTE), (7, 100), (1, 1), (0, None)])
def test_cooldown(spark, cooldown, block):
    rng = random.Random(cooldown + (block or 0))
    span = max(cooldown, 1) * 200
    rows = [(i, rng.choice(["a", "a", "a", "b", None, f"k{i % 50}"]), rng.randrange(-span, span)) for i in range(2500)]
    rows += [(3000 + i, "ties", (i // 5) * cooldown) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, key string, us long")
    got = blocks.cooldown(df, ("key",), cooldown, ("us", "id"), block)
    assert got.columns == df.columns
    assert sorted(r.id for r in got.collect()) == walk_cooldown(rows, cooldown)


def test_cooldown_of_an_empty_table(spark):
    none = spark.createDataFrame([], "id long, key string, us long")
    assert greedy.emit_with_cooldown(none, ("key",), 5).count() == 0
    assert blocks.within_budget(none.withColumn("x", F.lit(1.0)).withColumn("s", F.lit(True)), "x", "s", 5.0, ("key",)).count() == 0


def test_a_key_without_gaps_is_dealt_over_all_tasks(spark):
    """A million rows, ten seconds apart: none is a gap, and no task holds many of them."""
    df = spark.range(1_000_000).select(F.lit("hot").alias("key"), (F.col("id") * 10_000_000).alias("us"))
    got = greedy.emit_with_cooldown(df, ("key",), 30 * MINUTE)
    assert sorted(r.us for r in got.collect()) == list(range(0, 10_000_000_000_000, 30 * MINUTE))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    blocked = df.withColumn("_block", F.floor(F.col("us") / (16 * 30 * MINUTE)))
    sizes = [r["n"] for r in blocks.dealt(blocked, ("key", "_block")).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 0.5 * 1_000_000


@pytest.mark.parametrize(("budget", "seed"), [(1000.0, 1), (10.0, 2), (0.0, 3), (1e9, 4), (-1.0, 5)])
def test_budget(spark, budget, seed):
    rng = random.Random(seed)
    amount = lambda: rng.choice([None, 0.0, round(rng.expovariate(0.05), 2), rng.random() * 0.1, 0.1, 50.0, 2000.0])
    rows = [(i, rng.choice(["a", "a", "b", None]), rng.randrange(0, 86_400_000_000), amount(), rng.choice([True, True, False, None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, key string, us long, amount double, spends boolean")
    got = greedy.within_budget(df, "amount", "spends", budget, ("key",), ("us", "id"))
    assert {r.id: (r.allowed, r.spent_before) for r in got.collect()} == walk_budget(rows, budget)


def test_budget_with_refunds(spark):
    rng = random.Random(6)
    rows = [(i, "a", i * MINUTE, round(rng.uniform(-20, 40), 2), True) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, key string, us long, amount double, spends boolean")
    got = greedy.within_budget(df, "amount", "spends", 300.0, ("key",), ("us", "id"))
    assert {r.id: (r.allowed, r.spent_before) for r in got.collect()} == walk_budget(rows, 300.0)


def test_a_day_of_many_requests_walks_few(spark, monkeypatch):
    """The walk in order sees a small share of a hot day's requests."""
    seen = spark.sparkContext.accumulator(0)
    numbered = blocks._numbered

    def counting(walk):
        def counted(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return numbered(lambda batches: walk(counted(batches)))

    monkeypatch.setattr(blocks, "_numbered", counting)
    n, budget = 300_000, 1000.0
    amounts = np.random.default_rng(3).uniform(0, 100, n).round(3)
    table = pa.table({"id": np.arange(n), "us": np.arange(n) * 288_000, "amount": amounts})
    df = spark.createDataFrame(table.to_pandas()).withColumn("day", F.lit(1)).withColumn("spends", F.lit(True))
    got = greedy.within_budget(df, "amount", "spends", budget, ("day",), ("us", "id")).where("allowed").select("id", "spent_before").collect()
    want = walk_budget([(i, 1, i, a, True) for i, a in enumerate(amounts.tolist())], budget)
    assert {r.id: r.spent_before for r in got} == {i: before for i, (ok, before) in want.items() if ok}
    assert 0 < seen.value < n / 20


def slow_windows(rows, window):
    """(id, wallets, sum, n, first) by comparing all pairs of a key."""
    out = {}
    for i, key, us, wallet, usd in rows:
        inside = [r for r in rows if r[1] == key and us - window <= r[2] <= us]
        out[i] = (sorted({r[3] for r in inside if r[3] is not None}), pytest.approx(sum(r[4] for r in inside)), len(inside), min(r[2] for r in inside))
    return out


@pytest.mark.parametrize("block", [30, 100, 10_000])
def test_wallet_windows(spark, block):
    rng = random.Random(block)
    rows = [(i, rng.choice("ab"), rng.randrange(0, 900), rng.choice([*"uvwxyz", None]), rng.random() * 10) for i in range(500)]
    df = spark.createDataFrame([(*r, 1.0, 1.0, 1.0) for r in rows] + [(900, "a", 5, "q", 1.0, None, 1.0, 1.0)], "id long, key string, us long, wallet string, usd double, z double, baseline_mean double, baseline_std double")
    got = multiwallet.wallet_windows(df, ("key",), 30, block).collect()
    want = slow_windows(rows, 30)
    assert {r.id: (r.wallets, r.window_usd, r.n_events, r.first_us) for r in got} == want
    assert all(r.n_wallets == len(r.wallets) and r.last_us == r.us for r in got)
    few = multiwallet.wallet_windows(df, ("key",), 30, block, listed=3).collect()
    assert {r.id: r.wallets for r in few} == {i: w[0] if len(w[0]) <= 3 else None for i, w in want.items()}


def test_distinct_wallets_take_linear_time():
    """Ten times the density is about ten times the work, not a hundred."""
    import time

    def seconds(n):
        rng = np.random.default_rng(1)
        us, wallet = np.sort(rng.integers(0, 3_600_000_000, n)), rng.integers(0, 500, n)
        best = 1e9
        for _ in range(3):
            start = time.process_time()
            multiwallet.distinct_active(us, wallet, 1_800_000_000)
            best = min(best, time.process_time() - start)
        return best

    assert seconds(1_000_000) < 40 * seconds(100_000) + 0.05


def test_merged_sketches(spark):
    rows = spark.range(200_000).select((F.col("id") % 50_000).cast("string").alias("wallet"), (F.col("id") * 1_000_000).alias("us"))
    hours = sketches.hourly_sketches(rows, "wallet")
    day = sketches.merged(hours).first()["distinct"]
    assert abs(day - 50_000) <= 3 * sketches.standard_error() * 50_000
    assert sketches.distinct_between(hours, 0, 3_600_000_000).first()["distinct"] == pytest.approx(3600, rel=0.03)
    # a union of unions is the union
    halves = [sketches.merged(hours.where(c)).select("sketch") for c in ("hour < 20", "hour >= 20")]
    assert sketches.merged(halves[0].unionByName(halves[1])).first()["distinct"] == day
