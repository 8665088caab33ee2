"""Price outcomes of signals at fixed horizons, hit rates and wallet records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import dims
from .classify import is_hit
from .prices import asof

HOUR_US = 3_600_000_000


def tracked_asset(signals: DataFrame, pool_assets: DataFrame, chain_assets: DataFrame, default: str = "eth") -> DataFrame:
    """price_key of a signal: that of its pool, else of its chain, else ``default``."""
    pools = pool_assets.select(F.col("chain").alias("_c"), F.lower("pool").alias("_p"), F.col("price_key").alias("_exact"))
    chains = chain_assets.select(F.col("chain").alias("_c2"), F.col("price_key").alias("_chain"))
    joined = signals.join(pools, (F.col("chain") == F.col("_c")) & (F.lower("pool") == F.col("_p")), "left").join(chains, F.col("chain") == F.col("_c2"), "left")
    return joined.withColumn("price_key", F.coalesce("_exact", "_chain", F.lit(default))).drop("_c", "_p", "_exact", "_c2", "_chain")


def horizons(signals: DataFrame) -> DataFrame:
    """One pending row for each horizon of a signal: horizon, due_us."""
    steps = F.array(*[F.struct(F.lit(name).alias("horizon"), F.lit(hours * HOUR_US).alias("after")) for name, hours in dims.HORIZONS.items()])
    return signals.withColumn("h", F.explode(steps)).withColumn("horizon", F.col("h.horizon")).withColumn("due_us", F.col("detected_us") + F.col("h.after")).drop("h")


def pct_change(entry: Column, price: Column) -> Column:
    """Percent change rounded to 4; null for an entry price of 0."""
    return F.when(entry != 0, F.round((price - entry) / entry * 100, 4))


def resolve_outcomes(signals: DataFrame, ticks: DataFrame, now_us: int, key: tuple[str, ...] = ("chain",), static: DataFrame | None = None) -> DataFrame:
    """Outcomes of all signals: entry_price, status, price and pct_change.

    Due rows (due_us <= ``now_us``) are completed, or failed when there is no price at
    all; the others stay pending.
    """
    entered = asof(signals, ticks, key, at="detected_us", out="entry_price").drop("entry_price_us")
    priced = asof(horizons(entered), ticks, key, at="due_us", out="price").drop("price_us")
    if static is not None:
        fixed = static.select(*key, F.col("price").alias("_static"))
        priced = priced.join(fixed, list(key), "left").withColumns({c: F.coalesce(c, "_static") for c in ("entry_price", "price")}).drop("_static")
    due = F.col("due_us") <= now_us
    failed = F.col("price").isNull() | F.col("entry_price").isNull()
    status = F.when(~due, "pending").when(failed, "failed").otherwise("completed")
    done = priced.withColumn("status", status)
    completed = F.col("status") == "completed"
    change = F.when(completed, pct_change(F.col("entry_price"), F.col("price")))
    return done.withColumn("pct_change", change).withColumn("price", F.when(completed, F.col("price")))


def due_outcomes(outcomes: DataFrame, now_us: int) -> DataFrame:
    return outcomes.where((F.col("status") == "pending") & (F.col("due_us") <= now_us))


def with_outcomes(signals: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Signals with their outcomes as an array in order of due time."""
    nested = outcomes.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("due_us", "horizon", "status", "price", "pct_change"))).alias("outcomes"))
    return signals.join(nested, "id", "left")


def track_report(outcomes: DataFrame, horizon: str | None = None) -> DataFrame:
    """Grouped by horizon, chain, protocol, type and overall: n, scored, hits, hit_rate, avg_pct.

    Rows are first summed by all four columns; the grouping sets then run over few rows.
    The overall row counts every completed outcome, whatever ``horizon`` filters.
    """
    done = outcomes.where("status = 'completed'").withColumn("hit", is_hit())
    dims_ = ["horizon", "chain", "protocol", "signal_type"]
    base = done.groupBy(*dims_).agg(F.count("*").alias("n"), F.count("hit").alias("scored"), F.count_if("hit").alias("hits"), F.sum(F.coalesce("pct_change", F.lit(0.0))).alias("pct"))
    part = base.where(F.col("horizon") == horizon) if horizon else base
    sums = [F.sum(c).alias(c) for c in ("n", "scored", "hits", "pct")]
    sets = [[F.col(d)] for d in dims_]
    grouped = part.groupingSets(sets, *dims_).agg(*sums, F.grouping_id().alias("g"))
    name = F.element_at(F.create_map(*[F.lit(x) for d, g in zip(dims_, (7, 11, 13, 14), strict=True) for x in (g, d)]), F.col("g").cast("int"))
    rows = grouped.select(name.alias("dimension"), F.coalesce(*dims_).alias("value"), "n", "scored", "hits", "pct")
    total = base.agg(*sums).select(F.lit("total").alias("dimension"), F.lit("all").alias("value"), "n", "scored", "hits", "pct")
    every = rows.unionByName(total)
    return every.select("dimension", "value", "n", "scored", "hits", F.round(100 * F.col("hits") / F.nullif("scored", F.lit(0)), 1).alias("hit_rate"), F.round(F.col("pct") / F.col("n"), 3).alias("avg_pct"))


def api_stats(signals: DataFrame, outcomes: DataFrame, horizon: str = "24h") -> DataFrame:
    """Per chain: signals, resolved and hits of directional outcomes at ``horizon``, hit_rate."""
    resolved = outcomes.where((F.col("horizon") == horizon) & (F.col("status") == "completed")).withColumn("hit", is_hit()).where("hit is not null")
    per_chain = resolved.groupBy("chain").agg(F.count("*").alias("resolved"), F.count_if("hit").alias("hits"))
    counts = signals.groupBy("chain").agg(F.count("*").alias("signals")).join(per_chain, "chain", "left").fillna(0, ["resolved", "hits"])
    return counts.withColumn("hit_rate", F.round(F.col("hits") / F.nullif("resolved", F.lit(0)), 4))


def wallet_records(outcomes: DataFrame, horizon: str = "24h", min_total: int = 3, min_rate: float = 0.65) -> DataFrame:
    """Per wallet: total and hits over directional outcomes, and the label.

    is_smart is null (unknown) under ``min_total`` outcomes.
    """
    done = outcomes.where((F.col("horizon") == horizon) & (F.col("status") == "completed")).withColumn("hit", is_hit()).where("hit is not null")
    rows = done.select(F.explode(F.transform("wallets", F.lower)).alias("wallet"), "hit")
    summed = rows.groupBy("wallet").agg(F.count("*").alias("total"), F.count_if("hit").alias("hits"))
    return summed.withColumn("is_smart", F.when(F.col("total") >= min_total, F.col("hits") / F.col("total") >= min_rate))


def smart_money(candidates: DataFrame, records: DataFrame, vendor: DataFrame, key: str = "id", first: int = 5) -> DataFrame:
    """Candidates with the number of smart wallets among their first ``first``.

    A wallet's own record comes first, the vendor's label only where that is unknown.
    """
    wallets = candidates.select(key, F.explode(F.slice("wallets", 1, first)).alias("w")).select(key, F.lower("w").alias("wallet"))
    own = records.select("wallet", "is_smart")
    other = vendor.select(F.lower("wallet").alias("wallet"), F.col("is_smart").alias("vendor_smart"))
    labelled = wallets.join(own, "wallet", "left").join(other, "wallet", "left")
    counts = labelled.groupBy(key).agg(F.count_if(F.coalesce("is_smart", "vendor_smart", F.lit(False))).alias("smart_money_count"))
    return candidates.join(counts, key, "left").fillna(0, ["smart_money_count"])
