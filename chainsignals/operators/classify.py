"""Signal types, buy and sell flags, and candidates with their signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import dims


def signal_type(kind: str = "type", volume: str = "total_volume_usd", whale_usd: float = 500_000.0) -> Column:
    """swap: whale_entry above ``whale_usd`` else accumulation; mint and burn: liquidity; else unusual_volume."""
    swap = F.when(F.col(volume) > whale_usd, "whale_entry").otherwise("accumulation")
    return F.when(F.col(kind) == "swap", swap).when(F.col(kind) == "mint", "liquidity_added").when(F.col(kind) == "burn", "liquidity_removed").otherwise("unusual_volume")


def with_sides(events: DataFrame) -> DataFrame:
    """is_buy for swaps and mints, is_sell for burns."""
    return events.withColumn("is_buy", F.col("type").isin("swap", "mint")).withColumn("is_sell", F.col("type") == "burn")


def solo_candidates(emitted: DataFrame, whale_usd: float = 500_000.0) -> DataFrame:
    rows = emitted.select("chain", "protocol", "pool", "type", F.array("wallet").alias("wallets"), F.col("usd").alias("total_volume_usd"), F.col("z").alias("z_score"), F.lit(1).cast("long").alias("event_count"), F.col("us").alias("first_us"), F.col("us").alias("last_us"))
    return rows.withColumn("signal_type", signal_type(whale_usd=whale_usd))


def multi_candidates(emitted: DataFrame, whale_usd: float = 500_000.0) -> DataFrame:
    rows = emitted.select("chain", "protocol", "pool", "type", "wallets", F.col("window_usd").alias("total_volume_usd"), F.col("z_window").alias("z_score"), F.col("n_events").alias("event_count"), "first_us", "last_us")
    return rows.withColumn("signal_type", signal_type(whale_usd=whale_usd))


def candidates(solo: DataFrame, multi: DataFrame, whale_usd: float = 500_000.0) -> DataFrame:
    """Both kinds together; an event may give one of each."""
    return solo_candidates(solo, whale_usd).unionByName(multi_candidates(multi, whale_usd))


def is_hit(kind: str = "signal_type", change: str = "pct_change") -> Column:
    """True or false for a directional signal with a price change, else null."""
    return F.when(F.col(change).isNull(), None).when(F.col(kind).isin(*dims.UP_TYPES), F.col(change) > 0).when(F.col(kind).isin(*dims.DOWN_TYPES), F.col(change) < 0)


def deliverable(signals: DataFrame, min_confidence: int = 50, hold_minutes: int = 5) -> DataFrame:
    """Signals that pass the confidence gate, with the time at which they may be delivered."""
    return signals.where(F.col("confidence") >= min_confidence).withColumn("deliver_us", F.col("detected_us") + F.lit(hold_minutes * 60_000_000))


def duration_text(first: str = "first_us", last: str = "last_us") -> Column:
    seconds = ((F.col(last) - F.col(first)) / 1_000_000).cast("long")
    return F.when(seconds >= 60, F.format_string("%d minutes", F.floor(seconds / 60))).otherwise(F.format_string("%d seconds", seconds))
