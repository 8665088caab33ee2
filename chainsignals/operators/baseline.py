"""Rolling hourly volume baseline, z-scores, anomaly and solo-candidate filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import dims

KEY = ("chain", "pool", "type")
HOUR_US = 3_600_000_000


def hourly_volume(events: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """USD per key and hour; only hours with events have a row."""
    return events.groupBy(*key, F.floor(F.col("us") / HOUR_US).alias("hour")).agg(F.sum("usd").alias("volume"))


def seeded(history: DataFrame, live: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Hourly volume of live events after a history that counts first."""
    columns = [*key, "us", "usd"]
    return hourly_volume(history.select(*columns).unionByName(live.select(*columns)), key)


def rolling_baseline(hourly: DataFrame, key: tuple[str, ...] = KEY, hours: int = 336, min_hours: int = 24) -> DataFrame:
    """Mean and deviation of the last ``hours`` completed hours, for each hour that has events.

    Hours without events count as zero, but need no rows: the moments of the hours
    that have rows are merged with those of the zero hours.  baseline_std is null when
    fewer than ``min_hours`` have passed since the key's first, or when volumes are constant.
    """
    frame = Window.partitionBy(*key).orderBy("hour").rangeBetween(-hours, -1)
    first = F.min("hour").over(Window.partitionBy(*key).orderBy("hour").rowsBetween(Window.unboundedPreceding, 0))
    parts = hourly.select(
        *key,
        "hour",
        "volume",
        F.least(F.lit(hours), F.col("hour") - first).alias("n"),
        F.count("volume").over(frame).alias("filled"),
        F.coalesce(F.avg("volume").over(frame), F.lit(0.0)).alias("m"),
        F.coalesce(F.var_pop("volume").over(frame), F.lit(0.0)).alias("v"),
        F.count_if(F.col("volume") != 0).over(frame).alias("nonzero_hours"),
        (F.min("volume").over(frame) == F.max("volume").over(frame)).alias("level"),
    )
    n, filled, m = F.col("n"), F.col("filled"), F.col("m")
    mean = F.when(n > 0, m * filled / n).otherwise(0.0)
    variance = F.when(n > 0, (F.col("v") * filled + m * m * filled * (n - filled) / n) / n).otherwise(0.0)
    constant = (filled == 0) | (F.col("level") & (filled == n))
    ready = (n >= min_hours) & ~F.coalesce(constant, F.lit(True))
    return parts.select(*key, "hour", "volume", "n", "nonzero_hours", mean.alias("baseline_mean"), F.when(ready, F.sqrt(variance)).alias("baseline_std"))


def open_state(hourly: DataFrame, key: tuple[str, ...] = KEY, hours: int = 336) -> DataFrame:
    """What a stream needs to go on after a history: one row for each key.

    first is the key's first hour, hour its newest one, which is still open, volume what
    that hour has so far; hours and volumes list the completed hours that may still count,
    at most ``hours`` of them.
    """
    ends = hourly.groupBy(*key).agg(F.min("hour").alias("first"), F.max("hour").alias("open_hour"))
    recent = hourly.join(ends, list(key)).where(F.col("hour") >= F.col("open_hour") - hours)
    past = F.col("hour") < F.col("open_hour")
    rows = recent.groupBy(*key, "first", "open_hour").agg(F.max(F.when(~past, F.col("volume"))).alias("volume"), F.sort_array(F.collect_list(F.when(past, F.struct("hour", "volume")))).alias("done"))
    return rows.select(*key, "first", F.col("open_hour").alias("hour"), "volume", F.col("done.hour").alias("hours"), F.col("done.volume").alias("volumes"))


def threshold(default: float = 2.5, overrides: dict[str, float] | None = None) -> Column:
    """z-score threshold of the row's chain."""
    return dims.lookup(overrides, F.col("chain"), F.lit(default)) if overrides else F.lit(default)


def score_events(events: DataFrame, baseline: DataFrame, key: tuple[str, ...] = KEY, limit: Column | None = None) -> DataFrame:
    """Events with z, baseline_mean, baseline_std and is_anomaly; z is null where not scorable.

    The event's own hour is not part of its baseline.  The hourly table is small, so
    Spark broadcasts it where its size allows.
    """
    hours = baseline.select(*key, "hour", "baseline_mean", "baseline_std")
    joined = events.withColumn("hour", F.floor(F.col("us") / HOUR_US)).join(hours, [*key, "hour"], "left")
    z = (F.col("usd") - F.col("baseline_mean")) / F.col("baseline_std")
    return joined.withColumn("z", z).withColumn("is_anomaly", F.coalesce(F.col("z") >= (threshold() if limit is None else limit), F.lit(False)))


def solo_eligible(scored: DataFrame, min_usd: float = 300.0, chain_min: dict[str, float] | None = None) -> DataFrame:
    """Anomalies above the global and the chain's own floor."""
    own = dims.lookup(chain_min, F.col("chain"), F.lit(0.0)) if chain_min else F.lit(0.0)
    return scored.where(F.col("is_anomaly") & (F.col("usd") >= min_usd) & (F.col("usd") >= own))


def scoring_stats(scored: DataFrame) -> DataFrame:
    """Scored, flagged and flag rate in percent, by chain and overall (null chain)."""
    counts = [F.count("*").alias("scored"), F.count_if("is_anomaly").alias("flagged")]
    return scored.rollup("chain").agg(*counts).withColumn("flag_rate", F.round(100 * F.col("flagged") / F.greatest(F.col("scored"), F.lit(1)), 2))
