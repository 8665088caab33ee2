"""As-of prices and USD estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def asof(rows: DataFrame, ticks: DataFrame, key: tuple[str, ...], at: str = "us", value: str = "price", max_age_us: int | None = None, block_us: int = DAY_US, out: str | None = None) -> DataFrame:
    """``rows`` with the last tick of their key at or before time ``at`` (null if none or too old).

    Both sides are cut into blocks of time, so that few price keys do not make few tasks.
    The last tick before a block comes from a table of one row per key and block.
    ``ticks`` has the key, us and ``value``; the result adds ``out`` and ``out``_us.
    """
    out = out or value
    block = lambda c: F.floor(F.col(c) / block_us)
    left = rows.select(*key, F.col(at).alias("_us"), block(at).alias("_block"), F.lit(1).alias("_row"), F.lit(None).cast("struct<us:bigint,v:double>").alias("_tick"), F.struct(*rows.columns).alias("_left"))
    right = ticks.where(F.col(value).isNotNull()).select(*key, F.col("us").alias("_us"), block("us").alias("_block"), F.lit(0).alias("_row"), F.struct(F.col("us").alias("us"), F.col(value).cast("double").alias("v")).alias("_tick"), F.lit(None).cast(left.schema["_left"].dataType).alias("_left"))
    last_of = right.groupBy(*key, "_block").agg(F.max_by("_tick", "_us").alias("_last"))
    blocks = left.select(*key, "_block").distinct().join(last_of, [*key, "_block"], "full")
    past = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*key, "_block", F.last("_last", ignorenulls=True).over(past).alias("_carried"))
    inside = Window.partitionBy(*key, "_block").orderBy("_us", "_row").rowsBetween(Window.unboundedPreceding, 0)
    seen = left.unionByName(right).withColumn("_seen", F.last("_tick", ignorenulls=True).over(inside)).where("_row = 1")
    tick = F.coalesce("_seen", "_carried")
    if max_age_us is not None:
        tick = F.when(F.col("_us") - tick["us"] <= max_age_us, tick)
    joined = seen.join(carried, [*key, "_block"], "left").select("_left", tick.alias("_tick"))
    return joined.select("_left.*", F.col("_tick.v").alias(out), F.col("_tick.us").alias(f"{out}_us"))


def live_or_static(rows: DataFrame, ticks: DataFrame, static: DataFrame, key: tuple[str, ...] = ("chain", "price_key"), max_age_us: int = 60_000_000) -> DataFrame:
    """Live price if fresh, else the static one, else 0."""
    found = asof(rows, ticks, key, max_age_us=max_age_us, out="live_price")
    fixed = static.select(*key, F.col("price").alias("static_price"))
    return found.join(fixed, list(key), "left").withColumn("price", F.coalesce("live_price", "static_price", F.lit(0.0)))


def estimate_usd(amount0: Column, amount1: Column, price0: Column, price1: Column, decimals0: Column, decimals1: Column) -> Column:
    """The larger leg's value, rounded to 4; a leg without a price counts as 0."""
    leg = lambda a, p, d: F.abs(a) / F.pow(F.lit(10.0), d) * F.coalesce(p, F.lit(0.0))
    return F.round(F.greatest(leg(amount0, price0, decimals0), leg(amount1, price1, decimals1)), 4)


def legacy_usd(amount0: Column, amount1: Column, native_price: Column) -> Column:
    """For pools without token data: the larger raw amount as 18-decimal native coins."""
    return F.round(F.greatest(F.abs(amount0), F.abs(amount1)) / 1e18 * F.coalesce(native_price, F.lit(0.72)), 4)
