"""Failure streaks, retries, rate limits and delivery state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE_US = 60_000_000
#: Minutes until the next try after the n-th failure (fixed values).
BACKOFF = (1, 2, 4, 8, 16)


def failure_streaks(rows: DataFrame, key: tuple[str, ...], ok: str = "ok", order: tuple[str, ...] = ("us",)) -> DataFrame:
    """``rows`` with streak: failures in a row up to and with this one (0 at a success)."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    island = rows.withColumn("_island", F.sum(F.col(ok).cast("int")).over(w))
    inside = Window.partitionBy(*key, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return island.withColumn("streak", F.sum((~F.col(ok)).cast("int")).over(inside)).withColumnRenamed("_island", "island")


def finished_deliveries(attempts: DataFrame, max_attempts: int = 5, order: tuple[str, ...] = ("us",)) -> DataFrame:
    """One row for each delivery that is over, by its last attempt: webhook_id, signal_id, ok, attempts, and the order columns.

    A delivery ends with its first success, or exhausted by its ``max_attempts``-th failure;
    what is still to be retried is not over, and attempts after the end don't count.
    """
    delivery = ["webhook_id", "signal_id"]
    nth = attempts.withColumn("attempts", F.row_number().over(Window.partitionBy(*delivery).orderBy(*order)))
    ends = nth.where(F.col("ok") | (F.col("attempts") == max_attempts)).where(F.col("attempts") <= max_attempts)
    last = ends.groupBy(*delivery).agg(F.min_by(F.struct("ok", "attempts", *order), "attempts").alias("end"))
    return last.select(*delivery, "end.*")


def disabled_at(rows: DataFrame, key: tuple[str, ...], limit: int = 10, ok: str = "ok", order: tuple[str, ...] = ("us",)) -> DataFrame:
    """The first time at which a key's streak reaches ``limit``.

    For webhooks ``rows`` are ``finished_deliveries``: a failure that a retry mends ends no streak and adds to none.
    """
    return failure_streaks(rows, key, ok, order).where(F.col("streak") == limit).groupBy(*key).agg(F.min("us").alias("disabled_us"))


def health(streak: Column, warn: int = 3, degraded: int = 5) -> Column:
    return F.when(streak >= degraded, "degraded").when(streak >= warn, "warning").otherwise("ok")


def rate_limited(requests: DataFrame, key: tuple[str, ...], window_us: int, limit: int, order: tuple[str, ...] = ("us",)) -> DataFrame:
    """``requests`` with nth in their fixed window and allowed; a limit of 0 or less always allows."""
    w = Window.partitionBy(*key, F.floor(F.col("us") / window_us)).orderBy(*order)
    return requests.withColumn("nth", F.row_number().over(w)).withColumn("allowed", F.lit(limit <= 0) | (F.col("nth") <= limit))


def backoff_minutes(attempts: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, BACKOFF)), F.least(attempts, F.lit(len(BACKOFF))).cast("int"))


def delivery_state(attempts: DataFrame, max_attempts: int = 5, order: tuple[str, ...] = ("us",)) -> DataFrame:
    """Latest state of each (webhook, signal): attempts, status and next_retry_us."""
    key = ["webhook_id", "signal_id"]
    last = attempts.groupBy(*key).agg(F.count("*").alias("attempts"), F.max_by("ok", F.struct(*order)).alias("ok"), F.max("us").alias("last_us"))
    status = F.when(F.col("ok"), "delivered").when(F.col("attempts") >= max_attempts, "exhausted").otherwise("failed")
    rows = last.withColumn("status", status)
    return rows.withColumn("next_retry_us", F.when(F.col("status") == "failed", F.col("last_us") + backoff_minutes(F.col("attempts")) * F.lit(MINUTE_US))).drop("ok")


def retries_due(state: DataFrame, webhooks: DataFrame, signals: DataFrame, now_us: int) -> DataFrame:
    """Failed deliveries whose retry is due, of active webhooks and known signals."""
    due = state.where((F.col("status") == "failed") & (F.col("next_retry_us") <= now_us))
    return due.join(webhooks.where("active").select("webhook_id"), "webhook_id").join(signals.select(F.col("id").alias("signal_id")), "signal_id")
