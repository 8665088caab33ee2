"""Reports: counts with shares, running totals, dashboards, pages and bounded logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def daily_counts(rows: DataFrame, us: str = "detected_us", days: int | None = None, now_us: int | None = None) -> DataFrame:
    """Rows per day with a running total; the running window is over days only."""
    if days is not None:
        rows = rows.where(F.col(us) >= now_us - days * DAY_US)
    per_day = rows.groupBy(F.floor(F.col(us) / DAY_US).alias("day")).agg(F.count("*").alias("signals"))
    return per_day.withColumn("cumulative", F.sum("signals").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


def shares(rows: DataFrame, by: Column, name: str) -> DataFrame:
    """Counts by a label and their percent of all."""
    counts = rows.groupBy(by.alias(name)).agg(F.count("*").alias("signals"))
    return counts.withColumn("pct", F.round(100 * F.col("signals") / F.sum("signals").over(Window.partitionBy()), 1))


def success_by(rows: DataFrame, by: str) -> DataFrame:
    """Total, executed, aborted and success percent by a column."""
    sums = rows.groupBy(by).agg(F.count("*").alias("total"), F.count_if("success").alias("executed"), F.count_if(~F.col("success")).alias("aborted"))
    return sums.withColumn("success_pct", F.round(100 * F.col("executed") / F.nullif("total", F.lit(0)), 1))


def last_days(rows: DataFrame, now_us: int, days: int = 7, us: str = "detected_us") -> DataFrame:
    """Counts of the last days, zero where a day has none."""
    today = now_us // DAY_US
    spine = rows.sparkSession.range(today - days + 1, today + 1).toDF("day")
    counts = rows.where(F.col(us) >= (today - days + 1) * DAY_US).groupBy(F.floor(F.col(us) / DAY_US).alias("day")).agg(F.count("*").alias("n"))
    return spine.join(counts, "day", "left").fillna(0, ["n"])


def dashboard(signals: DataFrame, executions: DataFrame, now_us: int) -> DataFrame:
    """(section, name, n): counts by chain, protocol and day, and execution totals."""
    part = lambda df, section, name: df.select(F.lit(section).alias("section"), F.col(name).cast("string").alias("name"), F.col("n").cast("double").alias("n"))
    by = lambda c: part(signals.groupBy(c).agg(F.count("*").alias("n")), c, c)
    totals = executions.agg(F.count("*").cast("double").alias("total"), F.count_if(F.col("status") == "success").cast("double").alias("success"))
    totals = totals.withColumn("success_rate", F.round(100 * F.col("success") / F.nullif("total", F.lit(0.0)), 1)).unpivot([], ["total", "success", "success_rate"], "name", "n")
    return by("chain").unionByName(by("protocol")).unionByName(part(last_days(signals, now_us), "day", "day")).unionByName(part(totals, "executions", "name"))


def grouped_counters(rows: DataFrame, *columns: str) -> DataFrame:
    """Counts by each of the columns on its own."""
    sets = rows.groupingSets([[F.col(c)] for c in columns], *columns).agg(F.count("*").alias("n"), *[F.grouping(c).alias(f"_{c}") for c in columns])
    name = F.coalesce(*[F.when(F.col(f"_{c}") == 0, F.lit(c)) for c in columns])
    return sets.select(name.alias("dimension"), F.coalesce(*[F.col(c).cast("string") for c in columns]).alias("value"), "n")


def keyset_page(rows: DataFrame, cursor: int | None, limit: int = 25, most: int = 100, key: str = "id") -> DataFrame:
    """A page of ids below the cursor, newest first, with one row more than asked for to tell if there is a next."""
    n = max(1, min(limit, most))
    page = rows.where(F.col(key) < cursor) if cursor is not None else rows
    return page.orderBy(F.desc(key)).limit(n + 1)


def offset_page(rows: DataFrame, offset: int, limit: int, most: int = 100, key: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(key)).offset(offset).limit(min(limit, most))


def newest(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """A bounded log that keeps the newest ``n``."""
    return rows.orderBy(*map(F.desc, order)).limit(n)


def oldest(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """A bounded log that keeps the first ``n`` and refuses more."""
    return rows.orderBy(*order).limit(n)


def ready_for_delivery(signals: DataFrame, now_us: int) -> DataFrame:
    return signals.where(F.col("deliver_us") <= now_us).orderBy("deliver_us", "id")


def queue_depth(signals: DataFrame, now_us: int) -> DataFrame:
    return signals.agg(F.count("*").alias("depth"), F.count_if(F.col("deliver_us") > now_us).alias("pending"), F.count_if(F.col("deliver_us") <= now_us).alias("ready"))


def state_counts(rows: DataFrame, state: Column, *states: str) -> DataFrame:
    """One row: how many rows are in each state, and in all."""
    return rows.agg(*[F.count_if(state == s).alias(s) for s in states], F.count("*").alias("total"))
