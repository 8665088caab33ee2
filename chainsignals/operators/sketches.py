"""Distinct counts that merge: a HyperLogLog sketch for each hour, unioned on demand.

A sketch has a bounded size, whatever it counts, so the count of any range of hours
comes from the stored hours without a rescan of the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .baseline import HOUR_US

#: Binary logarithm of the registers of a sketch.
LOG_REGISTERS = 14


def standard_error(log_registers: int = LOG_REGISTERS) -> float:
    """Relative standard error of an estimate."""
    return 1.04 / 2 ** (log_registers / 2)


def hourly_sketches(events: DataFrame, value: str | Column, by: tuple[str, ...] = (), log_registers: int = LOG_REGISTERS) -> DataFrame:
    """(by, hour, sketch) of the distinct ``value``s of each hour; nulls do not count.

    Tasks sketch before the shuffle, so a hot hour reaches it as one row per task.
    """
    return events.groupBy(*by, F.floor(F.col("us") / HOUR_US).alias("hour")).agg(F.hll_sketch_agg(value, log_registers).alias("sketch"))


def merged(hours: DataFrame, *by: str | Column) -> DataFrame:
    """(by, sketch, distinct): unions of sketches and the estimate of each."""
    return hours.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch")).withColumn("distinct", F.hll_sketch_estimate("sketch"))


def distinct_between(hours: DataFrame, from_us: int, to_us: int, *by: str) -> DataFrame:
    """Estimates over the hours that begin in a range (end exclusive), by any of the sketches' columns."""
    return merged(hours.where((F.col("hour") >= -(-from_us // HOUR_US)) & (F.col("hour") * HOUR_US < to_us)), *by)
