"""Addresses in topics, as lower-case hex."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded_topic(address: Column) -> Column:
    """An address as a 32-byte topic."""
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.regexp_replace(address, "^0x", "")), 64, "0"))


def last_address(topic: Column) -> Column:
    """The address in the last 20 bytes of a topic."""
    return F.concat(F.lit("0x"), F.lower(F.right(topic, F.lit(40))))
