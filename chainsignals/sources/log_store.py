"""Raw logs stored so that a range of blocks and a set of pools read only their own files.

Folders by chain and span of blocks prune partitions; within a file rows are sorted by
block, so row groups and pages are skipped by their least and greatest block; a Bloom
filter for each row group tells which addresses it can't hold.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.words import flexible_int
from . import schemas

#: Blocks of a folder: about a day of a chain with a block every few seconds.
SPAN = 20_000
#: Folders of a chain in a store that is written at once.
FOLDERS = 64
#: Up to so many addresses are tested one by one, so that Bloom filters apply; more by a join alone.
LISTED = 200


def prepared(logs: DataFrame, span: int = SPAN) -> DataFrame:
    """Raw logs with integer block and log index, lower-case address and their span of blocks.

    Block numbers in decimal and in hex become one integer column, which a scan can
    push down; logs without a block number have no span and are in no range.
    """
    block = flexible_int(F.col("block_number"))
    return logs.select(
        "chain",
        F.floor(block / span).cast("bigint").alias("span"),
        block.alias("block"),
        F.lower("address").alias("address"),
        "topics",
        "data",
        "tx_hash",
        flexible_int(F.col("log_index")).cast("int").alias("log_index"),
    )


def span_for(logs: DataFrame, least: int, folders: int = FOLDERS) -> int:
    """A span, ``least`` times a power of two, with which the blocks of ``logs`` fill at most ``folders`` folders of a chain.

    A fixed span gives a folder, and a file, for every few rows once a table has many
    blocks; one table is read here for its first and last block.
    """
    block = flexible_int(F.col("block_number"))
    first, last = logs.agg(F.min(block), F.max(block)).first()
    span = least
    while first is not None and last // span - first // span >= folders:
        span *= 2
    return span


def append_logs(logs: DataFrame, path: str, span: int = SPAN, addresses_per_group: int = 10_000, row_group_bytes: int = 32 << 20) -> None:
    """Append raw logs to the store at ``path``.

    Rows are dealt by ranges of chain, block and transaction, so a chain with most of
    the logs is written by many tasks, and a task writes few folders.
    """
    rows = prepared(logs, span)
    dealt = rows.repartitionByRange("chain", "block", "tx_hash").sortWithinPartitions("chain", "span", "block", "address")
    writer = dealt.write.mode("append").partitionBy("chain", "span")
    writer = writer.option("parquet.bloom.filter.enabled#address", "true").option("parquet.bloom.filter.expected.ndv#address", str(addresses_per_group))
    # a dictionary would answer in place of the filter, but is given up in large row groups
    writer.option("parquet.block.size", str(row_group_bytes)).parquet(path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LOG_STORE).parquet(path)


def scan_range(spark: SparkSession, path: str, pools: DataFrame, from_block: int, to_block: int, chains: list[str], span: int = SPAN) -> DataFrame:
    """Stored logs of registered pools in a range of blocks (inclusive), with topics.

    ``span`` is that of the store.  Few pools are tested by address in the scan; the join
    that checks chain and pool together follows in any case.
    """
    registered = pools.where(F.col("chain").isin(*chains)).select("chain", F.lower("pool").alias("address"))
    rows = read_logs(spark, path).where(F.col("chain").isin(*chains) & F.col("span").between(from_block // span, to_block // span) & F.col("block").between(from_block, to_block))
    found = registered.select("address").distinct().limit(LISTED + 1).collect()
    if len(found) <= LISTED:
        tests = [F.col("address") == r.address for r in found if r.address is not None]
        rows = rows.where(reduce(or_, tests, F.lit(False)))
    return rows.where(F.size("topics") > 0).join(registered, ["chain", "address"], "left_semi")


def as_raw(rows: DataFrame) -> DataFrame:
    """Stored rows in the shape of raw logs, for ``route`` and ``decode``."""
    return rows.select("chain", "address", "topics", "data", F.col("block").cast("string").alias("block_number"), "tx_hash", F.col("log_index").cast("string").alias("log_index"))
