"""Readers and writers with fixed schemas: tables, streams, signals, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import schemas


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``, the folder that driver and executors share."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, path: str, schema: str, form: str = "parquet", **options: str) -> DataFrame:
    """A stored table with its fixed schema; ``form`` is any of Spark's sources."""
    return spark.read.format(form).options(**options).schema(schema).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table, read in parts by ranges of a key."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options).load()


def event_stream(spark: SparkSession, servers: str | None = None, topic: str | None = None, path: str | None = None, files_per_batch: int = 100, offsets_per_batch: int = 1_000_000) -> DataFrame:
    """The event queue as a stream of text values: a Kafka topic, or a folder of JSON lines.

    A batch takes so many files or offsets at most, so that a backlog is worked off in
    steps, each of which is committed before the next.
    """
    if path is not None:
        return spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(path)
    return spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "maxOffsetsPerTrigger": str(offsets_per_batch)}).load().select(F.col("value").cast("string").alias("value"))


def parse_signals(values: DataFrame, column: str = "value", default_chain: str = "mantle") -> DataFrame:
    """Signal payloads as rows, with the defaults of missing fields; times that can't be read are null."""
    schema = "id bigint, chain string, protocol string, pool string, wallets array<string>, signal_type string, confidence int, summary string, detected_at string, deliver_at string, z_score double, total_volume_usd double, event_type string"
    p = F.from_json(F.col(column), schema).alias("p")
    text = lambda c, d: F.coalesce(f"p.{c}", F.lit(d)).alias(c)
    return values.select(p).select(
        "p.id",
        text("chain", default_chain),
        text("protocol", "unknown"),
        F.lower(F.coalesce("p.pool", F.lit(""))).alias("pool"),
        F.coalesce("p.wallets", F.array().cast("array<string>")).alias("wallets"),
        text("signal_type", "unusual_volume"),
        F.coalesce("p.confidence", F.lit(0)).alias("confidence"),
        text("summary", ""),
        F.try_to_timestamp("p.detected_at").alias("detected_at"),
        F.try_to_timestamp("p.deliver_at").alias("deliver_at"),
        F.coalesce("p.z_score", F.lit(0.0)).alias("z_score"),
        F.coalesce("p.total_volume_usd", F.lit(0.0)).alias("total_volume_usd"),
        text("event_type", "swap"),
    )


def append_table(rows: DataFrame, path: str, schema: str, *by: str) -> None:
    """Append ``rows`` to a stored table as its schema has them, in folders of the columns ``by``."""
    wanted = StructType.fromDDL(schema)
    rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted]).write.mode("append").partitionBy(*by).parquet(path)


def persist_signals(signals: DataFrame, path: str) -> None:
    """Append signals to their table, by chain."""
    signals.write.mode("append").partitionBy("chain").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    report.write.mode("overwrite").json(path)


TABLES = {name.lower(): getattr(schemas, name) for name in ("SIGNALS", "SIGNAL_OUTCOMES", "SUBSCRIPTIONS", "EXECUTIONS", "PAYMENTS", "WEBHOOKS", "ATTEMPTS", "AUDIT_LOG", "DECISIONS")}
