"""Streaming jobs over the event table, driven to the end so that they can be compared with batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payloads
from ..sources import io, schemas, tables
from ..streaming import jobs
from .registry import query


def _scratch(spark: SparkSession) -> str:
    return io.scratch_path(spark, "stream")


def event_stream(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """The events as a stream of files."""
    ev = tables.events(spark, sf_dir)
    ev.write.parquet(f"{path}/in")
    return spark.readStream.schema(ev.schema).parquet(f"{path}/in")


@query(tables.with_ctes("ev", "SELECT chain, pool, type, hour * 3600000000 AS hour_us, round(volume, 4) AS volume FROM (SELECT chain, pool, type, us // 3600000000 AS hour, sum(usd) AS volume FROM ev GROUP BY ALL) WHERE hour < (SELECT (max(us) - 7200000000) // 3600000000 FROM ev)"))
def stm2_hourly_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that the watermark has closed."""
    path = _scratch(spark)
    rows = jobs.run_once(jobs.hourly_volume(event_stream(spark, sf_dir, path)), f"{path}/out", f"{path}/checkpoint")
    return rows.select("chain", "pool", "type", F.unix_micros("hour").alias("hour_us"), F.round("volume", 4).alias("volume"))


@query(tables.with_ctes("ev", "SELECT event_id, us FROM ev"))
def stm6_deduplicated_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream in which every event comes twice."""
    path = _scratch(spark)
    stream = event_stream(spark, sf_dir, path)
    rows = jobs.run_once(jobs.deduplicate(stream.unionByName(stream)).select("event_id", "us"), f"{path}/out", f"{path}/checkpoint")
    return rows


STREAM_COOLDOWN = """elig AS (SELECT event_id, wallet, pool, us FROM ev WHERE usd >= 60), emitted AS (
    SELECT wallet, pool, min(us) AS us FROM elig GROUP BY ALL
    UNION ALL SELECT e.wallet, e.pool, min(n.us) FROM emitted e JOIN elig n ON n.wallet = e.wallet AND n.pool = e.pool AND n.us >= e.us + 86400000000 GROUP BY e.wallet, e.pool, e.us)"""


@query(tables.with_ctes("ev", "SELECT event_id, us FROM elig JOIN emitted USING (wallet, pool, us)", STREAM_COOLDOWN, recursive=True))
def stm5_cooldown_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large events of a wallet and pool, at most one a day, from state."""
    path = _scratch(spark)
    stream = event_stream(spark, sf_dir, path).where("usd >= 60")
    return jobs.run_once(jobs.cooldown(stream, ("wallet", "pool"), 86_400_000_000, ["event_id", "us"], late="2 hours"), f"{path}/out", f"{path}/checkpoint")


def _score_sql() -> str:
    from .detection import BASE

    return tables.with_ctes("ev", "SELECT event_id, round(z, 6) AS z FROM scored", BASE)


@query(_score_sql())
def stm3_scored_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from the baseline in state equal those of the batch job."""
    path = _scratch(spark)
    scored = jobs.score(event_stream(spark, sf_dir, path).select("chain", "pool", "type", "event_id", "us", "usd"))
    rows = jobs.run_once(scored, f"{path}/out", f"{path}/checkpoint")
    return rows.select("event_id", F.round(F.when(~F.isnan("z"), F.col("z")), 6).alias("z"))


HALF = 1_705_276_800_000_000


def _seeded_sql() -> str:
    from .detection import BASE

    return tables.with_ctes("ev", f"SELECT event_id, round(z, 6) AS z FROM scored WHERE us >= {HALF}", BASE)


@query(_seeded_sql())
def src5_seeded_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that begins at half time, seeded with the batch baseline of what was before, scores as the batch job does."""
    path = _scratch(spark)
    ev = tables.events(spark, sf_dir).select("chain", "pool", "type", "event_id", "us", "usd")
    ev.where(f"us >= {HALF}").write.parquet(f"{path}/in")
    live = spark.readStream.schema(ev.schema).parquet(f"{path}/in")
    rows = jobs.run_once(jobs.seeded_score(ev.where(f"us < {HALF}"), live), f"{path}/out", f"{path}/checkpoint")
    return rows.select("event_id", F.round(F.when(~F.isnan("z"), F.col("z")), 6).alias("z"))


@query(tables.with_ctes("ev", "SELECT chain, pool, type, us // 3600000000 * 3600000000 AS hour_us, round(sum(usd), 4) AS volume FROM ev GROUP BY ALL"))
def stm7_reopened_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the events comes after the rest and reopens its hours; the newest versions are those of a batch run."""
    path = _scratch(spark)
    ev = tables.events(spark, sf_dir)
    for part in ("event_id % 10 <> 0", "event_id % 10 = 0"):
        ev.where(part).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(ev.schema).parquet(f"{path}/in")
        jobs.hour_versions(stream, f"{path}/hours", f"{path}/checkpoint", late="60 days").awaitTermination()
    return jobs.current_hours(jobs.read_versions(spark, f"{path}/hours")).select("chain", "pool", "type", "hour_us", F.round("volume", 4).alias("volume"))


@query(tables.with_ctes("ev", "SELECT sink, count(*) AS n, round(sum(usd), 2) AS usd FROM (SELECT unnest(CASE WHEN usd >= 50 THEN ['all', 'large'] ELSE ['all'] END) AS sink, usd FROM ev) GROUP BY sink"))
def src7_stm1_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream to two sinks."""
    path = _scratch(spark)
    stream = event_stream(spark, sf_dir, path)
    jobs.fan_out(stream, {"all": lambda b: b, "large": lambda b: b.where("usd >= 50")}, f"{path}/sinks", f"{path}/checkpoint").awaitTermination()
    read = lambda sink: spark.read.parquet(f"{path}/sinks/{sink}").select(F.lit(sink).alias("sink"), "usd")
    return read("all").unionByName(read("large")).groupBy("sink").agg(F.count("*").alias("n"), F.round(F.sum("usd"), 2).alias("usd"))


def _group_sql() -> str:
    from .detection import GROUP_EMITTED

    return tables.with_ctes("ev", "SELECT g.event_id, len(g.wallets) AS n_wallets, round(g.window_usd, 4) AS window_usd FROM groups g JOIN emitted e USING (chain, pool, type, us)", GROUP_EMITTED, recursive=True)


@query(_group_sql())
def stm4_wallet_alert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of wallets that act together, from state; the gates and results of the batch job."""
    path = _scratch(spark)
    stream = event_stream(spark, sf_dir, path).select("chain", "pool", "type", "event_id", "ts", "us", "wallet", "usd")
    rows = jobs.run_once(jobs.wallet_alerts(stream, min_usd=250.0, limit=0.5, late="2 hours"), f"{path}/out", f"{path}/checkpoint")
    return rows.withColumn("window_usd", F.round("window_usd", 4))


@query(
    tables.with_ctes(
        "ev",
        "SELECT e.event_id, e.us // 3600000000 < o.hour AS late FROM ev e LEFT JOIN opened o USING (chain, pool, type) WHERE e.event_id % 10 = 0 UNION ALL SELECT event_id, false FROM ev WHERE event_id % 10 <> 0",
        "opened AS (SELECT chain, pool, type, max(us // 3600000000) AS hour FROM ev WHERE event_id % 10 <> 0 GROUP BY ALL)",
    )
)
def stm7_stm10_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the events arrives after the rest, when the stream is started again from its checkpoint."""
    path = _scratch(spark)
    ev = tables.events(spark, sf_dir)
    for part in ("event_id % 10 <> 0", "event_id % 10 = 0"):
        ev.where(part).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(ev.schema).parquet(f"{path}/in").select("chain", "pool", "type", "event_id", "us", "usd")
        rows = jobs.run_once(jobs.score(stream), f"{path}/out", f"{path}/checkpoint")
    return rows.select("event_id", "late")


@query(tables.with_ctes("pay", "SELECT chain, '0x' || payment_id AS tx_hash, round(amount, 4) AS amount, block_number, us FROM pay"))
def src10_persisted_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments appended to their table by chain and read with its schema."""
    path = f"{_scratch(spark)}/payments"
    pay = tables.payments(spark, sf_dir).select("chain", F.concat(F.lit("0x"), "payment_id").alias("tx_hash"), F.lit(0).alias("log_index"), "from_address", "amount", "block_number", F.timestamp_micros("us").alias("ts"))
    io.append_table(pay, path, schemas.PAYMENTS, "chain")
    return io.read_table(spark, path, schemas.PAYMENTS).select("chain", "tx_hash", F.round("amount", 4).alias("amount"), "block_number", F.unix_micros("ts").alias("us"))


BURSTS = """gaps AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY chain, pool ORDER BY us) < 1800000000 THEN 0 ELSE 1 END AS starts FROM ev),
sessions AS (SELECT *, sum(starts) OVER (PARTITION BY chain, pool ORDER BY us) AS session FROM gaps)"""


@query(tables.with_ctes("ev", "SELECT chain, pool, min(us) AS start_us, count(*) AS n, round(sum(usd), 4) AS usd FROM sessions GROUP BY chain, pool, session", BURSTS))
def stm11_session_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.bursts(tables.events(spark, sf_dir), ("chain", "pool")).withColumn("usd", F.round("usd", 4))


@query(tables.with_ctes("ev", "SELECT event_id, chain, tx, pool, round(usd, 2) AS usd FROM ev WHERE us + 300000000 <= 1705320000000000"))
def stm8_stm9_delayed_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sweep over queued payloads that passes those whose hold of five minutes is over."""
    path = _scratch(spark)
    tables.events(spark, sf_dir).select(payloads.event_payload().alias("value")).write.text(f"{path}/queue")
    ready = payloads.read_events(io.event_stream(spark, path=f"{path}/queue")).where("us + 300000000 <= 1705320000000000")
    rows = jobs.run_once(ready, f"{path}/out", f"{path}/checkpoint")
    return rows.select(F.substring("tx", 5, 20).cast("bigint").alias("event_id"), "chain", "tx", "pool", "usd")


@query(tables.with_ctes("sig", "SELECT id, chain, protocol, pool, signal_type, confidence, round(z_score, 4) AS z_score, detected_us FROM sig"))
def src6_src10_persisted_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal payloads parsed, appended to their table and read with its schema."""
    path = f"{_scratch(spark)}/signals"
    io.persist_signals(io.parse_signals(tables.signals(spark, sf_dir).select(payloads.signal_payload().alias("value"))), path)
    rows = io.read_table(spark, path, schemas.SIGNALS)
    return rows.select("id", "chain", "protocol", "pool", "signal_type", "confidence", F.round("z_score", 4).alias("z_score"), F.unix_micros("detected_at").alias("detected_us"))


@query(tables.with_ctes("sig", "SELECT chain, protocol, count(*) AS n FROM sig GROUP BY ALL"))
def src9_srt4_json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written as JSON lines, largest first, and read back."""
    path = f"{_scratch(spark)}/report"
    io.write_report(tables.signals(spark, sf_dir).groupBy("chain", "protocol").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "chain", "protocol"), path)
    return spark.read.schema("chain string, protocol string, n long").json(path)
