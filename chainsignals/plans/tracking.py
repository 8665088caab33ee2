"""Signals to outcomes, hit rates, wallet records and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify, outcomes, prices, reports
from ..sources import dims, tables
from .registry import query

NOW_US = 1_706_659_200_000_000  # 2024-01-31 00:00 UTC
POOL_ASSETS = [("arbitrum", "0xPOOL_purchase", "arb"), ("ethereum", "0xpool_purchase", "wbtc")]
CHAIN_ASSETS = list(dims.CHAIN_ASSET.items())
STATIC = [("mantle", 100.0), ("arbitrum", 100.0), ("hashkey", 100.0)]

STEPS = "steps(horizon, after) AS (VALUES ('1h', 3600000000), ('4h', 14400000000), ('24h', 86400000000), ('7d', 604800000000))"
OUT = f"""{STEPS},
entered AS (SELECT sig.*, t.price AS entry_price FROM sig ASOF LEFT JOIN ticks t ON sig.chain = t.chain AND sig.detected_us >= t.us),
due AS (SELECT entered.*, horizon, detected_us + after AS due_us FROM entered, steps),
priced AS (SELECT due.*, t.price AS exit_price FROM due ASOF LEFT JOIN ticks t ON due.chain = t.chain AND due.due_us >= t.us),
outc AS (
    SELECT * EXCLUDE (exit_price), CASE WHEN due_us > {NOW_US} THEN 'pending' WHEN exit_price IS NULL OR entry_price IS NULL THEN 'failed' ELSE 'completed' END AS status,
        CASE WHEN due_us <= {NOW_US} AND exit_price IS NOT NULL AND entry_price IS NOT NULL THEN exit_price END AS price,
        CASE WHEN due_us <= {NOW_US} AND entry_price <> 0 THEN round((exit_price - entry_price) / entry_price * 100, 4) END AS pct_change
    FROM priced
), hits AS (
    SELECT *, CASE WHEN pct_change IS NULL THEN NULL WHEN signal_type IN ('accumulation', 'whale_entry') THEN pct_change > 0 WHEN signal_type IN ('distribution', 'whale_exit') THEN pct_change < 0 END AS hit FROM outc
)"""


def outcome_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.resolve_outcomes(tables.signals(spark, sf_dir), tables.price_ticks(spark, sf_dir), NOW_US)


@query(tables.with_ctes("sig", "SELECT id, CASE WHEN chain = 'arbitrum' THEN 'arb' WHEN chain = 'ethereum' THEN 'wbtc' WHEN chain = 'mantle' THEN 'mnt' ELSE 'eth' END AS price_key FROM sig"))
def jn4_tracked_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = spark.createDataFrame(POOL_ASSETS, "chain string, pool string, price_key string")
    chains = spark.createDataFrame(CHAIN_ASSETS, "chain string, price_key string")
    return outcomes.tracked_asset(tables.signals(spark, sf_dir), pools, chains).select("id", "price_key")


@query(tables.with_ctes("sig ticks", "SELECT id, entry_price, t_us AS entry_price_us FROM (SELECT sig.id, t.price AS entry_price, t.us AS t_us FROM sig ASOF LEFT JOIN ticks t ON sig.chain = t.chain AND sig.detected_us >= t.us)"))
def jn5_entry_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last price of the chain at the time of a signal."""
    rows = prices.asof(tables.signals(spark, sf_dir), tables.price_ticks(spark, sf_dir), ("chain",), at="detected_us", out="entry_price")
    return rows.select("id", "entry_price", "entry_price_us")


@query(
    tables.with_ctes(
        "ev ticks",
        """SELECT event_id, coalesce(CASE WHEN us - t_us <= 1800000000 THEN t_price END, CASE WHEN chain <> 'ethereum' THEN 100 END, 0) AS price
FROM (SELECT ev.event_id, ev.chain, ev.us, t.us AS t_us, t.price AS t_price FROM ev ASOF LEFT JOIN ticks t ON ev.chain = t.chain AND ev.us >= t.us)""",
    )
)
def jn3_live_or_static_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price of every event: a tick of the last half hour, else the static one, else 0."""
    static = spark.createDataFrame(STATIC, "chain string, price double")
    rows = prices.live_or_static(tables.events(spark, sf_dir), tables.price_ticks(spark, sf_dir), static, ("chain",), max_age_us=1_800_000_000)
    return rows.select("event_id", "price")


@query(tables.with_ctes("sig ticks", "SELECT id, horizon, due_us, status, round(entry_price, 4) AS entry_price, round(price, 4) AS price, pct_change, hit FROM hits", OUT))
def jn6_arr1_mth2_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outcome_rows(spark, sf_dir)
    return rows.select("id", "horizon", "due_us", "status", F.round("entry_price", 4).alias("entry_price"), F.round("price", 4).alias("price"), "pct_change", classify.is_hit().alias("hit"))


@query(tables.with_ctes("sig ticks", f"SELECT id, horizon, due_us FROM outc WHERE due_us <= {NOW_US - 86_400_000_000}", OUT))
def flt13_due_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = outcomes.horizons(tables.signals(spark, sf_dir)).withColumn("status", F.lit("pending"))
    return outcomes.due_outcomes(pending, NOW_US - 86_400_000_000).select("id", "horizon", "due_us")


@query(tables.with_ctes("sig ticks", "SELECT id, string_agg(horizon || ':' || status || ':' || coalesce(format('{:.4f}', pct_change), ''), ',' ORDER BY due_us) AS outcomes FROM outc GROUP BY id", OUT))
def jn8_signals_with_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outcomes.with_outcomes(tables.signals(spark, sf_dir), outcome_rows(spark, sf_dir))
    text = F.transform("outcomes", lambda o: F.concat(o.horizon, F.lit(":"), o.status, F.lit(":"), F.when(o.pct_change.isNull(), "").otherwise(F.format_string("%.4f", o.pct_change))))
    return rows.select("id", F.array_join(text, ",").alias("outcomes"))


REPORT = """SELECT dimension, value, n, scored, hits, round(100 * hits / nullif(scored, 0), 1) AS hit_rate, round(pct / n + 1e-9, 3) AS avg_pct FROM (
    SELECT CASE WHEN NOT grouping(horizon) THEN 'horizon' WHEN NOT grouping(chain) THEN 'chain' WHEN NOT grouping(protocol) THEN 'protocol' WHEN NOT grouping(signal_type) THEN 'signal_type' ELSE 'total' END AS dimension,
        coalesce(horizon, chain, protocol, signal_type, 'all') AS value, count(*) AS n, count(hit) AS scored, count(*) FILTER (WHERE hit) AS hits, sum(coalesce(pct_change, 0)) AS pct
    FROM hits WHERE status = 'completed' GROUP BY GROUPING SETS ((horizon), (chain), (protocol), (signal_type), ())
)""".replace("NOT grouping", "0 = grouping")


@query(tables.with_ctes("sig ticks", REPORT, OUT))
def agg4_jn7_track_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.track_report(outcome_rows(spark, sf_dir))


#: The overall row is that of all horizons.
DAY_REPORT = f"""SELECT * FROM ({REPORT.replace("status = 'completed'", "status = 'completed' AND horizon = '24h'")}) WHERE dimension <> 'total' UNION ALL SELECT * FROM ({REPORT}) WHERE dimension = 'total'"""


@query(tables.with_ctes("sig ticks", DAY_REPORT, OUT))
def agg4_horizon_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of one horizon."""
    return outcomes.track_report(outcome_rows(spark, sf_dir), horizon="24h")


@query(
    tables.with_ctes(
        "sig ticks",
        """SELECT chain, signals, coalesce(resolved, 0) AS resolved, coalesce(hits, 0) AS hits, round(hits / nullif(resolved, 0), 4) AS hit_rate FROM (SELECT chain, count(*) AS signals FROM sig GROUP BY chain)
LEFT JOIN (SELECT chain, count(*) AS resolved, count(*) FILTER (WHERE hit) AS hits FROM hits WHERE horizon = '24h' AND hit IS NOT NULL GROUP BY chain) USING (chain)""",
        OUT,
    )
)
def agg5_api_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.api_stats(tables.signals(spark, sf_dir), outcome_rows(spark, sf_dir))


RECORDS = """records AS (SELECT wallet, count(*) AS total, count(*) FILTER (WHERE hit) AS hits FROM (SELECT lower(unnest(wallets)) AS wallet, hit FROM hits WHERE horizon = '24h' AND hit IS NOT NULL) GROUP BY wallet)"""


@query(tables.with_ctes("sig ticks", "SELECT wallet, total, hits, CASE WHEN total >= 3 THEN hits / total >= 0.65 END AS is_smart FROM records", f"{OUT}, {RECORDS}"))
def agg6_agg7_wallet_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.wallet_records(outcome_rows(spark, sf_dir))


@query(
    tables.with_ctes(
        "sig ticks",
        """SELECT s.id, count(*) FILTER (WHERE coalesce(CASE WHEN total >= 3 THEN hits / total >= 0.5 END, right(w, 1) = '7', false)) AS smart_money_count
FROM (SELECT id, unnest(wallets[1:5]) AS w FROM sig) s LEFT JOIN records r ON r.wallet = lower(s.w) GROUP BY s.id""",
        f"{OUT}, {RECORDS}",
    )
)
def jn15_smart_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own record first; a vendor's label, here for wallets that end in 7, where it is unknown."""
    sig = tables.signals(spark, sf_dir)
    records = outcomes.wallet_records(outcome_rows(spark, sf_dir), min_rate=0.5)
    vendor = sig.select(F.explode("wallets").alias("wallet")).distinct().select("wallet", (F.right("wallet", F.lit(1)) == "7").alias("is_smart"))
    return outcomes.smart_money(sig, records, vendor).select("id", "smart_money_count")


@query(tables.with_ctes("sig", f"SELECT day, signals, CAST(sum(signals) OVER (ORDER BY day) AS BIGINT) AS cumulative FROM (SELECT detected_us // 86400000000 AS day, count(*) AS signals FROM sig WHERE detected_us >= {NOW_US} - 30 * 86400000000 GROUP BY ALL)"))
def agg8_win5_signals_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.daily_counts(tables.signals(spark, sf_dir), days=30, now_us=NOW_US)


@query(tables.with_ctes("sig", "SELECT label, signals, round(100 * signals / sum(signals) OVER (), 1) AS pct FROM (SELECT CASE protocol WHEN 'agni_finance' THEN 'Agni Finance' WHEN 'gmx' THEN 'GMX' ELSE protocol END AS label, count(*) AS signals FROM sig GROUP BY 1)"))
def agg9_win6_protocol_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = dims.lookup({"agni_finance": "Agni Finance", "gmx": "GMX"}, F.col("protocol"), F.col("protocol"))
    return reports.shares(tables.signals(spark, sf_dir), label, "label")


@query(tables.with_ctes("sig", "SELECT chain, signals, round(100 * signals / sum(signals) OVER (), 1) AS pct FROM (SELECT chain, count(*) AS signals FROM sig GROUP BY chain)"))
def agg10_set1_chain_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the chains in their merged log, which is one table with a chain column."""
    return reports.shares(tables.signals(spark, sf_dir), F.col("chain"), "chain")


@query(tables.with_ctes("exe", "SELECT action_type, count(*) AS total, count(*) FILTER (WHERE status = 'success') AS executed, count(*) FILTER (WHERE status <> 'success') AS aborted, round(100 * count(*) FILTER (WHERE status = 'success') / count(*), 1) AS success_pct FROM exe GROUP BY action_type"))
def agg11_decision_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.executions(spark, sf_dir).withColumn("success", F.col("status") == "success")
    return reports.success_by(rows, "action_type")


@query(
    tables.with_ctes(
        "sig exe",
        f"""SELECT 'chain' AS section, chain AS name, CAST(count(*) AS DOUBLE) AS n FROM sig GROUP BY chain
UNION ALL SELECT 'protocol', protocol, count(*) FROM sig GROUP BY protocol
UNION ALL SELECT 'day', CAST(d AS VARCHAR), count(sig.id) FROM range({NOW_US} // 86400000000 - 6, {NOW_US} // 86400000000 + 1) t(d) LEFT JOIN sig ON sig.detected_us // 86400000000 = d GROUP BY d
UNION ALL SELECT 'executions', 'total', count(*) FROM exe
UNION ALL SELECT 'executions', 'success', count(*) FROM exe WHERE status = 'success'
UNION ALL SELECT 'executions', 'success_rate', round(100 * count(*) FILTER (WHERE status = 'success') / count(*), 1) FROM exe""",
    )
)
def agg12_src9_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.dashboard(tables.signals(spark, sf_dir), tables.executions(spark, sf_dir), NOW_US)


@query(tables.with_ctes("sig", "SELECT 'protocol' AS dimension, protocol AS value, count(*) AS n FROM sig GROUP BY protocol UNION ALL SELECT 'signal_type', signal_type, count(*) FROM sig GROUP BY signal_type"))
def agg13_audit_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.grouped_counters(tables.signals(spark, sf_dir), "protocol", "signal_type")


@query(tables.with_ctes("sig", "SELECT count(*) FILTER (WHERE confidence >= 50) AS enriched, count(*) FILTER (WHERE confidence BETWEEN 5 AND 49) AS discarded, count(*) FILTER (WHERE confidence < 5) AS errors, count(*) AS total FROM sig"))
def agg16_enrichment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("confidence")
    state = F.when(c >= 50, "enriched").when(c >= 5, "discarded").otherwise("errors")
    return reports.state_counts(tables.signals(spark, sf_dir), state, "enriched", "discarded", "errors")


@query(tables.with_ctes("sig", "SELECT id, detected_us + 300000000 AS deliver_us FROM sig WHERE confidence >= 50"))
def flt10_dat1_deliverable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.deliverable(tables.signals(spark, sf_dir)).select("id", "deliver_us")


MID_US = 1_705_320_000_000_000


@query(tables.with_ctes("sig", f"SELECT id, detected_us + 300000000 AS deliver_us FROM sig WHERE detected_us + 300000000 <= {MID_US}"))
def flt12_ready_for_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify.deliverable(tables.signals(spark, sf_dir), min_confidence=0)
    return reports.ready_for_delivery(rows, MID_US).select("id", "deliver_us")


@query(tables.with_ctes("sig", f"SELECT count(*) AS depth, count(*) FILTER (WHERE detected_us + 300000000 > {MID_US}) AS pending, count(*) FILTER (WHERE detected_us + 300000000 <= {MID_US}) AS ready FROM sig"))
def flt12_queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.queue_depth(classify.deliverable(tables.signals(spark, sf_dir), min_confidence=0), MID_US)


@query(tables.with_ctes("sig", "SELECT id, signal_type FROM sig WHERE id < 9000 ORDER BY id DESC LIMIT 26"))
def srt1_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.keyset_page(tables.signals(spark, sf_dir), 9000).select("id", "signal_type")


@query(tables.with_ctes("sig", "SELECT id FROM sig ORDER BY id DESC LIMIT 100 OFFSET 50"))
def srt3_offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.offset_page(tables.signals(spark, sf_dir), 50, 200).select("id")


@query(tables.with_ctes("exe", "SELECT execution_id, us FROM exe ORDER BY us DESC, execution_id DESC LIMIT 20"))
def srt2_recent_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.newest(tables.executions(spark, sf_dir), 20, "us", "execution_id").select("execution_id", "us")


@query(tables.with_ctes("sig", "SELECT id, chain, confidence FROM sig WHERE chain = 'mantle' AND signal_type = 'whale_entry' AND confidence >= 30 AND detected_us >= 1704500000000000"))
def flt11_signal_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.matching import feed

    return feed(tables.signals(spark, sf_dir), "mantle", "whale_entry", 30, 1_704_500_000_000_000).select("id", "chain", "confidence")
