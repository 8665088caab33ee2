"""Events to baselines, z-scores and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import baseline, classify, greedy, multiwallet, reports, sketches
from ..sources import tables
from .registry import query

MINUTE = 60_000_000
SOLO_USD, GROUP_USD, WHALE_USD, Z, COOLDOWN = 100.0, 250.0, 400.0, 2.5, 30 * MINUTE
OVERRIDES = {"mantle": 2.0, "ethereum": 3.0}
LIMIT_SQL = "CASE chain WHEN 'mantle' THEN 2.0 WHEN 'ethereum' THEN 3.0 ELSE 2.5 END"

HOURLY = "hourly AS (SELECT chain, pool, type, us // 3600000000 AS hour, sum(usd) AS volume FROM ev GROUP BY ALL)"
#: Written as a join of hours, not as a window, and over explicit moments.
BASE = (
    HOURLY
    + """,
firsts AS (SELECT chain, pool, type, min(hour) AS first_hour FROM hourly GROUP BY ALL),
base AS (
    SELECT h.chain, h.pool, h.type, h.hour, h.volume, least(336, h.hour - f.first_hour) AS n, count(p.volume) AS filled, count(p.volume) FILTER (WHERE p.volume <> 0) AS nonzero_hours,
        coalesce(avg(p.volume), 0) AS m, coalesce(var_pop(p.volume), 0) AS v, coalesce(min(p.volume) = max(p.volume), false) AS level
    FROM hourly h JOIN firsts f USING (chain, pool, type)
    LEFT JOIN hourly p ON p.chain = h.chain AND p.pool = h.pool AND p.type = h.type AND p.hour BETWEEN h.hour - 336 AND h.hour - 1
    GROUP BY h.chain, h.pool, h.type, h.hour, h.volume, f.first_hour
), moments AS (
    SELECT *, CASE WHEN n > 0 THEN m * filled / n ELSE 0 END AS baseline_mean,
        CASE WHEN n >= 24 AND filled > 0 AND NOT (level AND filled = n) THEN sqrt((v * filled + m * m * filled * (n - filled) / n) / n) END AS baseline_std
    FROM base
), scored AS (
    SELECT ev.*, mo.baseline_mean, mo.baseline_std, (ev.usd - mo.baseline_mean) / mo.baseline_std AS z
    FROM ev LEFT JOIN moments mo ON ev.chain = mo.chain AND ev.pool = mo.pool AND ev.type = mo.type AND ev.us // 3600000000 = mo.hour
)"""
)
ELIGIBLE = f"""eligible AS (SELECT * FROM scored WHERE z >= {Z} AND usd >= {SOLO_USD})"""


def scored_events(spark: SparkSession, sf_dir: str, overrides: dict[str, float] | None = None) -> DataFrame:
    ev = tables.events(spark, sf_dir)
    hours = baseline.rolling_baseline(baseline.hourly_volume(ev))
    return baseline.score_events(ev, hours, limit=baseline.threshold(Z, overrides))


def solo_emitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solo anomalies after the cooldown of their wallet, pool and type."""
    eligible = baseline.solo_eligible(scored_events(spark, sf_dir), SOLO_USD)
    return greedy.emit_with_cooldown(eligible, ("chain", "wallet", "pool", "type"), COOLDOWN)


def group_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = multiwallet.wallet_windows(scored_events(spark, sf_dir), listed=15)
    return multiwallet.coordinated(windows, GROUP_USD, 0.5)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of single wallets, with a baseline per event type so that small inputs have one."""
    ev = tables.events(spark, sf_dir)
    key = ("pool", "type")
    hours = baseline.rolling_baseline(baseline.hourly_volume(ev, key), key)
    eligible = baseline.solo_eligible(baseline.score_events(ev, hours, key), SOLO_USD)
    return classify.solo_candidates(eligible, WHALE_USD)


@query(tables.with_ctes("ev", "SELECT chain, pool, type, hour, round(volume, 4) AS volume FROM hourly", HOURLY))
def agg1_hourly_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.hourly_volume(tables.events(spark, sf_dir)).withColumn("volume", F.round("volume", 4))


@query(tables.with_ctes("ev", "SELECT chain, pool, type, hour, n, nonzero_hours, round(baseline_mean + 1e-9, 4) AS baseline_mean, round(baseline_std, 4) AS baseline_std FROM moments", BASE))
def agg2_win1_rolling_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = baseline.rolling_baseline(baseline.hourly_volume(tables.events(spark, sf_dir)))
    return hours.select("chain", "pool", "type", "hour", "n", "nonzero_hours", F.round(F.col("baseline_mean") + 1e-9, 4).alias("baseline_mean"), F.round("baseline_std", 4).alias("baseline_std"))


@query(
    tables.with_ctes(
        "ev",
        f"SELECT event_id, round(z, 4) AS z, round(baseline_mean + 1e-9, 4) AS baseline_mean, round(baseline_std, 4) AS baseline_std, coalesce(z >= {LIMIT_SQL}, false) AS is_anomaly, type IN ('swap', 'mint') AS is_buy, type = 'burn' AS is_sell FROM scored",
        BASE,
    )
)
def win2_flt6_flt14_scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify.with_sides(scored_events(spark, sf_dir, OVERRIDES))
    return rows.select("event_id", F.round(F.col("baseline_mean") + 1e-9, 4).alias("baseline_mean"), *[F.round(c, 4).alias(c) for c in ("z", "baseline_std")], "is_anomaly", "is_buy", "is_sell")


@query(
    tables.with_ctes(
        "ev",
        "SELECT chain, pool, type, hour, round(volume, 4) AS volume FROM hourly",
        HOURLY,
    )
)
def src5_seeded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History and live events together give the volumes of all events."""
    ev = tables.events(spark, sf_dir)
    split = 1_705_000_000_000_000
    return baseline.seeded(ev.where(F.col("us") < split), ev.where(F.col("us") >= split)).withColumn("volume", F.round("volume", 4))


@query(
    tables.with_ctes(
        "ev",
        f"SELECT event_id, wallet, CASE type WHEN 'swap' THEN CASE WHEN usd > {WHALE_USD} THEN 'whale_entry' ELSE 'accumulation' END WHEN 'mint' THEN 'liquidity_added' WHEN 'burn' THEN 'liquidity_removed' ELSE 'unusual_volume' END AS signal_type, round(usd, 4) AS usd, round(z, 4) AS z FROM eligible WHERE usd >= CASE chain WHEN 'arbitrum' THEN 150 ELSE 0 END",
        f"{BASE},\n{ELIGIBLE}",
    )
)
def flt7_mth1_solo_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = baseline.solo_eligible(scored_events(spark, sf_dir), SOLO_USD, {"arbitrum": 150.0})
    return rows.select("event_id", "wallet", classify.signal_type("type", "usd", WHALE_USD).alias("signal_type"), F.round("usd", 4).alias("usd"), F.round("z", 4).alias("z"))


@query(
    tables.with_ctes(
        "ev",
        f"""SELECT event_id, wallet, round(usd, 4) AS usd FROM eligible JOIN emitted USING (chain, wallet, pool, type, us)""",
        f"""{BASE},\n{ELIGIBLE}, emitted AS (
    SELECT chain, wallet, pool, type, min(us) AS us FROM eligible GROUP BY ALL
    UNION ALL
    SELECT e.chain, e.wallet, e.pool, e.type, min(n.us) FROM emitted e JOIN eligible n ON n.chain = e.chain AND n.wallet = e.wallet AND n.pool = e.pool AND n.type = e.type AND n.us >= e.us + {COOLDOWN} GROUP BY e.chain, e.wallet, e.pool, e.type, e.us
)""",
        recursive=True,
    )
)
def grd1_solo_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solo_emitted(spark, sf_dir).select("event_id", "wallet", F.round("usd", 4).alias("usd"))


WINDOWS = """windows AS (
    SELECT a.event_id, a.chain, a.pool, a.type, a.us, a.baseline_mean, a.baseline_std, list_sort(list(DISTINCT b.wallet)) AS wallets, sum(b.usd) AS window_usd, count(*) AS n_events, min(b.us) AS first_us, max(b.us) AS last_us
    FROM scored a JOIN scored b ON a.chain = b.chain AND a.pool = b.pool AND a.type = b.type AND b.us BETWEEN a.us - 1800000000 AND a.us
    WHERE a.z IS NOT NULL AND b.z IS NOT NULL GROUP BY ALL
)"""
GROUPS = f"""{WINDOWS}, groups AS (
    SELECT *, (window_usd - baseline_mean) / baseline_std AS z_window FROM windows
    WHERE len(wallets) BETWEEN 2 AND 15 AND window_usd >= {GROUP_USD} AND type <> 'transfer' AND (window_usd - baseline_mean) / baseline_std >= 0.5
)"""


@query(tables.with_ctes("ev", "SELECT event_id, len(wallets) AS n_wallets, array_to_string(wallets, ',') AS wallets, round(window_usd, 4) AS window_usd, n_events, first_us, last_us, round((window_usd - baseline_mean) / baseline_std, 4) AS z_window FROM windows", f"{BASE},\n{WINDOWS}"))
def win3_wallet_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = multiwallet.wallet_windows(scored_events(spark, sf_dir))
    return rows.select("event_id", F.col("n_wallets").cast("long").alias("n_wallets"), F.array_join("wallets", ",").alias("wallets"), F.round("window_usd", 4).alias("window_usd"), "n_events", "first_us", "last_us", F.round("z_window", 4).alias("z_window"))


@query(tables.with_ctes("ev", "SELECT event_id, len(wallets) AS n_wallets, round(window_usd, 4) AS window_usd, n_events, first_us FROM windows", f"{BASE},\n{WINDOWS}"))
def win3_exact_wallet_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows by order of arrival, newest 500 events at most."""
    rows = multiwallet.exact_wallet_windows(scored_events(spark, sf_dir), order=("us", "event_id"))
    return rows.select("event_id", "n_wallets", F.round("window_usd", 4).alias("window_usd"), "n_events", "first_us")


@query(tables.with_ctes("ev", "SELECT event_id, len(wallets) AS n_wallets, round(window_usd, 4) AS window_usd, round(z_window, 4) AS z_window FROM groups", f"{BASE},\n{GROUPS}"))
def flt8_flt9_coordinated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = group_eligible(spark, sf_dir)
    return rows.select("event_id", F.col("n_wallets").cast("long").alias("n_wallets"), F.round("window_usd", 4).alias("window_usd"), F.round("z_window", 4).alias("z_window"))


#: Emission with the wallet sets remembered for as long as the cooldown, its end included.
GROUP_EMITTED = f"""{BASE},\n{GROUPS}, emitted AS (
    SELECT chain, pool, type, min(us) AS us, arg_min(wallets, us) AS wallets FROM groups GROUP BY ALL
    UNION ALL
    SELECT e.chain, e.pool, e.type, min(n.us), arg_min(n.wallets, n.us) FROM emitted e JOIN groups n ON n.chain = e.chain AND n.pool = e.pool AND n.type = e.type AND n.us >= e.us + {COOLDOWN}
        AND NOT (n.us = e.us + {COOLDOWN} AND n.wallets = e.wallets) GROUP BY e.chain, e.pool, e.type, e.us
)"""


@query(tables.with_ctes("ev", "SELECT g.event_id, round(g.window_usd, 4) AS window_usd, g.n_events FROM groups g JOIN emitted e USING (chain, pool, type, us)", GROUP_EMITTED, recursive=True))
def grd2_group_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = greedy.emit_with_cooldown(group_eligible(spark, sf_dir), ("chain", "pool", "type"), COOLDOWN, signature="wallets")
    return rows.select("event_id", F.round("window_usd", 4).alias("window_usd"), "n_events")


KIND_SQL = f"CASE type WHEN 'swap' THEN CASE WHEN usd > {WHALE_USD} THEN 'whale_entry' ELSE 'accumulation' END WHEN 'mint' THEN 'liquidity_added' WHEN 'burn' THEN 'liquidity_removed' ELSE 'unusual_volume' END"
SOLO_EMITTED = f"""{ELIGIBLE}, solo AS (
    SELECT chain, wallet, pool, type, min(us) AS us FROM eligible GROUP BY ALL
    UNION ALL
    SELECT e.chain, e.wallet, e.pool, e.type, min(n.us) FROM solo e JOIN eligible n ON n.chain = e.chain AND n.wallet = e.wallet AND n.pool = e.pool AND n.type = e.type AND n.us >= e.us + {COOLDOWN} GROUP BY e.chain, e.wallet, e.pool, e.type, e.us
), both_kinds AS (
    SELECT e.chain, e.protocol, e.pool, e.type, e.wallet AS wallets, e.usd, e.z, 1 AS event_count, e.us AS first_us, e.us AS last_us FROM eligible e JOIN solo USING (chain, wallet, pool, type, us)
    UNION ALL
    SELECT g.chain, v.protocol, g.pool, g.type, array_to_string(g.wallets, ','), g.window_usd, g.z_window, g.n_events, g.first_us, g.last_us FROM groups g JOIN emitted m USING (chain, pool, type, us) JOIN ev v ON v.event_id = g.event_id
)"""


@query(
    tables.with_ctes(
        "ev",
        f"SELECT chain, protocol, pool, type, wallets, round(usd, 4) AS total_volume_usd, round(z, 4) AS z_score, event_count, first_us, last_us, {KIND_SQL} AS signal_type FROM both_kinds",
        f"{GROUP_EMITTED},\n{SOLO_EMITTED}",
        recursive=True,
    )
)
def set4_all_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solo and multi-wallet candidates together."""
    groups = greedy.emit_with_cooldown(group_eligible(spark, sf_dir), ("chain", "pool", "type"), COOLDOWN, signature="wallets")
    return _plain(classify.candidates(solo_emitted(spark, sf_dir), groups, WHALE_USD))


def _plain(rows: DataFrame) -> DataFrame:
    """Wallets as text and rounded numbers, for comparison."""
    return rows.withColumns({"wallets": F.array_join("wallets", ","), "total_volume_usd": F.round("total_volume_usd", 4), "z_score": F.round("z_score", 4)})


#: Anchors are walked one by one with the list of the wallets that their key has clustered.
ANCHORS = f"""flagged AS (
    SELECT *, row_number() OVER (PARTITION BY chain, pool, type ORDER BY us, event_id) AS k FROM scored WHERE z >= {Z}
), anchored AS (
    SELECT a.chain, a.pool, a.type, a.k, a.us AS first_us, list_sort(list(DISTINCT b.wallet)) AS held, sum(b.usd) AS usd, max(b.z) AS z, count(*) AS n, max(b.us) AS last_us
    FROM flagged a JOIN flagged b ON a.chain = b.chain AND a.pool = b.pool AND a.type = b.type AND b.k >= a.k AND b.us <= a.us + 1800000000 GROUP BY ALL
), walk AS (
    SELECT chain, pool, type, k, held AS fresh, CASE WHEN len(held) >= 2 THEN held ELSE CAST([] AS VARCHAR[]) END AS known FROM anchored WHERE k = 1
    UNION ALL
    SELECT chain, pool, type, k, fresh, CASE WHEN len(fresh) >= 2 THEN list_concat(known, fresh) ELSE known END FROM (
        SELECT a.chain, a.pool, a.type, a.k, list_filter(a.held, lambda x: NOT list_contains(w.known, x)) AS fresh, w.known FROM walk w JOIN anchored a ON a.chain = w.chain AND a.pool = w.pool AND a.type = w.type AND a.k = w.k + 1)
), multi AS (
    SELECT w.chain, w.pool, w.type, w.fresh, a.usd, a.z, a.n, a.first_us, a.last_us FROM walk w JOIN anchored a USING (chain, pool, type, k) WHERE len(w.fresh) >= 2
), key_starts AS (
    SELECT chain, pool, type, min(us) AS key_first FROM flagged GROUP BY ALL
), clustered AS (
    SELECT wallet, min(key_first) AS since FROM (SELECT unnest(fresh) AS wallet, key_first FROM multi JOIN key_starts USING (chain, pool, type)) GROUP BY wallet
), clusters AS (
    SELECT chain, pool, type, array_to_string(fresh, ',') AS wallets, usd, z, n, first_us, last_us FROM multi
    UNION ALL
    SELECT f.chain, f.pool, f.type, f.wallet, f.usd, f.z, 1, f.us, f.us FROM flagged f JOIN key_starts s USING (chain, pool, type) LEFT JOIN clustered c ON c.wallet = f.wallet
    WHERE f.z >= 4 AND (c.since IS NULL OR c.since > s.key_first)
)"""


@query(tables.with_ctes("ev", "SELECT chain, pool, type, wallets, round(usd, 4) AS total_volume_usd, round(z, 4) AS z_score, n AS event_count, first_us, last_us FROM clusters", f"{BASE},\n{ANCHORS}", recursive=True))
def grd3_batch_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = scored_events(spark, sf_dir).where("is_anomaly")
    return _plain(greedy.anchor_clusters(flagged))


@query(
    tables.with_ctes(
        "ev",
        "SELECT pool, type, us // 3600000000 AS hour, array_to_string(list_sort(list(DISTINCT wallet)), ',') AS wallets, round(sum(usd), 4) AS total_volume_usd, round(max(z), 4) AS z_score, count(*) AS event_count, min(us) AS first_us, max(us) AS last_us FROM scored WHERE z IS NOT NULL GROUP BY pool, type, us // 3600000000",
        BASE,
    )
)
def agg3_arr2_cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_events(spark, sf_dir).where("z is not null")
    found = multiwallet.cluster_summary(rows, ("pool", "type", "hour"))
    return found.withColumns({"wallets": F.array_join("wallets", ","), "total_volume_usd": F.round("total_volume_usd", 4), "z_score": F.round("z_score", 4)})


@query(tables.with_ctes("ev", f"SELECT chain, count(*) AS scored, count(*) FILTER (WHERE z >= {Z}) AS flagged, round(100 * count(*) FILTER (WHERE z >= {Z}) / greatest(count(*), 1), 2) AS flag_rate FROM scored GROUP BY ROLLUP (chain)", BASE))
def agg15_scoring_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.scoring_stats(scored_events(spark, sf_dir))


@query(tables.with_ctes("ev", "SELECT chain, us // 86400000000 AS day, count(DISTINCT wallet) AS wallets, true AS within FROM ev GROUP BY ALL"))
def agg18_merged_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct wallets of a day from its hours' sketches, against the exact count."""
    ev = tables.events(spark, sf_dir)
    hours = sketches.hourly_sketches(ev, "wallet", ("chain",))
    days = sketches.merged(hours, "chain", F.floor(F.col("hour") / 24).alias("day"))
    exact = ev.groupBy("chain", F.floor(F.col("us") / 86_400_000_000).alias("day")).agg(F.countDistinct("wallet").alias("wallets"))
    near = F.abs(F.col("distinct") - F.col("wallets")) <= 3 * sketches.standard_error() * F.col("wallets")
    return exact.join(days, ["chain", "day"]).select("chain", "day", "wallets", near.alias("within"))


@query(tables.with_ctes("ev", "SELECT count(DISTINCT (chain, pool, type)) AS baseline_keys, count(DISTINCT pool) AS pools FROM ev"))
def agg18_distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.events(spark, sf_dir).agg(F.countDistinct("chain", "pool", "type").alias("baseline_keys"), F.countDistinct("pool").alias("pools"))


@query(tables.with_ctes("ev", "SELECT event_id, us FROM ev ORDER BY us DESC, event_id DESC LIMIT 1000"))
def src8_newest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.newest(tables.events(spark, sf_dir), 1000, "us", "event_id").select("event_id", "us")


@query(tables.with_ctes("ev", "SELECT event_id, us FROM ev ORDER BY us, event_id LIMIT 5000"))
def src8_oldest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.oldest(tables.events(spark, sf_dir), 5000, "us", "event_id").select("event_id", "us")


BIG = "big AS (SELECT l_suppkey % 100 AS pool, date_trunc('day', l_shipdate) AS day, l_extendedprice AS usd, l_partkey AS wallet FROM lineitem)"


@query(f"WITH {BIG} SELECT pool, epoch_us(day) // 86400000000 AS day, round(sum(usd), 2) AS volume, count(*) AS n, count(DISTINCT wallet) AS wallets FROM big GROUP BY ALL")
def agg1_pool_day_volume_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume by pool and day over the largest table."""
    big = tables.read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 100).alias("pool"), F.floor(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 86_400_000_000).alias("day"), F.col("l_extendedprice").alias("usd"), F.col("l_partkey").alias("wallet"))
    return big.groupBy("pool", "day").agg(F.round(F.sum("usd"), 2).alias("volume"), F.count("*").alias("n"), F.countDistinct("wallet").alias("wallets"))
