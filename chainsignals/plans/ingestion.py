"""Raw logs, made of the event table, to decoded and priced events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payloads, words
from ..functions.addresses import padded_topic
from ..operators import decoding
from ..sources import dims, io, log_store, tables
from .registry import query

USDC, WETH, WBTC = "0x" + "1" * 40, "0x" + "2" * 40, "0x" + "3" * 40
KINDS = {"click": "agni_swap", "view": "v3_swap", "purchase": "mint", "signup": "burn", "error": "transfer"}
MORE_KINDS = {"click": "lb_swap", "view": "gmx_swap", "purchase": "gmx_increase", "signup": "gmx_decrease", "error": "v3_swap"}
PRICES = [("usdc", 1.0), ("eth", 2.0), ("mnt", 0.5)]


def pools(spark: SparkSession) -> DataFrame:
    """A pool for each event type and chain; the one for errors on ethereum has no tokens."""
    rows = [(c, f"0xpool_{e}", "gmx" if e == "view" else "uniswap_v3", USDC, WETH) for c in dims.CHAINS for e in KINDS]
    rows = [(c, p, q, None, None) if (c, p) == ("ethereum", "0xpool_error") else (c, p, q, a, b) for c, p, q, a, b in rows]
    return spark.createDataFrame(rows, "chain string, pool string, protocol string, token0 string, token1 string")


def tokens(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(USDC, "usdc", 6), (WETH, "eth", 6), (WBTC, "wbtc", 8)], "address string, price_key string, decimals int")


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, k, p) for c in dims.CHAINS for k, p in PRICES], "chain string, price_key string, price double")


def hex_word(x: Column) -> Column:
    """A bigint as a 32-byte word, sign-extended."""
    return F.when(x < 0, F.lpad(F.lower(F.hex(x)), 64, "f")).otherwise(F.lpad(F.lower(F.hex(x)), 64, "0"))


def raw_logs(spark: SparkSession, sf_dir: str, kinds: dict[str, str] = KINDS) -> DataFrame:
    """A log for each event: the first leg is its value in micro-dollars, the second a tenth.

    Odd events give block numbers in hex; swaps of every third are negative in the first
    leg; every seventh event has an unknown topic and every eleventh an unregistered pool.
    """
    e = tables.read(spark, sf_dir, "events")
    key, zero = F.col("event_id"), F.lit(decoding.ZERO_WORD)
    kind = dims.lookup(kinds, F.col("event_type"))
    units = F.round(F.col("value") * 1_000_000).cast("bigint")
    signed = F.when((key % 3 == 0) & kind.isin("agni_swap", "v3_swap"), -units).otherwise(units)
    a, b = hex_word(signed), hex_word(F.floor(units / 10).cast("bigint"))
    wallet = F.lpad(F.col("user_id").cast("string"), 64, "0")
    packed = lambda low, high: F.concat(F.right(high, F.lit(32)), F.right(low, F.lit(32)))
    # sizes of positions are dollars times 10^30: only a multiple of a power of two fits a test word
    layouts = {
        "agni_swap": [a, b, *[zero] * 5],
        "v3_swap": [a, b, *[zero] * 3],
        "mint": [zero, zero, a, b],
        "burn": [zero, a, b],
        "transfer": [a],
        "lb_swap": [zero, packed(a, zero), packed(zero, b), *[zero] * 3],
        "gmx_swap": [wallet, padded_word(USDC), padded_word(WETH), a, zero, b, zero],
        "gmx_increase": [zero, wallet, padded_word(USDC), padded_word(WETH), zero, a, *[zero] * 3],
        "gmx_decrease": [zero, wallet, padded_word(USDC), padded_word(WETH), zero, a, *[zero] * 3],
    }
    data = F.coalesce(*[F.when(kind == k, F.concat(F.lit("0x"), *parts)) for k, parts in layouts.items()])
    topic0 = F.when(key % 7 == 0, F.lit("0x" + "0" * 64)).otherwise(dims.lookup(dims.KIND_TOPIC, kind))
    user = padded_topic(F.concat(F.lit("0x"), F.lpad(F.col("user_id").cast("string"), 40, "0")))
    block = F.floor(key / 10).cast("bigint")
    chain = F.element_at(F.array(*map(F.lit, dims.CHAINS)), (F.col("user_id") % 4 + 1).cast("int"))
    return e.select(
        chain.alias("chain"),
        F.when(key % 11 == 0, F.lit("0xelsewhere")).otherwise(F.concat(F.lit("0xPOOL_"), "event_type")).alias("address"),
        F.array(topic0, user, user).alias("topics"),
        data.alias("data"),
        F.when(key % 2 == 1, F.concat(F.lit("0x"), F.hex(block))).otherwise(block.cast("string")).alias("block_number"),
        F.concat(F.lit("0xtx"), key.cast("string")).alias("tx_hash"),
        (key % 10).cast("string").alias("log_index"),
    )


def padded_word(address: str) -> Column:
    return F.lit(address.removeprefix("0x").rjust(64, "0"))


def decoded(spark: SparkSession, sf_dir: str, kinds: dict[str, str] = KINDS, gmx_precision: float = 1e6) -> DataFrame:
    routed = decoding.route(raw_logs(spark, sf_dir, kinds), pools(spark))
    return decoding.decode(routed, tokens(spark), price_table(spark), gmx_precision)


LOGS = """logs AS (SELECT event_id, event_type, user_id, value, CAST(round(value * 1000000) AS BIGINT) AS units, chain, event_id // 10 AS block FROM ev_raw WHERE event_id % 7 <> 0 AND event_id % 11 <> 0)"""
RAW = "ev_raw AS (SELECT *, list_element(['mantle', 'arbitrum', 'hashkey', 'ethereum'], CAST(user_id % 4 AS BIGINT) + 1) AS chain FROM events)"


def _usd(kinds: dict[str, str]) -> str:
    # the second leg is a tenth of the first at twice the price: the first is always larger
    legs = {"transfer": "CASE WHEN chain = 'ethereum' THEN 0 ELSE units / 1e6 END"}
    if kinds is MORE_KINDS:
        legs = {"v3_swap": "CASE WHEN chain = 'ethereum' THEN units / 1e18 * 0.5 ELSE units / 1e6 END"}
    return "round(CASE event_type " + " ".join(f"WHEN '{e}' THEN {legs.get(k, 'units / 1e6')}" for e, k in kinds.items()) + " END, 4)"


def _decoded_sql(kinds: dict[str, str]) -> str:
    types = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{dims.KIND_TYPE[k]}'" for e, k in kinds.items()) + " END"
    return f"WITH {RAW}, {LOGS} SELECT '0xtx' || CAST(event_id AS VARCHAR) AS tx_hash, chain, '0xpool_' || event_type AS pool, {types} AS type, '0x' || lpad(CAST(user_id AS VARCHAR), 40, '0') AS wallet, {_usd(kinds)} AS usd, block, CAST(event_id % 10 AS INTEGER) AS log_index FROM logs"


@query(_decoded_sql(KINDS))
def dec1_dec4_dec8_flt1_decoded_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pool swaps, liquidity and transfers; unknown pools and topics drop out."""
    return decoded(spark, sf_dir).select("tx_hash", "chain", "pool", "type", "wallet", "usd", "block", "log_index")


@query(_decoded_sql(MORE_KINDS))
def dec5_dec7_dec11_decoded_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pair swaps, vault swaps and positions, and a pool without tokens."""
    return decoded(spark, sf_dir, MORE_KINDS).select("tx_hash", "chain", "pool", "type", "wallet", "usd", "block", "log_index")


@query(f"WITH {RAW}, {LOGS} SELECT '0xtx' || CAST(event_id AS VARCHAR) AS tx_hash, CAST(CASE WHEN event_id % 3 = 0 AND event_type IN ('click', 'view') THEN -units ELSE units END AS VARCHAR) AS exact FROM logs WHERE event_type <> 'purchase' AND event_type <> 'signup'")
def dec_exact_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words as exact decimal text."""
    routed = decoding.route(raw_logs(spark, sf_dir), pools(spark)).where("kind not in ('mint', 'burn')")
    return routed.select("tx_hash", words.to_decimal_text(words.word(F.col("digits"), 0), signed=True).alias("exact"))


@query(f"WITH {RAW} SELECT '0xtx' || CAST(event_id AS VARCHAR) AS tx_hash FROM ev_raw WHERE event_id % 11 <> 0 AND event_id // 10 BETWEEN 20 AND 70 AND chain IN ('mantle', 'ethereum')")
def src1_flt4_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of blocks of two chains, read from the log store; only their folders and row groups are read."""
    path = io.scratch_path(spark, "logs")
    logs = raw_logs(spark, sf_dir)
    span = log_store.span_for(logs, 25)
    log_store.append_logs(logs, path, span=span)
    chains = decoding.enabled_chains(["mantle", "nowhere", "ethereum"])
    return log_store.scan_range(spark, path, pools(spark), 20, 70, chains, span=span).select("tx_hash")


@query(f"WITH {RAW}, {LOGS} SELECT chain, count(*) AS n, round(sum(round(units / 1e6, 4)), 4) AS usd FROM logs WHERE block BETWEEN 10 AND 80 AND event_type <> 'error' AND round(units / 1e6, 4) >= 50 GROUP BY chain")
def src2_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replayed range: decoded events worth 50 dollars or more, by chain."""
    logs = decoding.scan_logs(raw_logs(spark, sf_dir), pools(spark), 10, 80)
    rows = decoding.decode(decoding.route(logs, pools(spark)), tokens(spark), price_table(spark))
    return decoding.replay(rows.where("type <> 'transfer'"), 50.0).groupBy("chain").agg(F.count("*").alias("n"), F.round(F.sum("usd"), 4).alias("usd"))


@query(tables.with_ctes("ev", "SELECT e.event_id, coalesce(b.us, 1706659200000000) AS us FROM ev e LEFT JOIN (SELECT chain, block, min(us) AS us FROM ev WHERE block % 4 <> 0 GROUP BY ALL) b USING (chain, block)"))
def jn1_block_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block time by (chain, block), else the time of processing; every fourth block is unknown."""
    ev = tables.events(spark, sf_dir)
    blocks = ev.where("block % 4 <> 0").groupBy("chain", "block").agg(F.min("us").alias("us"))
    return decoding.with_block_times(ev.select("event_id", "chain", "block"), blocks, 1_706_659_200_000_000).select("event_id", "us")


@query(tables.with_ctes("ev", "SELECT event_id, CASE WHEN user_id % 10 = 0 AND event_id % 3 <> 0 THEN '0xorigin' || CAST(user_id AS VARCHAR) ELSE wallet END AS wallet FROM ev"))
def jn2_wallet_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sender in place of a proxy, which every tenth user is; transactions of every third event are unknown."""
    ev = tables.events(spark, sf_dir).withColumn("tx_hash", F.col("tx"))
    proxies = ev.where("user_id % 10 = 0").select("wallet")
    transactions = ev.where("event_id % 3 <> 0").select("chain", "tx_hash", F.concat(F.lit("0xORIGIN"), F.col("user_id").cast("string")).alias("from_address"))
    return decoding.resolve_wallets(ev, transactions, proxies).select("event_id", "wallet")


@query(tables.with_ctes("ev", "SELECT chain, tx, log_index, count(*) AS n FROM ev GROUP BY ALL"))
def set2_set3_merged_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged log of the chains, polled twice, and deduplicated."""
    ev = tables.events(spark, sf_dir).select("chain", "tx", "log_index")
    once = decoding.deduplicate(ev.unionByName(ev), ("chain", "tx", "log_index"))
    return once.groupBy("chain", "tx", "log_index").agg(F.count("*").alias("n"))


@query(
    f"""WITH {RAW} SELECT c.chain, '0xpool_' || t.event_type AS pool, count(e.event_id) AS swaps, count(e.event_id) > 0 AS active
FROM (SELECT unnest(['mantle', 'arbitrum', 'hashkey', 'ethereum']) AS chain) c CROSS JOIN (SELECT unnest(['click', 'view', 'purchase', 'signup', 'error']) AS event_type) t
LEFT JOIN ev_raw e ON e.chain = c.chain AND e.event_type = t.event_type AND t.event_type = 'view' AND e.event_id % 7 <> 0 AND e.event_id % 11 <> 0 GROUP BY ALL"""
)
def flt18_pool_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swaps of each registered pool by its protocol's topic; only view pools emit theirs."""
    found = decoding.pool_activity(pools(spark), raw_logs(spark, sf_dir), {"gmx": "v3_swap", "uniswap_v3": "lb_swap"})
    return found.select("chain", "pool", "swaps", "active")


@query(tables.with_ctes("ev", "SELECT event_id, chain, block, tx, protocol, pool, wallet, type, round(usd, 2) AS usd, us FROM ev"))
def src3_src4_payload_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as queue payloads and back."""
    ev = tables.events(spark, sf_dir)
    read = payloads.read_events(ev.select(payloads.event_payload().alias("value")))
    return read.select(F.substring("tx", 5, 20).cast("bigint").alias("event_id"), "chain", "block", "tx", "protocol", "pool", "wallet", "type", "usd", "us")
