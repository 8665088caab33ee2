"""Domain tables derived from the star-schema and event tables on disk.

``SQL`` holds the same derivations for DuckDB, so both sides see the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dims

NOW = "2024-01-31 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


PROTOCOLS = ("agni_finance", "merchant_moe", "fluxion", "uniswap_v3", "trader_joe", "gmx")
CHANNELS = ("telegram", "discord", "line")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priced on-chain events: chain, block, tx, log_index, protocol, pool, wallet, type, usd, ts, us."""
    e = read(spark, sf_dir, "events")
    kind = dims.lookup({"click": "swap", "view": "swap", "purchase": "mint", "signup": "burn", "error": "transfer"}, F.col("event_type"))
    ts = F.col("ts").cast("timestamp")
    return e.select(
        _pick(F.col("user_id") % 4, dims.CHAINS).alias("chain"),
        F.floor(F.col("event_id") / 10).cast("bigint").alias("block"),
        F.concat(F.lit("0xtx"), F.col("event_id").cast("string")).alias("tx"),
        (F.col("event_id") % 10).cast("int").alias("log_index"),
        _pick(F.col("event_id") % 6, PROTOCOLS).alias("protocol"),
        F.concat(F.lit("0xpool_"), "event_type").alias("pool"),
        F.concat(F.lit("0x"), F.lpad(F.col("user_id").cast("string"), 40, "0")).alias("wallet"),
        kind.alias("type"),
        F.col("value").alias("usd"),
        ts.alias("ts"),
        F.unix_micros(ts).alias("us"),
        "event_id",
        "user_id",
    )


def price_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chain, us, price: a tick for each view event."""
    return events(spark, sf_dir).where("pool = '0xpool_view'").select("chain", "us", (F.lit(100) + F.col("usd")).alias("price"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal for each purchase event."""
    e = events(spark, sf_dir).where("pool = '0xpool_purchase'")
    wallet = lambda d: F.concat(F.lit("0x"), F.lpad((F.col("user_id") + d).cast("string"), 40, "0"))
    return e.select(
        F.col("event_id").alias("id"),
        "chain",
        "protocol",
        "pool",
        F.array(wallet(0), wallet(1), wallet(2)).alias("wallets"),
        _pick(F.col("event_id") % 7, dims.SIGNAL_TYPES).alias("signal_type"),
        (F.col("event_id") % 101).cast("int").alias("confidence"),
        F.concat(F.lit("Signal "), F.col("event_id").cast("string")).alias("summary"),
        (F.col("usd") / 50).alias("z_score"),
        (F.col("usd") * 1000).alias("total_volume_usd"),
        F.col("type").alias("event_type"),
        F.col("ts").alias("detected_at"),
        (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("deliver_at"),
        F.col("us").alias("detected_us"),
    )


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias("sub_id"),
        _pick(key % 3, CHANNELS).alias("channel"),
        (F.lit(40) + key % 60).cast("int").alias("min_confidence"),
        F.when(key % 5 != 0, F.array(_pick(F.col("c_nationkey") % 4, dims.CHAINS))).alias("chains"),
        F.when(key % 3 == 0, F.array(_pick(key % 7, dims.SIGNAL_TYPES), _pick((key + 1) % 7, dims.SIGNAL_TYPES))).alias("signal_types"),
        F.when(key % 2 == 0, F.array(*[_pick((key + d) % 6, PROTOCOLS) for d in range(3)])).alias("protocols"),
        (F.col("c_mktsegment") == "BUILDING").alias("is_pro"),
        F.when(key % 4 != 0, F.timestamp_seconds(F.lit(1704067200) + (key % 60) * 86400)).alias("pro_expires_at"),
        F.concat(F.lit("0x"), F.lpad((key - key % 2).cast("string"), 40, "0")).alias("registered_wallet"),
    )


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    rules = F.struct(
        F.when(key % 3 != 0, (F.lit(50) + key % 50).cast("int")).alias("min_confidence"),
        F.when(key % 4 == 0, F.array(*[_pick((key + d) % 7, dims.SIGNAL_TYPES) for d in range(3)])).alias("signal_types"),
        F.when(key % 5 == 0, F.array(*[_pick((key + d) % 6, PROTOCOLS) for d in range(2)])).alias("protocols"),
        F.when(key % 2 == 0, (key % 40) / 10).alias("min_z_score"),
        F.when(key % 6 == 0, F.lit("bad_action")).when(key % 6 == 1, F.lit("remove_liquidity")).alias("action"),
        F.when(key % 3 == 1, (F.lit(10) + key % 50).cast("double")).alias("amount_usd"),
        F.when(key % 7 == 0, F.lit(0.05)).alias("max_slippage"),
        F.when(key % 8 == 0, F.lit(0.0)).when(key % 8 == 1, F.lit(1.0)).alias("max_position_pct"),
    )
    return s.select(key.alias("agent_id"), (key % 10 != 9).alias("active"), F.col("s_acctbal").alias("balance_usd"), rules.alias("rules"))


def webhooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    filters = F.struct(
        F.when(F.col("n_regionkey") < 4, _pick(F.col("n_regionkey") % 4, dims.CHAINS)).alias("chain"),
        F.when(key % 2 == 0, _pick(key % 7, dims.SIGNAL_TYPES)).alias("signal_type"),
        F.when(key % 3 == 0, (key * 3).cast("int")).alias("min_confidence"),
    )
    return n.select(key.cast("bigint").alias("webhook_id"), (key % 5 != 4).alias("active"), filters.alias("filters"))


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    ts = F.col("o_orderdate").cast("timestamp")
    return o.select(
        F.col("o_orderkey").alias("payment_id"),
        _pick(F.col("o_orderkey") % 4, dims.CHAINS).alias("chain"),
        F.concat(F.lit("0x"), F.lpad(F.col("o_custkey").cast("string"), 40, "0")).alias("from_address"),
        (F.col("o_totalprice") / 1500).alias("amount"),
        F.floor(F.unix_micros(ts) / F.lit(12_000_000)).cast("bigint").alias("block_number"),
        F.unix_micros(ts).alias("us"),
        F.col("o_custkey").alias("account"),
    )


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("execution_id"),
        (F.col("o_custkey") % 100).alias("agent_id"),
        dims.lookup({"F": "success", "O": "aborted"}, F.col("o_orderstatus"), F.lit("failed")).alias("status"),
        F.col("o_orderpriority").alias("action_type"),
        (F.col("o_totalprice") / 1000).alias("amount_usd"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery attempts: the events of a user, those of type error failed."""
    e = events(spark, sf_dir)
    return e.select(F.col("user_id").alias("webhook_id"), F.floor(F.col("event_id") / 40).cast("bigint").alias("signal_id"), "event_id", "us", (F.col("pool") != "0xpool_error").alias("ok"))


def _case(index: str, values: tuple[str, ...]) -> str:
    return f"list_element([{', '.join(repr(v) for v in values)}], CAST({index} AS BIGINT) + 1)"


_W = "('0x' || lpad(CAST({} AS VARCHAR), 40, '0'))"
#: Common table expressions for DuckDB.
SQL = {
    "ev": f"""ev AS (SELECT {_case("user_id % 4", dims.CHAINS)} AS chain, event_id // 10 AS block, '0xtx' || CAST(event_id AS VARCHAR) AS tx,
        CAST(event_id % 10 AS INTEGER) AS log_index, {_case("event_id % 6", PROTOCOLS)} AS protocol, '0xpool_' || event_type AS pool, {_W.format("user_id")} AS wallet,
        CASE event_type WHEN 'purchase' THEN 'mint' WHEN 'signup' THEN 'burn' WHEN 'error' THEN 'transfer' ELSE 'swap' END AS type,
        value AS usd, ts, epoch_us(ts) AS us, event_id, user_id FROM events)""",
    "ticks": "ticks AS (SELECT chain, us, 100 + usd AS price FROM ev WHERE pool = '0xpool_view')",
    "sig": f"""sig AS (SELECT event_id AS id, chain, protocol, pool, [{", ".join(_W.format(f"(user_id + {d})") for d in range(3))}] AS wallets,
        {_case("event_id % 7", dims.SIGNAL_TYPES)} AS signal_type, CAST(event_id % 101 AS INTEGER) AS confidence, 'Signal ' || CAST(event_id AS VARCHAR) AS summary,
        usd / 50 AS z_score, usd * 1000 AS total_volume_usd, type AS event_type, ts AS detected_at, us AS detected_us FROM ev WHERE pool = '0xpool_purchase')""",
    "subs": f"""subs AS (SELECT c_custkey AS sub_id, {_case("c_custkey % 3", CHANNELS)} AS channel, CAST(40 + c_custkey % 60 AS INTEGER) AS min_confidence,
        CASE WHEN c_custkey % 5 <> 0 THEN [{_case("c_nationkey % 4", dims.CHAINS)}] END AS chains,
        CASE WHEN c_custkey % 3 = 0 THEN [{_case("c_custkey % 7", dims.SIGNAL_TYPES)}, {_case("(c_custkey + 1) % 7", dims.SIGNAL_TYPES)}] END AS signal_types,
        CASE WHEN c_custkey % 2 = 0 THEN [{", ".join(_case(f"(c_custkey + {d}) % 6", PROTOCOLS) for d in range(3))}] END AS protocols,
        c_mktsegment = 'BUILDING' AS is_pro, CASE WHEN c_custkey % 4 <> 0 THEN (1704067200 + (c_custkey % 60) * 86400) * 1000000 END AS expires_us,
        {_W.format("(c_custkey - c_custkey % 2)")} AS registered_wallet FROM customer)""",
    "agents": f"""agents AS (SELECT s_suppkey AS agent_id, s_suppkey % 10 <> 9 AS active, s_acctbal AS balance_usd,
        CASE WHEN s_suppkey % 3 <> 0 THEN 50 + s_suppkey % 50 END AS min_confidence,
        CASE WHEN s_suppkey % 4 = 0 THEN [{", ".join(_case(f"(s_suppkey + {d}) % 7", dims.SIGNAL_TYPES) for d in range(3))}] END AS signal_types,
        CASE WHEN s_suppkey % 5 = 0 THEN [{", ".join(_case(f"(s_suppkey + {d}) % 6", PROTOCOLS) for d in range(2))}] END AS protocols,
        CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey % 40) / 10.0 END AS min_z_score,
        CASE s_suppkey % 6 WHEN 0 THEN 'bad_action' WHEN 1 THEN 'remove_liquidity' END AS action,
        CASE WHEN s_suppkey % 3 = 1 THEN CAST(10 + s_suppkey % 50 AS DOUBLE) END AS amount_usd,
        CASE WHEN s_suppkey % 7 = 0 THEN CAST(0.05 AS DOUBLE) END AS max_slippage,
        CASE s_suppkey % 8 WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN CAST(1 AS DOUBLE) END AS max_position_pct FROM supplier)""",
    "hooks": f"""hooks AS (SELECT CAST(n_nationkey AS BIGINT) AS webhook_id, n_nationkey % 5 <> 4 AS active, CASE WHEN n_regionkey < 4 THEN {_case("n_regionkey % 4", dims.CHAINS)} END AS f_chain,
        CASE WHEN n_nationkey % 2 = 0 THEN {_case("n_nationkey % 7", dims.SIGNAL_TYPES)} END AS f_type, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey * 3 END AS f_conf FROM nation)""",
    "pay": f"""pay AS (SELECT o_orderkey AS payment_id, {_case("o_orderkey % 4", dims.CHAINS)} AS chain, {_W.format("o_custkey")} AS from_address, o_totalprice / 1500 AS amount,
        epoch_us(o_orderdate) // 12000000 AS block_number, epoch_us(o_orderdate) AS us, o_custkey AS account FROM orders)""",
    "exe": """exe AS (SELECT o_orderkey AS execution_id, o_custkey % 100 AS agent_id, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'aborted' ELSE 'failed' END AS status,
        o_orderpriority AS action_type, o_totalprice / 1000 AS amount_usd, epoch_us(o_orderdate) AS us FROM orders)""",
    "att": "att AS (SELECT user_id AS webhook_id, event_id // 40 AS signal_id, event_id, us, pool <> '0xpool_error' AS ok FROM ev)",
}
NEEDS = {"ticks": ["ev"], "sig": ["ev"], "att": ["ev"]}


def with_ctes(names: str, body: str, more: str = "", recursive: bool = False) -> str:
    """SQL text with the named derivations, and those that they need, before ``body``."""
    order: list[str] = []
    for n in names.split():
        order += [x for x in [*NEEDS.get(n, []), n] if x not in order]
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join([SQL[n] for n in order] + ([more] if more else [])) + "\n" + body
