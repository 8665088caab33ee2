"""Raw logs to priced events: routing, decoding, attribution, dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import last_address
from ..functions.words import flexible_int, halves, hex_data, to_double, word, word_address
from ..sources import dims
from .prices import estimate_usd, legacy_usd

ZERO_WORD = "0" * 64


def enabled_chains(names: list[str] | None) -> list[str]:
    """Known names; none means the first chain."""
    known = [n for n in names or [] if n in dims.CHAINS]
    return known or [dims.CHAINS[0]]


def scan_logs(logs: DataFrame, pools: DataFrame, from_block: int, to_block: int, chains: list[str] | None = None) -> DataFrame:
    """Logs of registered pools in a range of blocks (inclusive), with topics."""
    block = flexible_int(F.col("block_number"))
    rows = logs.where(F.col("chain").isin(*(chains or dims.CHAINS)) & block.between(from_block, to_block) & (F.size("topics") > 0))
    registered = pools.select("chain", F.lower("pool").alias("pool"))
    return rows.withColumn("pool", F.lower("address")).join(registered, ["chain", "pool"], "left_semi").drop("pool")


def route(logs: DataFrame, pools: DataFrame) -> DataFrame:
    """Attach pool data and the kind of event; logs of other pools, topics or lengths drop out."""
    registry = pools.select(F.col("chain"), F.lower("pool").alias("pool"), "protocol", "token0", "token1")
    topics = F.broadcast(dims.topics(logs.sparkSession))
    rows = logs.where(F.size("topics") > 0).withColumn("pool", F.lower("address")).withColumn("topic0", F.lower(F.col("topics")[0]))
    # data is looked at only where the topic and the pool are known
    found = rows.join(topics, "topic0").join(registry, ["chain", "pool"]).withColumn("digits", hex_data(F.col("data")))
    enough_topics = F.size("topics") >= F.when(F.col("kind") == "transfer", 3).when(F.col("kind").startswith("gmx"), 1).otherwise(2)
    return found.where((F.length("digits") >= 64 * F.col("words")) & enough_topics & F.col("digits").rlike("^[0-9a-f]*$"))


def _legs() -> tuple[Column, Column, Column, Column]:
    """The words that make up the amounts of either token, one or two each."""
    w = [word(F.col("digits"), i) for i in range(9)]
    zero = F.lit(ZERO_WORD)
    (x_in, y_in), (x_out, y_out) = halves(w[1]), halves(w[2])
    k = F.col("kind")
    swap = k.isin("agni_swap", "v3_swap")
    a0 = F.when(swap, w[0]).when(k == "mint", w[2]).when(k == "burn", w[1]).when(k == "lb_swap", x_in).when(k == "gmx_swap", w[3]).when(k.startswith("gmx_"), w[5]).otherwise(w[0])
    a1 = F.when(swap, w[1]).when(k == "mint", w[3]).when(k == "burn", w[2]).when(k == "lb_swap", y_in).when(k == "gmx_swap", w[5]).otherwise(zero)
    b0 = F.when(k == "lb_swap", x_out).otherwise(zero)
    b1 = F.when(k == "lb_swap", y_out).otherwise(zero)
    return a0, a1, b0, b1


def decode(routed: DataFrame, tokens: DataFrame, prices: DataFrame, gmx_precision: float = 1e30) -> DataFrame:
    """Events of routed logs: wallet, type, usd, amount0, amount1 and their identity.

    ``tokens`` has address, price_key and decimals; ``prices`` chain, price_key and price.
    A token without a price counts as 0; pools without tokens use the native coin.
    """
    a0, a1, b0, b1 = _legs()
    signed = F.col("kind").isin("agni_swap", "v3_swap")
    digits = F.col("digits")
    gmx = F.col("kind").startswith("gmx_")
    wallet = F.when(F.col("kind") == "gmx_swap", word_address(digits, 0)).when(gmx, word_address(digits, 1)).otherwise(last_address(F.col("topics")[1]))
    # the token that prices the first leg: of the pool, or the one that a spot swap names
    first_token = F.when(F.col("kind") == "gmx_swap", word_address(digits, 1)).otherwise(F.lower("token0"))
    rows = routed.select(
        "chain", "protocol", "pool", "kind", "type", "tx_hash", "token0", "token1",
        flexible_int(F.col("block_number")).alias("block"), flexible_int(F.col("log_index")).cast("int").alias("log_index"),
        F.lower(wallet).alias("wallet"), first_token.alias("priced0"), F.lower("token1").alias("priced1"),
        (to_double(a0, signed) + to_double(b0, F.lit(False))).alias("amount0"), (to_double(a1, signed) + to_double(b1, F.lit(False))).alias("amount1"),
    )
    priced = tokens.select(F.lower("address").alias("address"), "price_key", "decimals").join(prices.select(F.col("chain"), "price_key", "price"), "price_key")
    side = lambda i: priced.select("chain", F.col("address").alias(f"priced{i}"), F.col("price").alias(f"price{i}"), F.col("decimals").alias(f"decimals{i}"))
    native = prices.where("price_key = 'mnt'").select("chain", F.col("price").alias("native"))
    joined = rows.join(side(0), ["chain", "priced0"], "left").join(side(1), ["chain", "priced1"], "left").join(native, "chain", "left")
    zero = F.lit(0.0)
    amount0, amount1 = F.col("amount0"), F.col("amount1")
    d = lambda i: F.coalesce(f"decimals{i}", F.lit(18))
    one_leg = F.round(F.abs(amount0) / F.pow(F.lit(10.0), d(0)) * F.coalesce("price0", zero), 4)
    pair = estimate_usd(amount0, amount1, F.col("price0"), F.col("price1"), d(0), d(1))
    no_tokens = F.col("token0").isNull() | F.col("token1").isNull()
    usd = (
        F.when(F.col("kind").isin("gmx_increase", "gmx_decrease"), F.round(amount0 / gmx_precision, 4))
        .when(F.col("kind") == "gmx_swap", one_leg)
        .when(F.col("kind") == "transfer", F.when(F.col("token0").isNull(), zero).otherwise(one_leg))
        .when(no_tokens, legacy_usd(amount0, amount1, F.col("native")))
        .otherwise(pair)
    )
    return joined.withColumn("usd", usd).where("wallet is not null and amount0 is not null").select("chain", "protocol", "pool", "kind", "type", "wallet", "usd", "amount0", "amount1", "block", "tx_hash", "log_index")


def with_block_times(events: DataFrame, blocks: DataFrame, processing_us: int) -> DataFrame:
    """Time of the event's block, else the time of processing."""
    times = blocks.select("chain", "block", F.col("us").alias("_us"))
    return events.join(times, ["chain", "block"], "left").withColumn("us", F.coalesce("_us", F.lit(processing_us))).drop("_us")


def resolve_wallets(events: DataFrame, transactions: DataFrame, proxies: tuple[str, ...] | DataFrame = dims.PROXIES) -> DataFrame:
    """The sender of the transaction in place of a proxy; unknown transactions keep the proxy.

    ``proxies`` are listed, or the column wallet of a table of any size.  Only proxied rows
    take part in the join with the transactions.
    """
    columns = events.columns
    if isinstance(proxies, DataFrame):
        events = events.join(proxies.select(F.col("wallet").alias("_proxy")).distinct(), F.col("wallet") == F.col("_proxy"), "left")
        proxied = F.col("_proxy").isNotNull()
    else:
        proxied = F.coalesce(F.col("wallet").isin(*proxies), F.lit(False))
    plain = events.where(~proxied).select(*columns)
    origin = transactions.select("chain", "tx_hash", F.lower("from_address").alias("_from"))
    swapped = events.where(proxied).join(origin, ["chain", "tx_hash"], "left").withColumn("wallet", F.coalesce("_from", "wallet")).select(*columns)
    return plain.unionByName(swapped)


def deduplicate(events: DataFrame, key: tuple[str, ...] = ("chain", "tx_hash", "log_index")) -> DataFrame:
    return events.dropDuplicates(list(key))


def pool_activity(pools: DataFrame, logs: DataFrame, swap_kinds: dict[str, str]) -> DataFrame:
    """Whether each registered pool emits its protocol's swap topic."""
    wanted = pools.select("chain", F.lower("pool").alias("pool"), "protocol").withColumn("topic", dims.lookup({p: dims.KIND_TOPIC[k] for p, k in swap_kinds.items()}, F.col("protocol")))
    seen = logs.select("chain", F.lower("address").alias("pool"), F.lower(F.col("topics")[0]).alias("topic0")).groupBy("chain", "pool", "topic0").agg(F.count("*").alias("n"))
    found = wanted.join(seen, ["chain", "pool"], "left").groupBy("chain", "pool", "protocol").agg(F.sum(F.when(F.col("topic0") == F.col("topic"), F.col("n")).otherwise(0)).alias("swaps"))
    return found.withColumn("active", F.col("swaps") > 0)


def replay(events: DataFrame, min_usd: float) -> DataFrame:
    """Decoded events of a replayed range that are worth at least ``min_usd``."""
    return events.where(F.col("usd") >= min_usd)
