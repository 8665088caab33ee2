"""Small fixed dimensions: topics, chains, assets, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Event topic to kind (fixed values: keccak hashes of the event signatures).
TOPICS = {
    "0x19b47279256b2a23a1665c810c8d55a1758940ee09377d4f8d26497a3577dc83": "agni_swap",
    "0xc42079f94a6350d7e6235f29174924f928cc2ac818eb64fed8004e115fbcca67": "v3_swap",
    "0x7a53080ba414158be7ec69b987b5fb7d07dee101fe85488f0853ae16239d0bde": "mint",
    "0x0c396cd989a39f4459b5fa1aed6a9a8dcdbc45908acfd67e028cd568da98982c": "burn",
    "0xad7d6f97abf51ce18e17a38f4d70e975be9c0708474987bb3e26ad21bd93ca70": "lb_swap",
    "0x0874b2d545cb271cdbda4e093020c452328b24af12382ed62c4d00f5c26709db": "gmx_swap",
    "0x2fe68525253654c21998f35787a8d0f361905ef647c854092430ab65f2f15022": "gmx_increase",
    "0x93d75d64d1f84fc6f430a64fc578bdd4c1e090e90ea2d51773e626d19de56d30": "gmx_decrease",
    "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef": "transfer",
}
KIND_TOPIC = {kind: topic for topic, kind in TOPICS.items()}
KIND_TYPE = {"agni_swap": "swap", "v3_swap": "swap", "lb_swap": "swap", "gmx_swap": "swap", "mint": "mint", "burn": "burn", "gmx_increase": "open_position", "gmx_decrease": "close_position", "transfer": "transfer"}
#: Words of 32 bytes that a log of a kind must have (fixed values).
KIND_WORDS = {"agni_swap": 7, "v3_swap": 5, "mint": 4, "burn": 3, "lb_swap": 6, "gmx_swap": 7, "gmx_increase": 9, "gmx_decrease": 9, "transfer": 1}
#: Contracts that trade for others (fixed values, lower case).
PROXIES = (
    "0xc36442b4a4522e871399cd717abdd847ab11fe88",
    "0xe592427a0aece92de3edee1f18e0157c05861564",
    "0x68b3465833fb72a70ecdf485e0e4c7bd8665fc45",
    "0x3fc91a3afd70395cd496c647d5a6cc9d4b2b7fad",
    "0x66a9893cc07d91d95644aedd05d03f95e1dba8af",
    "0x5e325eda8064b456f4781070c0738d849c824258",
    "0xa51afafe0263b40edaef0df8781ea9aa03e381a3",
)
#: Chains, their price keys, explorers and proper names, and those of protocols (fixed values).
CHAINS = ("mantle", "arbitrum", "hashkey", "ethereum")
CHAIN_ASSET = {"mantle": "mnt", "arbitrum": "eth"}
EXPLORERS = {"mantle": "https://explorer.mantle.xyz", "arbitrum": "https://arbiscan.io", "hashkey": "https://hsk.blockscout.com", "ethereum": "https://etherscan.io"}
CHAIN_NAMES = {"mantle": "Mantle", "arbitrum": "Arbitrum", "hashkey": "HashKey Chain", "ethereum": "Ethereum"}
PROTOCOL_NAMES = {"agni_finance": "Agni Finance", "merchant_moe": "Merchant Moe", "fluxion": "Fluxion", "uniswap_v3": "Uniswap V3", "trader_joe": "Trader Joe", "gmx": "GMX"}
#: Kinds of signal (fixed values).
SIGNAL_TYPES = ("accumulation", "distribution", "whale_entry", "whale_exit", "unusual_volume", "liquidity_added", "liquidity_removed")
SIGNAL_LABELS = {kind: kind.replace("_", " ").title() for kind in SIGNAL_TYPES}
SIGNAL_EMOJIS = dict(zip(SIGNAL_TYPES, "🧺📤🐳🏃📊➕➖", strict=True))
OTHER_EMOJI = "❔"
UP_TYPES, DOWN_TYPES = ("accumulation", "whale_entry"), ("distribution", "whale_exit")
#: Horizons of an outcome, in hours (fixed values).
HORIZONS = {"1h": 1, "4h": 4, "24h": 24, "7d": 168}


def lookup(mapping: dict, key: Column, default: Column | None = None) -> Column:
    """A map literal read with a default."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), key)
    return found if default is None else F.coalesce(found, default)


def topics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, k, KIND_TYPE[k], KIND_WORDS[k]) for t, k in TOPICS.items()], "topic0 string, kind string, type string, words int")
