"""Fixed schemas of every table, as DDL text; nothing is inferred."""

from __future__ import annotations

RAW_LOGS = "chain string, address string, topics array<string>, data string, block_number string, tx_hash string, log_index string"
#: As ``log_store`` lays raw logs out: numbers are numbers, and a span of blocks is a folder.
LOG_STORE = "chain string, span bigint, block bigint, address string, topics array<string>, data string, tx_hash string, log_index int"
EVENTS = "chain string, block bigint, tx string, log_index int, protocol string, pool string, wallet string, type string, usd double, ts timestamp"
#: Queue payload of an event; short fields stand in for missing full ones.
EVENT_PAYLOAD = "chain string, block bigint, tx string, tx_full string, protocol string, pool string, pool_full string, wallet string, wallet_full string, type string, usd double, ts string"
POOLS = "chain string, pool string, protocol string, token0 string, token1 string"
TOKENS = "address string, price_key string, decimals int"
STATIC_PRICES = "chain string, price_key string, price double"
PRICE_TICKS = "chain string, price_key string, ts timestamp, price double"
SIGNALS = (
    "id bigint, chain string, protocol string, pool string, wallets array<string>, signal_type string, confidence int, summary string, "
    "key_factors array<string>, detected_at timestamp, deliver_at timestamp, z_score double, total_volume_usd double, event_type string, audit_tx_hash string"
)
SIGNAL_OUTCOMES = "signal_id bigint, horizon string, due_at timestamp, price_key string, entry_price double, status string, price double, pct_change double"
SUBSCRIPTIONS = "id bigint, channel string, min_confidence int, signal_types array<string>, protocols array<string>, chains array<string>, is_pro boolean, pro_expires_at timestamp, registered_wallet string"
AGENT_RULES = "min_confidence int, signal_types array<string>, protocols array<string>, min_z_score double, action string, amount_usd double, max_slippage double, max_position_pct double"
EXECUTIONS = "agent_id bigint, signal_id bigint, action_type string, status string, amount_usd double, abort_reason string, guard_failed string, executed_at timestamp"
PAYMENTS = "chain string, tx_hash string, log_index int, from_address string, amount double, block_number bigint, ts timestamp"
WEBHOOKS = "id bigint, active boolean, event_filters struct<chain:string, signal_type:string, min_confidence:int>"
ATTEMPTS = "webhook_id bigint, signal_id bigint, attempt_no int, ts timestamp, ok boolean"
AUDIT_LOG = "signal_id bigint, signal_hash string, protocol string, signal_type string, confidence int, ts timestamp"
DECISIONS = "agent_id bigint, signal_id bigint, action_type string, success boolean, ts timestamp"
