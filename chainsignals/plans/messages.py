"""Texts, replies, canonical JSON and hashes of signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keccak, payloads, texts
from ..operators import classify
from ..sources import dims, tables
from .registry import query


#: Numbers that are not half-way between two roundings, which Java and C settle differently.
ODD = "odd AS (SELECT * REPLACE (total_volume_usd * 37.7 + 0.3 AS total_volume_usd, z_score * 1.0037 + 0.00013 AS z_score) FROM sig)"


def odd_numbers(signals: DataFrame) -> DataFrame:
    return signals.withColumns({"total_volume_usd": F.col("total_volume_usd") * 37.7 + 0.3, "z_score": F.col("z_score") * 1.0037 + 0.00013})


def card_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    sig = odd_numbers(tables.signals(spark, sf_dir))
    factors = F.transform(F.sequence(F.lit(1), (F.col("id") % 5 + 1).cast("int")), lambda i: F.concat(F.lit("factor "), i.cast("string")))
    proof = F.when(F.col("id") % 4 == 0, F.concat(F.lit("0xaudit"), F.col("id").cast("string")))
    return sig.withColumns({"key_factors": factors, "audit_tx_hash": proof, "smart_money_count": (F.col("id") % 3).cast("int")})


def _names(mapping: dict, column: str, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE {default} END"


USD_SQL = "CASE WHEN total_volume_usd >= 1000000 THEN printf('$%.1fM', total_volume_usd / 1000000) WHEN total_volume_usd >= 1000 THEN printf('$%.0fK', total_volume_usd / 1000) ELSE printf('$%.0f', total_volume_usd) END"
BAR_SQL = """CASE WHEN confidence >= 75 THEN '🟢' WHEN confidence >= 55 THEN '🟡' ELSE '🔴' END || ' ' || repeat('█', CAST(round_even(confidence / 10, 0) AS INTEGER)) || repeat('░', 10 - CAST(round_even(confidence / 10, 0) AS INTEGER)) || ' ' || confidence || '%'"""


@query(
    tables.with_ctes(
        "sig",
        f"""SELECT id, {BAR_SQL} AS bar, pool[1:6] || '...' || pool[-4:] AS short_pool, {_names(dims.SIGNAL_LABELS, "signal_type", "'Signal'")} AS label, {_names(dims.SIGNAL_EMOJIS, "signal_type", f"'{dims.OTHER_EMOJI}'")} AS emoji,
    {_names(dims.PROTOCOL_NAMES, "protocol", "protocol")} AS protocol_name, {_names(dims.CHAIN_NAMES, "chain", "chain")} AS chain_name, {_names(dims.EXPLORERS, "chain", "''")} AS explorer FROM sig""",
    )
)
def str2_str4_str5_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.signals(spark, sf_dir).select(
        "id",
        texts.confidence_bar(F.col("confidence")).alias("bar"),
        texts.short_address(F.col("pool")).alias("short_pool"),
        texts.label(F.col("signal_type")).alias("label"),
        texts.emoji(F.col("signal_type")).alias("emoji"),
        texts.protocol_name(F.col("protocol")).alias("protocol_name"),
        texts.chain_name(F.col("chain")).alias("chain_name"),
        texts.explorer(F.col("chain")).alias("explorer"),
    )


@query(tables.with_ctes("sig", "SELECT id, CASE WHEN x >= 1000000 THEN printf('$%.1fM', x / 1000000) WHEN x >= 1000 THEN printf('$%.0fK', x / 1000) ELSE printf('$%.0f', x) END AS usd FROM (SELECT id, total_volume_usd * 37.7 + 0.3 AS x FROM sig)"))
def str3_format_usd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.signals(spark, sf_dir).select("id", texts.format_usd(F.col("total_volume_usd") * 37.7 + 0.3).alias("usd"))


def _card_sql(style: str) -> str:
    (b, b_), (i, i_), link = texts.STYLES[style]
    chain, explorer = _names(dims.CHAIN_NAMES, "chain", "chain"), _names(dims.EXPLORERS, "chain", "''")
    linked = lambda name, url: "'" + link.replace("'", "''").replace("{url}", f"' || {url} || '").replace("{name}", f"' || {name} || '") + "'"
    seen = f"""CASE WHEN id % 4 = 0 THEN {linked("'proof of this alert'", f"{explorer} || '/tx/0xaudit' || id")} ELSE {linked("'pool ' || pool[1:6] || '...' || pool[-4:]", f"{explorer} || '/address/' || pool")} END"""
    lines = [
        f"""{_names(dims.SIGNAL_EMOJIS, "signal_type", "''")} || ' {b}' || {_names(dims.SIGNAL_LABELS, "signal_type", "''")} || ' on ' || {chain} || '{b_}'""",
        f"""'{i}seen at ' || {_names(dims.PROTOCOL_NAMES, "protocol", "protocol")} || '{i_}'""",
        "summary",
        f"'{b}Confidence{b_}: ' || {BAR_SQL}",
        f"'{b}Size{b_}: ' || {USD_SQL} || ' of ' || event_type",
        f"'{b}Deviation{b_}: ' || printf('%.2f sigma over two weeks', z_score)",
        f"'{b}Wallets{b_}: 3' || CASE WHEN id % 3 > 0 THEN ', of these ' || id % 3 || ' with a good record' ELSE '' END",
        "array_to_string(list_transform(range(1, least(id % 5 + 1, 3) + 1), lambda x: '- factor ' || x), chr(10))",
        seen,
        "'To check it, send: verify ' || id",
        f"'{i}Signal Scout. This is no investment advice.{i_}'",
    ]
    return " || chr(10) || ".join(f"({x})" for x in lines)


@query(tables.with_ctes("sig", f"SELECT id, {', '.join(f'{_card_sql(s)} AS {s}' for s in texts.STYLES)} FROM odd", ODD))
def str7_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert texts in the three styles."""
    return card_rows(spark, sf_dir).select("id", *[texts.card(style).alias(style) for style in texts.STYLES])


PROMPT_SQL = f"""'What kind of signal is this? ' || CASE WHEN event_type = 'mint' THEN '3 wallet(s) put liquidity in, by itself no sign of buying' WHEN event_type = 'burn' THEN '3 wallet(s) took liquidity out, by itself no sign of selling'
    WHEN z_score >= 4 THEN '3 wallets moved together' ELSE 'more ' || event_type || ' than is usual here' END || '.' || chr(10) || 'Where: ' || protocol || ' on ' || {_names(dims.CHAIN_NAMES, "chain", "chain")} || ', pool ' || pool || chr(10)
    || 'What: ' || event_type || ' of ' || printf('%.2f', total_volume_usd) || ' USD within ' || CASE WHEN id % 300 >= 60 THEN printf('%d minutes', id % 300 // 60) ELSE printf('%d seconds', id % 300) END || chr(10)
    || 'Usual: ' || printf('%.2f', total_volume_usd / greatest(z_score, 1)) || ' USD an hour; this is ' || printf('%.1f', z_score) || ' deviations above' || chr(10) || 'Who: 3 wallet(s)' || chr(10)
    || array_to_string(list_transform([1, 2, 3], lambda i: i || ') ' || wallets[i][1:12] || '...' || wallets[i][-6:]), chr(10)) || chr(10) || 'Answer with one JSON object: summary, confidence, signal_type, key_factors.'"""


@query(tables.with_ctes("sig", f"SELECT id, {PROMPT_SQL} AS prompt FROM odd", ODD))
def str6_dat2_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = odd_numbers(tables.signals(spark, sf_dir)).withColumns({"first_us": F.col("detected_us") - (F.col("id") % 300) * 1_000_000, "last_us": F.col("detected_us")})
    return rows.select("id", texts.prompt(classify.duration_text()).alias("prompt"))


@query(
    tables.with_ctes(
        "ev",
        """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '3 wallet(s) put liquidity in, by itself no sign of buying' WHEN event_id % 3 = 0 THEN '3 wallets moved together' ELSE 'more swap than is usual here' END AS pattern,
    CASE WHEN event_id % 200 >= 60 THEN printf('%d minutes', (event_id % 200) // 60) ELSE printf('%d seconds', event_id % 200) END AS duration FROM ev""",
    )
)
def str6_dat2_pattern_and_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    ev = tables.events(spark, sf_dir).withColumns({"first_us": F.col("us"), "last_us": F.col("us") + key % 200 * 1_000_000})
    kind = F.when(key % 2 == 0, F.lit("mint")).otherwise(F.lit("swap"))
    z = F.when(key % 3 == 0, 4.0).otherwise(1.0)
    return ev.select("event_id", texts.pattern_text(kind, F.lit(3), z).alias("pattern"), classify.duration_text().alias("duration"))


@query(
    tables.with_ctes(
        "sig",
        """SELECT id, CASE WHEN n = 1 THEN 'Signal ' || id END AS plain_summary, CASE WHEN n = 1 THEN least(greatest(confidence * 2 - 20, 0), 100) WHEN n = 2 THEN 0 WHEN n = 7 THEN 1 WHEN n = 8 THEN 42 WHEN n = 9 THEN 87 END AS confidence,
    CASE WHEN n = 1 THEN signal_type WHEN n IN (2, 7, 8, 9) THEN 'unusual_volume' END AS signal_type, CASE WHEN n = 1 THEN 'a,b,c,d,e' WHEN n IN (2, 7, 8, 9) THEN 'Unusual on-chain activity detected' END AS key_factors
    FROM (SELECT *, id % 12 AS n FROM sig)""",
    )
)
def jsn1_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies as classifiers write them: fenced, without numbers, with odd, bad and null ones, not JSON, empty."""
    sig = tables.signals(spark, sf_dir)
    n = F.col("id") % 12
    whole = F.to_json(F.struct("summary", (F.col("confidence") * 2 - 20).alias("confidence"), F.upper("signal_type").alias("signal_type"), F.array(*map(F.lit, "abcdefg")).alias("key_factors")))
    raw = (
        F.when(n == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
        .when(n == 2, F.lit('{"summary": "x", "signal_type": "moon"}'))
        .when(n == 3, F.lit('{"summary": "x", "confidence": "high"}'))
        .when(n == 4, F.lit("I can't say."))
        .when(n == 5, F.lit('{"confidence": 3}'))
        .when(n == 6, F.lit('{"summary": "x", "confidence": null}'))
        .when(n == 7, F.lit('{"summary": "x", "confidence": true}'))
        .when(n == 8, F.lit('{"summary": "x", "confidence": " 42 "}'))
        .when(n == 9, F.lit('{"summary": "x", "confidence": 87.9}'))
        .when(n == 10, F.lit('{"summary": "x", "confidence": "8.5"}'))
        .when(n == 11, F.lit('{"summary": "x", "confidence": [3]}'))
        .otherwise(F.lit(" "))
    )
    r = payloads.parse_reply(raw)
    return sig.select("id", F.when(n < 2, r["summary"]).alias("plain_summary"), r["confidence"].alias("confidence"), r["signal_type"].alias("signal_type"), F.array_join(r["key_factors"], ",").alias("key_factors"))


CANON = """'{"chain":"' || chain || '","confidence":' || confidence || ',"deliver_at":"' || strftime(make_timestamp(detected_us + 300000000), '%Y-%m-%dT%H:%M:%S') || 'Z","id":' || id || ',"pool":"' || pool || '","protocol":"' || protocol || '","signal_type":"' || signal_type || '","summary":"' || summary || '"}'"""


@query(tables.with_ctes("sig", f"SELECT id, {CANON} AS canonical, sha256({CANON}) AS sha FROM sig"))
def jsn2_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = payloads.canonical_json()
    return tables.signals(spark, sf_dir).select("id", text.alias("canonical"), F.sha2(text, 256).alias("sha"))


@query()
def hash2_jn18_audit_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recomputed hash against the audit log, which has none for every seventh signal; every fifth was changed since.

    The log's hashes are of texts put together field by field, not by the JSON writer.
    """
    sig = tables.signals(spark, sf_dir)
    changed = sig.withColumn("summary", F.when(F.col("id") % 5 == 0, F.concat("summary", F.lit("!"))).otherwise(F.col("summary")))
    text = F.format_string(
        '{"chain":"%s","confidence":%d,"deliver_at":"%s","id":%d,"pool":"%s","protocol":"%s","signal_type":"%s","summary":"%s"}',
        "chain", "confidence", F.date_format("deliver_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "id", "pool", "protocol", "signal_type", "summary",
    )
    logged = sig.where("id % 7 <> 0").select("id", keccak.keccak_hex(text).alias("stored"))
    sig = changed.withColumn("hash", keccak.keccak_hex(payloads.canonical_json()))
    state = F.when(F.col("stored").isNull(), "unknown").when(F.col("stored") == F.col("hash"), "verified").otherwise("mismatch")
    return sig.join(logged, "id", "left").select("id", "hash", state.alias("state"))


@query(tables.with_ctes("sig", "SELECT CASE WHEN id % 7 = 0 THEN 'unknown' WHEN id % 5 = 0 THEN 'mismatch' ELSE 'verified' END AS state, count(*) AS n FROM sig GROUP BY ALL"))
def jn18_audit_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash2_jn18_audit_check(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))


@query(tables.with_ctes("sig", "SELECT count(*) AS n, count(DISTINCT id) AS ids, CAST(sum(confidence) AS BIGINT) AS confidence FROM sig"))
def jsn3_payload_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = tables.signals(spark, sf_dir).select(payloads.signal_payload().alias("value"))
    read = text.select(F.from_json("value", "id bigint, confidence int").alias("p"))
    return read.agg(F.count("*").alias("n"), F.countDistinct("p.id").alias("ids"), F.sum("p.confidence").alias("confidence"))


@query(tables.with_ctes("sig", "SELECT count(*) AS n, count(DISTINCT (chain, protocol, pool, signal_type, confidence, detected_us, z_score, total_volume_usd)) AS prints FROM sig"))
def hash1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.signals(spark, sf_dir).agg(F.count("*").alias("n"), F.countDistinct(payloads.fingerprint()).alias("prints"))


@query(tables.with_ctes("sig", "SELECT id, detected_us // 3600000000 * 3600000000 AS hour_us, detected_us // 86400000000 * 86400000000 AS day_us, detected_us + 7 * 86400000000 AS due_us, detected_us // 1000000 AS seconds FROM sig"))
def dat1_dat3_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floors, horizons, and an ISO text read back."""
    ts = F.to_timestamp(F.date_format("detected_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    micros = F.unix_micros
    return tables.signals(spark, sf_dir).select("id", micros(F.date_trunc("hour", ts)).alias("hour_us"), micros(F.date_trunc("day", ts)).alias("day_us"), micros(ts + F.expr("INTERVAL 7 DAYS")).alias("due_us"), F.unix_seconds(ts).alias("seconds"))
