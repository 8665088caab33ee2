"""JSON in and out: replies, payloads, canonical forms, fingerprints, loose booleans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import dims, schemas


def parse_reply(raw: Column) -> Column:
    """A classifier's reply as struct<summary, confidence, signal_type, key_factors>, or null.

    Code fences are stripped.  A reply needs a JSON object with a summary and, if it has
    a confidence, something that counts as a whole number: a number (cut to its integer
    part), a boolean (0 or 1) or a text of digits with a sign at most.  A null, a list, an object and
    texts such as "1e2" or "8.5" make the reply invalid; a missing confidence is 0.
    Confidence is cut to 0-100, unknown types become unusual_volume, and at most five
    factors stay.
    """
    body = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"^\s+|\s+$", ""), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    get = lambda name: F.get_json_object(body, f"$.{name}")
    parsed = F.from_json(body, "map<string,string>")
    summary = F.trim(get("summary"))
    given = F.try_variant_get(F.try_parse_json(body), "$.confidence", "variant")
    what = F.schema_of_variant(given)
    digits = F.regexp_extract(F.try_variant_get(given, "$", "string"), r"^\s*([+-]?\d+)\s*$", 1).try_cast("double")
    value = F.when(what == "STRING", digits).when(what == "BOOLEAN", F.try_variant_get(given, "$", "boolean").cast("double")).otherwise(F.try_variant_get(given, "$", "double"))
    number = F.when(given.isNull(), F.lit(0)).when(value.isNotNull() & ~what.startswith("ARRAY") & ~what.startswith("OBJECT"), F.least(F.greatest(value, F.lit(-1.0)), F.lit(101.0)).cast("int"))
    kind = F.lower(F.trim(get("signal_type")))
    factors = F.filter(F.transform(F.from_json(get("key_factors"), "array<string>"), F.trim), lambda f: f.isNotNull() & (f != ""))
    single = F.when(get("key_factors").isNotNull() & ~get("key_factors").startswith("["), F.array(get("key_factors")))
    listed = F.slice(F.coalesce(single, factors, F.array().cast("array<string>")), 1, 5)
    fields = F.struct(
        summary.alias("summary"),
        F.least(F.greatest(number, F.lit(0)), F.lit(100)).alias("confidence"),
        F.when(kind.isin(*dims.SIGNAL_TYPES), kind).otherwise("unusual_volume").alias("signal_type"),
        F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("Unusual on-chain activity detected"))).alias("key_factors"),
    )
    return F.when(parsed.isNotNull() & body.startswith("{") & (F.coalesce(summary, F.lit("")) != "") & number.isNotNull(), fields)


def event_payload() -> Column:
    """The queue payload of an event row."""
    return F.to_json(F.struct("chain", "block", F.col("tx").alias("tx_full"), F.col("tx").substr(1, 10).alias("tx"), "protocol", F.col("pool").alias("pool_full"), F.col("pool").substr(1, 10).alias("pool"), F.col("wallet").alias("wallet_full"), F.col("wallet").substr(1, 10).alias("wallet"), "type", F.round("usd", 2).alias("usd"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts")))


def read_events(values: DataFrame, column: str = "value", default_chain: str = "mantle") -> DataFrame:
    """Events of JSON payloads: full fields before short ones, with the defaults of old payloads.

    A time that can't be read becomes the time of reading.
    """
    p = F.from_json(F.col(column).cast("string"), schemas.EVENT_PAYLOAD).alias("p")
    text = lambda *names: F.coalesce(*[F.col(f"p.{n}") for n in names], F.lit(""))
    ts = F.coalesce(F.try_to_timestamp("p.ts"), F.current_timestamp())
    return values.select(p).select(
        F.coalesce("p.chain", F.lit(default_chain)).alias("chain"),
        F.coalesce("p.block", F.lit(0)).alias("block"),
        text("tx_full", "tx").alias("tx"),
        text("protocol").alias("protocol"),
        F.lower(text("pool_full", "pool")).alias("pool"),
        F.lower(text("wallet_full", "wallet")).alias("wallet"),
        F.coalesce("p.type", F.lit("swap")).alias("type"),
        F.coalesce("p.usd", F.lit(0.0)).alias("usd"),
        ts.alias("ts"),
        F.unix_micros(ts).alias("us"),
    )


def canonical_json() -> Column:
    """A signal's compact JSON with keys in alphabetical order, as it is hashed."""
    return F.to_json(F.struct("chain", "confidence", F.date_format("deliver_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("deliver_at"), F.coalesce("id", F.lit(0)).alias("id"), F.lower("pool").alias("pool"), "protocol", "signal_type", "summary"))


def signal_payload() -> Column:
    return F.to_json(F.struct("id", "chain", "protocol", "pool", "wallets", "signal_type", "confidence", "summary", "detected_at", "deliver_at", "z_score", "total_volume_usd", "event_type"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})


def fingerprint() -> Column:
    """sha256 over the eight fields that make a signal what it is."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("chain", "protocol", "pool", "signal_type", "confidence", "detected_us")]
    rounded = [F.coalesce(F.format_string("%.6f", c), F.lit("\x00")) for c in ("z_score", "total_volume_usd")]
    return F.sha2(F.concat_ws("|", *parts, *rounded), 256)


def loose_bool(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("true", "1", "yes"), F.lit(False))
