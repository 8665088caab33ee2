"""Token payments credited to subscriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.addresses import padded_topic

DAY_US = 86_400_000_000


def receipts(logs: DataFrame, token: str, receiver: str, transfer_topic: str, head: int, confirmations: int = 12) -> DataFrame:
    """Confirmed transfers of ``token`` to ``receiver``."""
    to = padded_topic(F.lit(receiver))
    return logs.where((F.lower("address") == token.lower()) & (F.col("topics")[0] == transfer_topic) & (F.lower(F.col("topics")[2]) == to) & (F.col("block_number") <= head - confirmations))


def tier_days(amount: Column, monthly: float = 29.0, slack: float = 0.01) -> Column:
    """Days that an amount pays for: the longest tier it covers, else null."""
    six, twelve = round(6 * monthly * 0.95, 2), round(12 * monthly * 0.90, 2)
    return F.when(amount >= twelve - slack, 365).when(amount >= six - slack, 180).when(amount >= monthly - slack, 30)


def new_payments(payments: DataFrame, ledger: DataFrame, key: tuple[str, ...] = ("chain", "tx_hash", "log_index")) -> DataFrame:
    """Payments that are not in the ledger, each once."""
    return payments.dropDuplicates(list(key)).join(ledger.select(*key), list(key), "left_anti")


def match_accounts(payments: DataFrame, subscribers: DataFrame) -> DataFrame:
    """Payments with the lowest account id registered for their sender; unmatched ones stay."""
    first = subscribers.where(F.col("registered_wallet").isNotNull()).groupBy(F.lower("registered_wallet").alias("wallet")).agg(F.min("sub_id").alias("sub_id"))
    return payments.withColumn("wallet", F.lower("from_address")).join(first, "wallet", "left").withColumn("matched", F.col("sub_id").isNotNull()).drop("wallet")


def stacked_expiry(credits: DataFrame, key: str = "sub_id", opening: str | None = None) -> DataFrame:
    """Expiry after each credit (us, days): days are added to the later of now and the last expiry.

    The fold has a closed form over running windows: with S the running days, the expiry
    is S + the running maximum of (time - days before it), from the opening expiry on.
    """
    w = Window.partitionBy(key).orderBy("us", "payment_id").rowsBetween(Window.unboundedPreceding, 0)
    days_us = F.col("days") * F.lit(DAY_US)
    total = F.sum(days_us).over(w)
    rows = credits.withColumn("_total", total).withColumn("_from", F.col("us") - (F.col("_total") - days_us))
    latest = F.max("_from").over(w)
    start = latest if opening is None else F.greatest(latest, F.col(opening))
    return rows.withColumn("expires_us", F.col("_total") + start).drop("_total", "_from")


def valid_leads(leads: DataFrame) -> DataFrame:
    """Leads with a plausible email and wallet; the note is trimmed to 500 characters."""
    email, wallet = F.trim("email"), F.trim("wallet")
    ok = email.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$") & (wallet.isNull() | (wallet == "") | wallet.rlike("^0x[0-9a-fA-F]{40}$"))
    return leads.where(F.coalesce(ok, F.lit(False))).withColumn("note", F.substring(F.trim("note"), 1, 500))
