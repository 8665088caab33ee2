"""Secret scans with multipart credential linking, in built-in functions only.

Every pattern gives spans by code point: the texts between matches and the matches
themselves have lengths whose running sums are the positions.  Blank lines and section
heads cut a text into scopes.  Weak candidates (short secret values, account names,
endpoints) are reported only where the parts that would complete a credential lie in
their scope and within reach.  The join of the span intervals is a search for the nearest
span of each role on either side; its two running frames, in ascending and in descending
order, make it linear in the spans of a text beside their sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Base patterns (fixed values of the contract); letters of the first one's names in either case.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of the class is matched whole, so its least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Weak parts of a credential.
IDENT = r"""(?i:client_?id|account_?id|access_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
ENDPOINT = r"""(?i:https?|ftp|sftp|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[^\x00-\x20"'<>]{4,}"""
#: What ends a scope: blank lines, and the head of a section on a line of its own.
SCOPE = r"\n[\x20\t\r]*\n|\n\x20*\[[^\]\n]{1,80}\][\x20\t\r]*(?=\n)"
#: Order of kinds at one place.
KINDS = ("assign", "access", "hex", "ident", "weak", "endpoint")
ROLES = {"assign": "secret", "hex": "secret", "weak": "secret", "access": "identifier", "ident": "identifier", "endpoint": "endpoint"}


def _quoted(pattern: str) -> Column:
    return F.lit(pattern)


def _lengths(pattern: str) -> Column:
    """For each match: length of the text before it (since the last match) and its own."""
    found = F.regexp_extract_all("text", _quoted(pattern), F.lit(0))
    gaps = F.transform(F.split("text", pattern, -1), F.length)
    return F.arrays_zip(F.transform(found, F.length).alias("own"), F.slice(gaps, 1, F.size(found)).alias("before"), F.transform(found, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) if pattern == ASSIGN else F.length(m)).alias("value"))


def _nearest(scope: list[str], role: Column, wanted: str, reach: int) -> Column:
    """Start of the nearest span of a role in the same scope and within ``reach``, else null; of two as near the earlier."""
    ahead = Window.partitionBy(*scope).orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*scope).orderBy(F.desc("start"), F.desc("end"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    past = F.max(F.when(role == wanted, F.struct("end", "start"))).over(ahead)
    coming = F.min(F.when(role == wanted, F.col("start"))).over(behind)
    back = F.when(past.isNotNull(), F.greatest(F.col("start") - past["end"], F.lit(0))).otherwise(reach + 1)
    forth = F.when(coming.isNotNull(), F.greatest(coming - F.col("end"), F.lit(0))).otherwise(reach + 1)
    return F.when((back <= reach) & (back <= forth), past["start"]).when(forth <= reach, coming)


def credential_spans(docs: DataFrame, reach: int = 200, weak_chars: int = 6) -> DataFrame:
    """All spans: doc_id, text_hash, scope, kind, start, end, base, secret_at, identifier_at.

    Base spans always stay.  In its scope (text between blank lines or section heads, counted from 0)
    an ``ident`` span needs a secret within ``reach`` code points, a ``weak`` secret (a value
    of ``weak_chars`` to 11 characters) an identifier, and an ``endpoint`` a secret and an
    identifier that are reported themselves.  secret_at and identifier_at are the starts of
    the nearest reported partners, null where there is none.  Repeated rows give their
    spans once.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # one cheap test spares most texts the positions of the patterns
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "ident": IDENT, "endpoint": ENDPOINT}
    arrays = [F.when(F.col("text").rlike(p), _lengths(p)).alias(k) for k, p in patterns.items()]
    held = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", *arrays).where(" or ".join(f"{k} is not null" for k in patterns))
    per_text = held.withColumn("scope", F.when(F.col("text").rlike(SCOPE), _lengths(SCOPE))).drop("text").dropDuplicates(["doc_id", "text_hash"])
    kinds = F.array(*[F.struct(F.lit(k).alias("found"), F.col(k).alias("spans")) for k in (*patterns, "scope")])
    spans = per_text.select("doc_id", "text_hash", F.explode(kinds).alias("k")).select("doc_id", "text_hash", "k.found", F.posexplode("k.spans").alias("nth", "span"))
    running = Window.partitionBy("doc_id", "text_hash", "found").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = spans.select("doc_id", "text_hash", "found", F.sum(F.col("span.own") + F.col("span.before")).over(running).alias("end"), F.col("span.own").alias("own"), F.col("span.value").alias("value"))
    kind = F.when((F.col("found") == "assign") & (F.col("value") < 12), F.when(F.col("value") >= weak_chars, "weak")).otherwise(F.col("found"))
    placed = placed.select("doc_id", "text_hash", kind.alias("kind"), (F.col("end") - F.col("own")).alias("start"), "end").where("kind is not null")
    text = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, 0)
    scoped = placed.withColumn("scope", F.count_if(F.col("kind") == "scope").over(text)).where("kind <> 'scope'")
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])[F.col("kind")]
    scope = ["doc_id", "text_hash", "scope"]
    base = F.col("kind").isin("assign", "access", "hex")
    pairs = scoped.withColumns({"role": role, "base": base, "secret_at": _nearest(scope, role, "secret", reach), "identifier_at": _nearest(scope, role, "identifier", reach)})
    # partners are mutual: a weak secret and the name that completes it are reported together
    kept = F.col("base") | ((F.col("kind") == "ident") & F.col("secret_at").isNotNull()) | ((F.col("kind") == "weak") & F.col("identifier_at").isNotNull())
    parts = pairs.where(kept | (F.col("kind") == "endpoint"))
    linked = parts.withColumns({"secret_at": _nearest(scope, F.col("role"), "secret", reach), "identifier_at": _nearest(scope, F.col("role"), "identifier", reach)})
    whole = (F.col("kind") != "endpoint") | (F.col("secret_at").isNotNull() & F.col("identifier_at").isNotNull())
    return linked.where(whole).select("doc_id", "text_hash", "scope", "kind", "start", "end", "base", "secret_at", "identifier_at")


def scan_secrets(docs: DataFrame, reach: int = 200) -> DataFrame:
    """For each document: counts of base spans, their digest, all spans and the links of weak ones as text.

    Spans are kind:start:end by start, then in the order of ``KINDS``; start and end are
    code points, end exclusive.  links has start>partner for each partner of a span that
    is not a base span.  A null or empty text has no spans; long texts are searched whole;
    spans may overlap; repeated rows repeat their result; an empty table gives no rows.
    Only doc_id and text are read, so other columns may have any name.
    """
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    entry = F.struct("start", rank.alias("rank"), F.concat_ws(":", "kind", "start", "end").alias("span"), "base", "secret_at", "identifier_at")
    by_text = credential_spans(docs, reach).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(entry)).alias("found"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("assign", "access", "hex")])

    def joined(found: Column) -> Column:
        return F.array_join(F.transform(found, lambda x: x.span), ",")

    def links(found: Column, at: str) -> Column:
        return F.transform(F.filter(found, lambda x: ~x.base & x[at].isNotNull()), lambda x: F.concat_ws(">", x.start.cast("string"), x[at].cast("string")))

    linked = F.array_join(F.array_sort(F.concat(links(F.col("found"), "secret_at"), links(F.col("found"), "identifier_at"))), ",")
    by_text = by_text.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "n_assign", "n_access", "n_hex", joined(F.filter("found", lambda x: x.base)).alias("base_spans"), joined(F.col("found")).alias("spans"), linked.alias("links"))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    rows = every.join(by_text, every.doc_id.eqNullSafe(by_text.id) & (every.text_hash == by_text.hash), "left")
    counts = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return rows.select("doc_id", *counts, F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("links", F.lit("")).alias("links"))
