"""Quality rules with thresholds from the data, in built-in functions only.

Measures of a text are whole numbers, and a quantile sketch is a table of how many
documents have a measure in a bucket: the number itself up to 63, above that its six
leading binary digits, so a bucket is within a 32nd of what it holds.  Sketches merge by
adding counts: those of small groups of language and source give way to that of the
language, and this to that of all.  Documents are then joined with their group's cutoffs.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Signs between words, and symbols that prose rarely has (fixed values).
BLANKS, SYMBOLS = " \t\n\x0b\f\r", "[#*$%&|<>]"
WINDOW = 5


class Rule(NamedTuple):
    """A share in thousandths of ``part`` to ``whole``, and how wide its spread counts at least."""

    name: str
    part: str
    whole: str
    slack: int
    low: bool = False


RULES = (
    Rule("word_length", "word_chars", "n_words", 500, low=True),
    Rule("symbols", "n_symbols", "n_words", 25),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 100),
    Rule("repeats", "n_repeat_words", "n_words", 50),
)
#: A cutoff lies so many spreads (between quartile and median) beyond the quartile.
REACH = 4
#: Groups with fewer documents use the sketch that they merge into.
MIN_DOCS = 200
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash comes twice: equal neighbours after sorting, then the union of their ranges."""

    def places(by_hash: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(by_hash, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(by_hash, j + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(by_hash, same), lambda x: x["i"]))

    def total(at: Column) -> Column:
        each = F.transform(at, lambda i, j: F.coalesce(F.least(F.get(at, j + 1) - i, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(each, F.lit(0), lambda a, x: a + x)

    rows = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return _bound(_bound(F.sort_array(rows), places), total)


def _repeated_words(words: Column) -> Column:
    starts = F.when(F.size(words) >= WINDOW, F.sequence(F.lit(0), F.size(words) - WINDOW)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return _bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(F.lit(0)))


def measures(text: Column) -> Column:
    """A struct of the measures of a whole text; null counts as empty.

    Windows of five words are compared by 64-bit hashes.
    """
    whole = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(whole, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{BLANKS}]+", -1))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    as_long = lambda x, name: x.cast("long").alias(name)

    def found(x: Column) -> Column:
        own = x["words"]
        return F.struct(
            as_long(F.size(own), "n_words"),
            as_long(F.length(F.array_join(own, "")), "word_chars"),
            as_long(F.regexp_count(x["whole"], F.lit(SYMBOLS)), "n_symbols"),
            as_long(F.size(x["lines"]) - F.size(F.array_distinct(x["lines"])), "n_dup_lines"),
            as_long(_bound(own, _repeated_words), "n_repeat_words"),
            as_long(F.size(x["lines"]), "n_lines"),
        )

    return _bound(F.struct(words.alias("words"), lines.alias("lines"), whole.alias("whole")), found)


def measured(docs: DataFrame, *kept: Column) -> DataFrame:
    """``kept`` columns of ``docs`` with the measures and base_failed, the fixed part of the rules."""
    rows = docs.select(*kept, measures(F.col("text")).alias("_m"))
    names = [c for c in rows.columns if c != "_m"]
    flat = rows.select(*[common.quoted(c) for c in names], *[F.col("_m")[m].alias(m) for m in _MEASURES])
    return flat.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def share(rule: Rule) -> Column:
    """The rule's measure in thousandths, rounded down; 0 if there is nothing to divide by."""
    return F.coalesce(F.expr(f"1000 * {rule.part} div nullif({rule.whole}, 0)"), F.lit(0).cast("long"))


def bucket(value: Column) -> Column:
    """The lower end of a number's bucket."""
    digits = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, digits), digits)


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, n) of measured documents; counts are added up before the shuffle."""
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), bucket(share(r)).alias("bucket")) for r in RULES]))
    return rows.select("lang", "source", each.alias("x")).groupBy("lang", "source", "x.rule", "x.bucket").agg(F.count("*").alias("n"))


def _levels() -> Column:
    """A group's keys from its own to all: language and source, language, nothing."""
    own = [F.to_json(F.struct(*c)) for c in (("lang", "source"), ("lang",))]
    keys = [*own, F.lit("all")]
    return F.array(*[F.struct(F.lit(i).alias("level"), k.alias("key")) for i, k in enumerate(keys)])


def quantiles(sketch: DataFrame, by: tuple[str, ...], shares: dict[str, int]) -> DataFrame:
    """Merged sketches by ``by``, and their quantiles at percentages; one row for each ``by``, with n.

    A quantile is the lower end of the first bucket up to which that share of documents
    lies.  A sketch has under 2000 buckets, whatever it holds.
    """
    merged = sketch.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by)
    up_to = merged.withColumn("below", F.sum("n").over(w.orderBy("bucket"))).withColumn("all", F.sum("n").over(w))
    found = [F.min(F.when(100 * F.col("below") >= p * F.col("all"), F.col("bucket"))).alias(name) for name, p in shares.items()]
    return up_to.groupBy(*by).agg(F.sum("n").alias("n"), *found)


def cutoffs(sketch: DataFrame, min_docs: int = MIN_DOCS, reach: int = REACH) -> DataFrame:
    """One row for each language and source with the lowest and highest share that each rule lets through."""
    levels = sketch.withColumn("x", F.explode(_levels())).select("x.level", "x.key", "rule", "bucket", "n")
    found = quantiles(levels, ("level", "key", "rule"), {"q25": 25, "q50": 50, "q75": 75})
    pick = {r.name: r for r in RULES}
    slack = F.element_at(F.create_map(*[F.lit(v) for r in RULES for v in (r.name, r.slack)]), F.col("rule"))
    high = F.col("q75") + reach * F.greatest(F.col("q75") - F.col("q50"), slack)
    low = F.when(F.col("rule").isin(*[r for r in pick if pick[r].low]), F.col("q25") - reach * F.greatest(F.col("q50") - F.col("q25"), slack))
    limits = found.select("level", "key", "rule", F.col("n").alias("docs"), high.cast("long").alias("high"), low.cast("long").alias("low"))
    groups = sketch.select("lang", "source").distinct().withColumn("x", F.explode(_levels())).select("lang", "source", "x.level", "x.key")
    able = (F.col("docs") >= min_docs) | (F.col("level") == 2)
    used = groups.join(limits, ["level", "key"]).where(able)
    own = used.groupBy("lang", "source", "rule").agg(F.min_by(F.struct("high", "low"), "level").alias("x"))
    sides = [F.max(F.when(F.col("rule") == r.name, F.col(f"x.{side}"))).alias(f"{side}_{r.name}") for r in RULES for side in ("low", "high")]
    return own.groupBy("lang", "source").agg(*sides)


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Measured documents with failed, the rules that they break, and kept."""
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    joined = rows.join(limits, same, "left").drop("_lang", "_source")
    broken = lambda r: (share(r) > F.col(f"high_{r.name}")) | (F.coalesce(share(r) < F.col(f"low_{r.name}"), F.lit(False)))
    failed = F.array_compact(F.array(F.when(F.col("base_failed"), "base"), *[F.when(broken(r), r.name) for r in RULES]))
    return joined.withColumn("failed", failed).withColumn("kept", F.size("failed") == 0).drop(*[f"{s}_{r.name}" for r in RULES for s in ("low", "high")])


def quality_rules(docs: DataFrame, min_docs: int = MIN_DOCS, reach: int = REACH) -> DataFrame:
    """doc_id, the measures, base_failed, kept and failed of every document.

    Sketches are of the documents that do not fail the base rules.  Null and empty texts
    have no words and fail them, long texts are measured whole, repeated rows count each,
    a share on a cutoff is kept, null languages and sources are groups of their own, and
    an empty table gives no rows.  Only doc_id, text, lang and source are read, so other
    columns may have any name.
    """
    kept = [F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")]
    with common.scratch(docs.sparkSession) as scratch:
        rows = scratch.table(measured(docs, *kept), "measures")
        limits = scratch.table(cutoffs(sketches(rows.where(~F.col("base_failed"))), min_docs, reach), "cutoffs")
        return common.materialize(judged(rows, limits).select("doc_id", *_MEASURES, "base_failed", "kept", "failed"), "rules")


def keep_by_rules(docs: DataFrame, min_docs: int = MIN_DOCS, reach: int = REACH) -> DataFrame:
    """The rows of ``docs`` that pass the rules of ``quality_rules``, with all their columns.

    Texts are measured twice, once for the sketches and once as they are filtered, so that
    none is shuffled or stored in between; cutoffs are a row for each language and source.
    """
    kept = [F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")]
    limits = common.materialize(cutoffs(sketches(measured(docs, *kept).where(~F.col("base_failed"))), min_docs, reach), "cutoffs")
    row = common.fresh("row", docs.columns)
    rows = measured(docs, *kept, F.struct(*common.columns_of(docs)).alias(row))
    return judged(rows, limits).where("kept").select(f"{row}.*")
