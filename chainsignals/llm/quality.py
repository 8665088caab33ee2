"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic classifier on the shape of a text gives its own evidence.  Sums of its
probabilities by host and by path of the host give site posteriors: a path is shrunk
toward its host and a host toward the whole corpus, by strengths that the spread
between sites sets (method of moments).  A document's odds are its own likelihood ratio
times the odds of its path without the document itself.  ``documents`` carries no URL
path, so by default lang stands in for the path and source for the host.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .logistic import Logistic

#: Labelled rows that the classifier is fitted on, about, at most.
FIT_ROWS = 8_000
#: Up to so many sites all go to every executor (some 100 bytes each); beyond, only those with most documents do.
BROADCAST_SITES = 200_000
_SHAPE = 96 + 9


def shape_features(text: bytes) -> np.ndarray:
    """Shares of the ASCII signs and a few facts about words and lines."""
    out = np.zeros(_SHAPE)
    if not text:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    out[:96] = np.sqrt(counts[32:128] / len(text))
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    upper = counts[65:91].sum()
    letters = upper + counts[97:123].sum() + counts[128:].sum()
    n = max(1, len(words))
    out[96:] = (
        np.log1p(len(text)),
        np.log1p(len(words)),
        len(set(words)) / n,
        len(text) / n,
        upper / max(1, letters),
        letters / len(text),
        counts[128:].sum() / len(text),
        len(set(lines)) / max(1, len(lines)),
        np.log1p(len(lines)),
    )
    return out


def _features(texts: pd.Series) -> np.ndarray:
    return np.stack([shape_features(t or b"") for t in texts]) if len(texts) else np.zeros((0, _SHAPE))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, folds: Column | None = None) -> DataFrame:
    """(doc_id, text, label) of about ``rows`` labelled documents at most, chosen by a hash of the id."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.where(folds) if folds is not None else known
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("double").alias("label"))
    n = known.count()
    scale = 1_000_000
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < int(scale * min(1.0, rows / max(1, n))))
    # at most about ``rows`` ids of 16 bytes
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("text")).join(F.broadcast(chosen), "doc_id")


def fit_classifier(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Logistic:
    """The shape classifier; only features of the bounded sample reach the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"label": frame["label"], "x": list(_features(frame["text"]))})

    found = labelled_sample(docs, labels, "quality", rows).mapInPandas(run, "label double, x array<double>").toPandas()
    x = np.stack(found["x"].to_list()) if len(found) else np.zeros((0, _SHAPE))
    return Logistic(x, found["label"].to_numpy(float))


def _logit_column(model: Logistic) -> Column:
    @F.pandas_udf("double")
    def logit(texts: pd.Series) -> pd.Series:
        parts = [model.logit(_features(texts.iloc[i : i + 512])) for i in range(0, len(texts), 512)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    # never null: else a filter on what follows would add a null test, and the texts go to Python twice
    return F.coalesce(logit(common.text_bytes()), F.lit(0.0))


def _probabilities(texts: DataFrame, model: Logistic) -> DataFrame:
    """(host, path, p) of each row of (host, path, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                z = model.logit(np.stack([shape_features(t) for t in part["text"].to_pylist()]))
                yield pa.RecordBatch.from_arrays([part["host"], part["path"], pa.array(1 / (1 + np.exp(-z)))], ["host", "path", "p"])

    return texts.mapInArrow(run, "host string, path string, p double")


def site_posteriors(scored: DataFrame) -> DataFrame:
    """(host, path, n, total, prior_mean, prior_strength, corpus_mean) for each path.

    ``scored`` has host, path and p.  prior_mean is the host's shrunk mean, to which the
    path is shrunk with prior_strength.  The result is a stored table.
    """

    def strength(groups: DataFrame, mean: Column) -> DataFrame:
        # between-group variance by moments, with the noise of n Bernoulli draws taken off
        m = F.col("total") / F.col("n")
        stats = groups.withColumn("centre", mean).agg(F.sum(F.col("n") * (m - F.col("centre")) ** 2).alias("between"), F.sum(F.col("centre") * (1 - F.col("centre"))).alias("noise"), F.sum("n").alias("rows"), F.count("*").alias("groups"), (F.sum("total") / F.sum("n")).alias("mean"))
        spread = F.greatest(F.lit(1e-6), (F.col("between") - F.col("noise")) / F.greatest(F.lit(1.0), F.col("rows")))
        return stats.select((F.col("mean") * (1 - F.col("mean")) / spread).alias("k"), "mean")

    with common.scratch(scored.sparkSession) as scratch:
        paths = scratch.table(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("total")), "paths")
        hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        whole = hosts.agg((F.sum("total") / F.sum("n")).alias("m")).first().m
        corpus_mean = F.lit(0.5 if whole is None else float(whole))
        k_host = _bounded(strength(hosts, corpus_mean).first().k)
        shrunk = hosts.select(F.col("host").alias("of"), ((F.col("total") + k_host * corpus_mean) / (F.col("n") + k_host)).alias("prior_mean"))
        joined = scratch.table(paths.join(shrunk, F.col("host").eqNullSafe(F.col("of"))).drop("of"), "sites")
        k_path = _bounded(strength(joined, F.col("prior_mean")).first().k)
        return common.materialize(joined.select("host", "path", "n", "total", "prior_mean", F.lit(k_path).alias("prior_strength"), corpus_mean.alias("corpus_mean")), "posteriors")


def _bounded(strength: float | None) -> float:
    """A strength between one document and a million."""
    return 1e6 if strength is None else float(min(1e6, max(1.0, strength)))


def with_sites(rows: DataFrame, sites: DataFrame, host: str, path: str) -> tuple[DataFrame, Column]:
    """``rows`` with one more column, a struct of their site's numbers, and that column.

    ``rows`` may carry texts.  Few sites are broadcast.  Of many, those that hold more than
    an even share of the documents are broadcast, and there are fewer of these than
    partitions; only rows of the other sites meet theirs by a shuffle, and the rows that
    are done are spread over it by their content.
    """
    spark = rows.sparkSession
    names = {c: common.fresh(f"_{c}", rows.columns) for c in ("host", "path", "site", "salt", "hot")}
    numbers = F.struct("n", "total", "prior_mean", "prior_strength").alias(names["site"])
    keyed = sites.select(F.col("host").alias(names["host"]), F.col("path").alias(names["path"]), numbers)
    at = [common.quoted(host).cast("string"), common.quoted(path).cast("string")]
    same = at[0].eqNullSafe(common.quoted(names["host"])) & at[1].eqNullSafe(common.quoted(names["path"]))
    site = common.quoted(names["site"])
    if sites.count() <= BROADCAST_SITES:
        return rows.join(F.broadcast(keyed), same, "left").drop(names["host"], names["path"]), site
    share = sites.agg(F.sum("n")).first()[0] / max(1, common.shuffle_partitions(spark))
    large = keyed.where(site["n"] > share).withColumnRenamed(names["site"], names["hot"])
    small = keyed.where(site["n"] <= share).withColumn(names["salt"], F.lit(0))
    hot, salt = common.quoted(names["hot"]), common.quoted(names["salt"])
    done = rows.join(F.broadcast(large), same, "left").drop(names["host"], names["path"])
    spread = F.when(hot.isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("text"), F.lit(1 << 20))).cast("int")
    joined = done.join(small, same & (spread == salt), "left")
    return joined.select(*common.columns_of(rows), F.coalesce(hot, site).alias(names["site"])), site


def score_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` with own_logit, site_mean, quality and kept added; all rows stay.

    Null and empty texts are scored on zero features, long ones whole; null hosts and
    paths form sites of their own; rows with equal text, host and path get equal scores,
    and a score of exactly ``threshold`` is kept.  Without labels, or with labels of one
    class only, the own evidence is the base rate.  An empty table gives no rows.  An
    added column whose name ``docs`` has gets underscores after its name.

    The result is lazy and sends texts to Python when it is read, so the session's Arrow
    batches stay at 4 MB.
    """
    scored, names = _scored(docs, labels, host, path, threshold, fit_rows)
    return scored.select(*common.columns_of(docs), *[common.quoted(x) for x in names])


def _scored(docs: DataFrame, labels: DataFrame, host: str, path: str, threshold: float, fit_rows: int) -> tuple[DataFrame, list[str]]:
    """Scored rows and the names of own_logit, site_mean, quality and kept in them."""
    common.lower_batches(docs.sparkSession)
    names = [common.fresh(c, docs.columns) for c in ("own_logit", "site_mean", "quality", "kept")]
    own, mean, quality, kept = names
    model = fit_classifier(docs, labels, fit_rows)
    texts = docs.select(common.quoted(host).cast("string").alias("host"), common.quoted(path).cast("string").alias("path"), common.text_bytes().alias("text"))
    sites = site_posteriors(_probabilities(texts, model))
    joined, site = with_sites(docs.withColumn(own, _logit_column(model)), sites, host, path)
    p = 1 / (1 + F.exp(-common.quoted(own)))
    others = (F.greatest(F.lit(0.0), site["total"] - p) + site["prior_strength"] * site["prior_mean"]) / (site["n"] - 1 + site["prior_strength"])
    joined = joined.withColumn(mean, F.least(F.lit(1 - 1e-4), F.greatest(F.lit(1e-4), others)))
    # the classifier's own base rate is taken out of its odds before the site's comes in
    odds = common.quoted(own) - F.lit(model.base) + F.log(common.quoted(mean) / (1 - common.quoted(mean)))
    joined = joined.withColumn(quality, 1 / (1 + F.exp(-odds)))
    return joined.withColumn(kept, common.quoted(quality) >= threshold), names


def keep_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Rows of ``docs`` that the classifier keeps, with exactly their columns.

    Rows are judged as in ``score_quality``: null and empty texts too, repeated rows
    alike, ties kept; columns of ``docs`` may have any name.
    """
    scored, (*_, kept) = _scored(docs, labels, host, path, threshold, fit_rows)
    return scored.where(common.quoted(kept)).select(*common.columns_of(docs))
