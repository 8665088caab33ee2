"""Line dedup by site-relative frequency, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Up to so many boilerplate lines of all sites are sent to every executor (24 bytes each).
BROADCAST_LINES = 1_000_000


def _key(line: Column) -> Column:
    """96 bits of a line without the spaces around it."""
    return F.struct(F.xxhash64(F.trim(line)).alias("x"), F.hash(F.trim(line)).alias("m"))


def boilerplate_lines(docs: DataFrame, host: str = "source", max_ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """(site, line, pages, site_pages): lines on more than ``max_ratio`` of their site's pages.

    A page counts once for a line.  A line needs ``min_pages`` pages at least, so that
    small sites keep theirs.  Counts are summed before the shuffle: a hot site or line
    reaches it as one row per task.
    """
    site = common.quoted(host).cast("string").alias("site")
    filled = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.trim(x) != "")
    lines = docs.select(site, F.explode(F.array_distinct(F.transform(filled, _key))).alias("line"))
    pages = lines.groupBy("site", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    totals = docs.groupBy(site).agg(F.count("*").alias("site_pages"))
    totals = totals.withColumnRenamed("site", "site_of")
    return pages.join(totals, F.col("site").eqNullSafe(F.col("site_of"))).where(F.col("pages") > max_ratio * F.col("site_pages")).select("site", "line", "pages", "site_pages")


def drop_boilerplate(docs: DataFrame, host: str = "source", max_ratio: float = 0.1, min_pages: int = 5, counts: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; all rows and columns stay.

    A null text stays null, empty lines stay, a text whose lines all go becomes empty, long
    texts are cut whole, and pages without a host form one site.  Repeated rows are pages of
    their own, and a line on exactly ``max_ratio`` of the pages stays.  With ``counts``,
    n_lines and n_removed follow (with underscores after them where ``docs`` has such
    columns); other columns may have any name.  An empty table gives no rows.  A site
    has under (mean lines of a page) / ``max_ratio`` such lines; if those of all sites are
    few they are broadcast, else the join is shuffled by site and skewed sites are split.
    """
    found = common.materialize(boilerplate_lines(docs, host, max_ratio, min_pages).select("site", "line"), "boilerplate")
    site, drop = common.fresh("site", docs.columns), common.fresh("boilerplate", docs.columns)
    by_site = found.groupBy(F.col("site").alias(site)).agg(F.collect_list("line").alias(drop))
    if found.count() <= BROADCAST_LINES:
        by_site = F.broadcast(by_site)
    joined = docs.join(by_site, common.quoted(host).cast("string").eqNullSafe(by_site[site]), "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(drop), _key(x)))
    text = F.when(F.col(drop).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    out = [text.alias("text") if c == "text" else common.quoted(c) for c in docs.columns]
    if counts:
        n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
        left = F.when(F.col(drop).isNull() | F.col("text").isNull(), n).otherwise(F.size(kept).cast("long"))
        out += [n.alias(common.fresh("n_lines", docs.columns)), (n - left).alias(common.fresh("n_removed", docs.columns))]
    return joined.select(*out)
