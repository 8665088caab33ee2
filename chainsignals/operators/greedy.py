"""Operators whose answer depends on what was emitted before: cooldowns, dedup, budgets.

Plain cooldowns and budgets are worked off in blocks of time (``blocks``), so that a key
with most of the rows is dealt over all tasks.  Rules with a memory of more than a number
are walked in order, partition by partition, in Arrow batches with a small state between
them: no group becomes a frame of its own and none is held whole.  A gap as long as
the cooldown makes the next row independent of all before, so their keys are cut into
chunks at gaps and the chunks dealt over the tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import scratch_path
from . import blocks


def chunked(rows: DataFrame, key: tuple[str, ...], gap_us: int, order: tuple[str, ...] = ("us",)) -> DataFrame:
    """``rows`` with the number of their independent chunk within the key, and starts_chunk, 1 for its first row."""
    w = Window.partitionBy(*key).orderBy(*order)
    starts = (F.col("us") - F.lag("us").over(w) > gap_us).cast("int")
    return rows.withColumn("starts_chunk", F.coalesce(starts, F.lit(1))).withColumn("chunk", F.sum("starts_chunk").over(w))


def _walked(rows: DataFrame, group: tuple[str, ...], order: tuple[str, ...], walk: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``walk`` over partitions that hold whole groups, sorted by group and order."""
    dealt = rows.repartition(*[F.col(c) for c in group]).sortWithinPartitions(*group, *order)
    return dealt.mapInArrow(walk, schema)


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)


def emit_with_cooldown(rows: DataFrame, key: tuple[str, ...], cooldown_us: int, order: tuple[str, ...] = ("us",), signature: str | None = None, memory_us: int | None = None) -> DataFrame:
    """Rows that are emitted: none within ``cooldown_us`` after the last emitted of its key.

    A row exactly the cooldown later is emitted, unless ``signature`` (a column, arrays
    too) was emitted within ``memory_us`` (inclusive) before.
    """
    if signature is None:
        return blocks.cooldown(rows, key, cooldown_us, order)
    memory = cooldown_us if memory_us is None else memory_us
    dealt = chunked(rows, key, max(cooldown_us, memory), order).withColumn("_mark", F.to_json(F.struct(signature)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, {}
        for batch in batches:
            starts, us = batch["starts_chunk"].to_numpy(), batch["us"].to_numpy()
            marks = batch["_mark"].to_pylist()
            keep = np.zeros(len(us), bool)
            for i, (first, t) in enumerate(zip(starts.tolist(), us.tolist(), strict=True)):
                if first:
                    last, seen = None, {}
                if last is not None and t - last < cooldown_us:
                    continue
                if marks[i] in seen and seen[marks[i]] >= t - memory:
                    continue
                seen = {m: at for m, at in seen.items() if at >= t - memory}
                seen[marks[i]] = t
                last, keep[i] = t, True
            yield batch.filter(pa.array(keep))

    return _walked(dealt, (*key, "chunk"), order, walk, _ddl(dealt)).drop("starts_chunk", "chunk", "_mark")


def first_claims(rows: DataFrame, key: tuple[str, ...], hold_us: int, order: tuple[str, ...] = ("us",)) -> DataFrame:
    """Rows whose fingerprint is not claimed: a claim holds for ``hold_us`` from the first row."""
    return emit_with_cooldown(rows, key, hold_us, order)


def within_budget(rows: DataFrame, amount: str, spends: str, budget: float, key: tuple[str, ...] = ("day",), order: tuple[str, ...] = ("us",), steps: tuple[float, ...] = ()) -> DataFrame:
    """``rows`` with allowed: spent so far plus ``amount`` stays within ``budget``.

    Only allowed rows for which ``spends`` is true add to what the key has spent.  A row
    without an amount is refused.  ``steps``, best the least amounts that occur, make it
    faster and change nothing.
    """
    return blocks.within_budget(rows, amount, spends, budget, key, order, steps=steps)


def _clusters(us: list, wallets: list, usd: list, z: list, before: list, window_us: int, min_wallets: int) -> Iterator[tuple]:
    """Clusters of a chunk's events in order: wallets, volume, greatest z, events, first and last time.

    The window of each anchor is judged as it ends; every event is looked at once as it
    enters the window and once as it leaves.
    """
    new: Counter = Counter()  # wallets of the window that are in no cluster yet
    known: set = set()
    end = 0
    for first in range(len(us)):
        while end < len(us) and us[end] <= us[first] + window_us:
            if not before[end] and wallets[end] not in known:
                new[wallets[end]] += 1
            end += 1
        if len(new) >= min_wallets:
            yield sorted(new), float(sum(usd[first:end])), max(z[first:end]), end - first, us[first], us[end - 1]
            known.update(new)
            new.clear()
        if wallets[first] in new:
            new[wallets[first]] -= 1
            if not new[wallets[first]]:
                del new[wallets[first]]


def anchor_clusters(events: DataFrame, key: tuple[str, ...] = ("chain", "pool", "type"), window_us: int = 1_800_000_000, min_wallets: int = 2, whale_z: float = 4.0, order: tuple[str, ...] = ("us", "event_id")) -> DataFrame:
    """Batch clusters: anchored windows of new wallets, then lone whales.

    Within a key, events are walked by time.  The window of an anchor that holds at least
    ``min_wallets`` wallets not clustered before gives a cluster of these wallets, with
    the volume of all the window's events.  Events of ``whale_z`` and more whose wallet is in no cluster of
    several wallets give a cluster each; keys count in the order of their first event.

    The input must be the flagged events only.  Windows end at gaps longer than
    ``window_us``, so a key is cut into chunks there, which are walked in parallel and
    depend on each other through the wallets clustered before alone.  Each round walks
    all chunks with what the round before found of that; a chunk is right once all before
    it are, so what no longer changes is the result of a walk in order.  A walk holds the
    events of a window and the wallets that its chunk has clustered.
    """
    spark, path = events.sparkSession, scratch_path(events.sparkSession, "clusters")

    def stored(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{path}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{path}/{name}")

    types = dict(events.dtypes)
    group = (*key, "chunk")
    columns = [*key, *dict.fromkeys((*order, "us", "wallet", "usd", "z"))]
    rows = stored(chunked(events.select(*columns), key, window_us, order).drop("starts_chunk"), "events")
    names = [*group, "wallets", "total_volume_usd", "z_score", "event_count", "first_us", "last_us"]
    schema = ", ".join([*(f"{k} {types[k]}" for k in key), "chunk long, wallets array<string>, total_volume_usd double, z_score double, event_count long, first_us long, last_us long"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in blocks.whole_groups(batches, group):
            values = [table[c].to_pylist() for c in ("us", "wallet", "usd", "z", "before")]
            at, found = [], []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                for cluster in _clusters(*[v[a:b] for v in values], window_us, min_wallets):
                    at.append(a)
                    found.append(cluster)
            out = table.select(list(group)).take(pa.array(at, pa.int64()))
            kinds = (pa.list_(pa.string()), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            for name, x, t in zip(names[len(group) :], list(zip(*found, strict=True)) or [[]] * 6, kinds, strict=True):
                out = out.append_column(name, pa.array(x, t))
            yield from out.to_batches()

    firsts, before, number = None, None, 0
    while True:
        known = rows.withColumn("before", F.lit(False))
        if firsts is not None:
            same = blocks.same((*key, "wallet"))
            known = rows.join(blocks.prefixed(firsts, (*key, "wallet")), same, "left").withColumn("before", F.coalesce(F.col("first_chunk") < F.col("chunk"), F.lit(False))).select(*rows.columns, "before")
        multi = stored(blocks.dealt(known, group, order).mapInArrow(walk, schema), f"round{number}")
        firsts = multi.select(*key, "chunk", F.explode("wallets").alias("wallet")).groupBy(*key, "wallet").agg(F.min("chunk").alias("first_chunk"))
        now = tuple(firsts.agg(F.count("*"), F.sum(F.xxhash64(*key, "wallet", "first_chunk").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before, number = now, number + 1
    multi = multi.drop("chunk")
    firsts = events.groupBy(*key).agg(F.min("us").alias("key_first"))
    placed = multi.join(firsts, list(key)).select(F.explode("wallets").alias("wallet"), "key_first").groupBy("wallet").agg(F.min("key_first").alias("clustered_from"))
    whales = events.where(F.col("z") >= whale_z).join(firsts, list(key)).join(placed, "wallet", "left").where("clustered_from is null or clustered_from > key_first")
    alone = whales.select(*key, F.array("wallet").alias("wallets"), F.col("usd").alias("total_volume_usd"), F.col("z").alias("z_score"), F.lit(1).cast("long").alias("event_count"), F.col("us").alias("first_us"), F.col("us").alias("last_us"))
    return multi.unionByName(alone)
