"""Sliding windows of wallets that act together, safe for hot pools."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .baseline import KEY

MINUTE_US = 60_000_000
#: Rows and listed wallets that a task gives back at a time.
PART_WALLETS = 100_000


def _blocks(events: DataFrame, window_us: int, block_us: int) -> DataFrame:
    """Copies of rows in blocks of time; a row near its block's end is also halo of the next."""
    block = F.floor(F.col("us") / block_us)
    near_end = (block + 1) * block_us - F.col("us") <= window_us
    copies = F.when(near_end, F.array(block, block + 1)).otherwise(F.array(block))
    return events.withColumn("own_block", block).withColumn("block", F.explode(copies))


def distinct_active(us: np.ndarray, wallet: np.ndarray, window_us: int) -> np.ndarray:
    """For each row of sorted ``us`` how many wallets have a row in the window up to it.

    A wallet counts from a row that follows none of its own within the window until a
    window after one that none of its own follows, so two sorted lists of such ends give
    all counts.  Wallets are codes; negative ones do not count.
    """
    by_wallet = np.argsort(wallet, kind="stable")
    by_wallet = by_wallet[wallet[by_wallet] >= 0]
    own, at = wallet[by_wallet], us[by_wallet]
    apart = (own[1:] != own[:-1]) | (at[1:] - at[:-1] > window_us)
    begins, ends = at[np.append(True, apart)[: len(at)]], at[np.append(apart, True)[-len(at) :] if len(at) else []] + window_us
    return np.searchsorted(np.sort(begins), us, "right") - np.searchsorted(np.sort(ends), us, "left")


def _listed(lo: np.ndarray, hi: np.ndarray, names: pa.ChunkedArray, wanted: np.ndarray) -> Iterator[list[str] | None]:
    """The wallets from ``lo`` to ``hi`` of each row, sorted, or None if it is not wanted; both only grow."""
    wallets = names.to_pylist()
    inside: dict[str, int] = {}
    begin = end = 0
    for start, stop, want in zip(lo.tolist(), hi.tolist(), wanted.tolist(), strict=True):
        if not want:
            yield None
            continue
        for w in wallets[end:stop]:
            if w is not None:
                inside[w] = inside.get(w, 0) + 1
        for w in wallets[begin:start]:
            if w is not None:
                if inside[w] == 1:
                    del inside[w]
                else:
                    inside[w] -= 1
        begin, end = start, stop
        yield sorted(inside)


def _parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes sum to ``most`` at most, or of one row."""
    sums, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        before = sums[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sums, before + most, "right")))
        yield begin, end
        begin = end


def wallet_windows(scored: DataFrame, key: tuple[str, ...] = KEY, window_us: int = 30 * MINUTE_US, block_us: int = 360 * MINUTE_US, listed: int | None = None) -> DataFrame:
    """For each scorable event the scorable events of its key in the window before it.

    Adds wallets (sorted), n_wallets, window_usd, n_events, first_us, last_us and z_window.
    Rows of one instant see each other.  A key is cut into blocks of time with a halo of
    one window, so that no task grows with a pool's share of all events.  Counts and sums
    take time in proportion to the events, however many a window holds; wallets are listed
    only where they are at most ``listed`` (all if None), and null elsewhere.
    """
    if block_us < window_us:
        raise ValueError("a block must be as long as the window")
    rows = _blocks(scored.where("z is not null"), window_us, block_us)
    group = (*key, "block")
    schema = blocks.ddl(rows) + ", wallets array<string>, n_wallets int, window_usd double, n_events long, first_us long, last_us long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        for table, starts in blocks.whole_groups(batches, group):
            table = table.combine_chunks()
            every, usd = table["us"].to_numpy(), np.nan_to_num(table["usd"].to_numpy().astype(np.longdouble))
            codes = np.asarray(table["wallet"].combine_chunks().dictionary_encode().indices.fill_null(-1), np.int64)
            own = pc.equal(table["block"], table["own_block"]).to_numpy()
            found, lists = [], []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                us, before = every[a:b], np.concatenate([[0], np.cumsum(usd[a:b])])
                lo, hi = np.searchsorted(us, us - window_us), np.searchsorted(us, us, "right")
                n = distinct_active(us, codes[a:b], window_us)
                wanted = own[a:b] & (n <= (len(us) if listed is None else listed))
                found.append([np.where(wanted, n, 0), n, (before[hi] - before[lo]).astype(float), hi - lo, us[lo], us])
                lists.append(_listed(lo, hi, table["wallet"].slice(a, b - a), wanted))
            sizes, *columns = (np.concatenate(x) for x in zip(*found, strict=True))
            every_list = chain.from_iterable(lists)
            # the wallets of all rows are far more than the rows, so they leave in parts
            for i, j in _parts(sizes + 1, PART_WALLETS):
                at = np.flatnonzero(own[i:j])
                wallets = [x for x, mine in zip(islice(every_list, j - i), own[i:j].tolist(), strict=True) if mine]
                out = table.slice(i, j - i).take(pa.array(at)).append_column("wallets", pa.array(wallets, pa.list_(pa.string())))
                for name, x, t in zip(("n_wallets", "window_usd", "n_events", "first_us", "last_us"), columns, types, strict=True):
                    out = out.append_column(name, pa.array(x[i:j][at], t))
                yield from out.to_batches()

    seen = blocks.dealt(rows, group, ("us",)).mapInArrow(run, schema)
    z = (F.col("window_usd") - F.col("baseline_mean")) / F.col("baseline_std")
    return seen.drop("block", "own_block").withColumn("z_window", z)


def exact_wallet_windows(scored: DataFrame, key: tuple[str, ...] = KEY, order: tuple[str, ...] = ("us", "block_number", "log_index"), window_us: int = 30 * MINUTE_US, block_us: int = 360 * MINUTE_US, cap: int = 500) -> DataFrame:
    """As ``wallet_windows``, but by order of arrival within an instant and over the newest ``cap`` events.

    Two pointers run over each block of time in numpy.  Result: the key, the order
    columns, n_wallets, window_usd, n_events, first_us, wallets.
    """
    rows = _blocks(scored.where("z is not null").withColumn("us", F.col("us")), window_us, block_us)
    columns = [*key, *order]
    rows = rows.select(*columns, "wallet", "usd", "block", "own_block")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(list(order), kind="stable").reset_index(drop=True)
        us, usd, wallet = frame["us"].to_numpy(), frame["usd"].to_numpy(), frame["wallet"].to_numpy()
        start = np.maximum(np.searchsorted(us, us - window_us), np.arange(len(us)) - cap + 1)
        inside: dict[str, int] = {}
        lo, wallets = 0, []
        for hi, w in enumerate(wallet):
            inside[w] = inside.get(w, 0) + 1
            while lo < start[hi]:
                inside[wallet[lo]] -= 1
                if not inside[wallet[lo]]:
                    del inside[wallet[lo]]
                lo += 1
            wallets.append(sorted(inside))
        out = frame[columns].copy()
        out["wallets"] = wallets
        out["n_wallets"] = [len(w) for w in wallets]
        out["window_usd"] = [usd[a : b + 1].sum() for b, a in enumerate(start)]
        out["n_events"] = np.arange(len(us)) - start + 1
        out["first_us"] = us[start] if len(us) else us
        return out[frame["block"] == frame["own_block"]]

    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in columns), "wallets array<string>", "n_wallets long", "window_usd double", "n_events long", "first_us long"])
    return rows.groupBy(*key, "block").applyInPandas(run, schema)


def coordinated(windows: DataFrame, min_usd: float | Column = 100_000.0, limit: Column | float = 2.5, min_wallets: int = 2, max_wallets: int = 15, excluded: tuple[str, ...] = ("transfer",)) -> DataFrame:
    """Windows that pass every gate that needs no memory of earlier alerts."""
    rows = windows.where(~F.col("type").isin(*excluded)) if excluded else windows
    return rows.where(F.col("n_wallets").between(min_wallets, max_wallets) & (F.col("window_usd") >= min_usd) & (F.col("z_window") >= limit))


def cluster_summary(events: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """One row for each group of clustered events."""
    return events.groupBy(*group).agg(
        F.sort_array(F.collect_set("wallet")).alias("wallets"),
        F.sum("usd").alias("total_volume_usd"),
        F.max("z").alias("z_score"),
        F.count("*").alias("event_count"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
    )
