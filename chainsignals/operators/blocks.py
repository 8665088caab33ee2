"""Rules along time, split into blocks of time so that no key is one task.

A block is a key's rows within a fixed stretch of time.  What one block hands to the next
is a number, and how it depends on the number that it was given is worked out for all
blocks at once; only these small tables are then walked along a key, and every block is
worked off from the number that it gets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import scratch_path


def changes(rows: pa.Table | pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    """Whether each row but the first differs from the one before in one of ``names``; nulls are equal."""
    n = rows.num_rows
    differ = np.zeros(max(n - 1, 0), bool)
    for name in names:
        a, b = rows[name].slice(1), rows[name].slice(0, n - 1)
        other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        differ |= np.asarray(other.to_numpy(zero_copy_only=False) if isinstance(other, pa.Array) else other.to_numpy(), bool)
    return differ


def whole_groups(batches: Iterator[pa.RecordBatch], group: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted input as tables of whole groups, with the places where groups begin and the end."""
    pending: list[pa.RecordBatch] = []

    def table() -> tuple[pa.Table, np.ndarray]:
        rows = pa.Table.from_batches(pending)
        return rows, np.concatenate([[0], np.flatnonzero(changes(rows, group)) + 1, [rows.num_rows]])

    for batch in batches:
        if not batch.num_rows:
            continue
        starts = np.flatnonzero(changes(batch, group)) + 1
        if pending:
            meet = pa.Table.from_batches([pending[-1].slice(pending[-1].num_rows - 1), batch.slice(0, 1)])
            if changes(meet, group)[0]:
                starts = np.concatenate([[0], starts])
        if len(starts):
            cut = int(starts[-1])
            if cut:
                pending.append(batch.slice(0, cut))
            yield table()
            pending = [batch.slice(cut)]
        else:
            pending.append(batch)
    if pending:
        yield table()


def same(left: tuple[str, ...], right: str = "_r_") -> Column:
    """Null-safe equality of columns with those of the same names after a prefix."""
    found = F.lit(True)
    for name in left:
        found = found & F.col(name).eqNullSafe(F.col(right + name))
    return found


def prefixed(rows: DataFrame, names: tuple[str, ...], prefix: str = "_r_") -> DataFrame:
    return rows.withColumnsRenamed({n: prefix + n for n in names})


def dealt(rows: DataFrame, group: tuple[str, ...], order: tuple[str, ...] = ()) -> DataFrame:
    """Whole groups in one partition each, sorted by group and order."""
    return rows.repartition(*[F.col(c) for c in group]).sortWithinPartitions(*group, *order)


def ddl(rows: DataFrame, *names: str) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if not names or c in names)


# Cooldowns: a block gets the time from which its key may emit again.


def _orbit(us: np.ndarray, at: np.ndarray, cooldown_us: int) -> np.ndarray:
    """The last row emitted in a block if the first is ``at``, for each of several."""
    n = len(us)
    while True:
        to = np.searchsorted(us, us[at] + cooldown_us)
        inside = to < n
        if not inside.any():
            return at
        at = np.where(inside, to, at)


def exits(us: np.ndarray, start: int, cooldown_us: int) -> tuple[np.ndarray, np.ndarray]:
    """(until, free): a block whose first emitted row is at ``until`` or before frees its key at ``free``.

    Only rows up to the first one a cooldown after the block's start can come first;
    walks from them soon meet, so few different ends are left.
    """
    first = np.arange(min(len(us), int(np.searchsorted(us, start + cooldown_us)) + 1))
    free = us[_orbit(us, first, cooldown_us)] + cooldown_us
    last = np.flatnonzero(np.append(free[1:] != free[:-1], True))
    return us[last], free[last]


def emitted(us: np.ndarray, allowed: int | None, cooldown_us: int) -> list[int]:
    """Rows that a block emits if its key may from ``allowed`` on."""
    at, found = 0 if allowed is None else int(np.searchsorted(us, allowed)), []
    while at < len(us):
        found.append(at)
        at = int(np.searchsorted(us, us[at] + cooldown_us))
    return found


def cooldown(rows: DataFrame, key: tuple[str, ...], cooldown_us: int, order: tuple[str, ...] = ("us",), block_us: int | None = None) -> DataFrame:
    """Rows of which none is within ``cooldown_us`` after the last emitted one of its key.

    Blocks are 16 cooldowns long unless given.  A key's blocks are dealt over all tasks;
    only a few numbers for each of its blocks are walked by one.
    """
    if cooldown_us <= 0:
        return rows
    length = block_us or 16 * cooldown_us
    if length < cooldown_us:
        raise ValueError("a block must be as long as the cooldown")
    blocked = rows.withColumn("_block", F.floor(F.col("us") / length))
    group, names = (*key, "_block"), rows.columns

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, group):
            us, block = table["us"].to_numpy(), table["_block"].to_numpy()
            found = [exits(us[a:b], int(block[a]) * length, cooldown_us) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            out = table.select(list(group)).take(pa.array(starts[:-1]))
            for name, k in (("until", 0), ("free", 1)):
                out = out.append_column(name, pa.array([x[k].tolist() for x in found], pa.list_(pa.int64())))
            yield from out.to_batches()

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, key):
            allowed: list[int | None] = []
            begins = set(starts.tolist())
            free = None
            for i, (until, frees) in enumerate(zip(table["until"].to_pylist(), table["free"].to_pylist(), strict=True)):
                free = None if i in begins else free
                allowed.append(free)
                at = 0 if free is None else int(np.searchsorted(until, free))
                free = frees[at] if at < len(frees) else free
            yield from table.select(list(group)).append_column("allowed", pa.array(allowed, pa.int64())).to_batches()

    slim = blocked.select(*group, "us")
    schema = ddl(slim, *group)
    maps = dealt(slim, group, ("us",)).mapInArrow(ends, f"{schema}, until array<long>, free array<long>")
    given = dealt(maps, key, ("_block",)).mapInArrow(carried, f"{schema}, allowed long")
    joined = blocked.join(prefixed(given, group), same(group)).drop(*[f"_r_{c}" for c in group])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, group):
            us, allowed = table["us"].to_numpy(), table["allowed"].to_pylist()
            keep = [a + i for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True) for i in emitted(us[a:b], allowed[a], cooldown_us)]
            yield from table.select(names).take(pa.array(keep, pa.int64())).to_batches()

    return dealt(joined, group, order).mapInArrow(emit, ddl(rows))


# Budgets: a block gets what its key has spent before.

#: Shares of the budget at which amounts are summed, to bound what a key can have left.
_STEPS = 30
#: Length of a block.
BLOCK_US = 900_000_000
#: A table of up to so many blocks is broadcast to the rows.
_SMALL = 200_000


def _spend(amounts: np.ndarray, counts: np.ndarray, spent: float, budget: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(allowed, spent before) of requests in order, and what is spent at the end; between two spends all are judged at once."""
    n = len(amounts)
    allowed, before, i = np.zeros(n, bool), np.zeros(n), 0
    while i < n:
        fits = spent + amounts[i:] <= budget
        spends = fits & counts[i:]
        j = int(spends.argmax())
        end = i + j + 1 if spends[j] else n
        allowed[i:end], before[i:end] = fits[: end - i], spent
        if spends[j]:
            spent += float(amounts[end - 1])
        i = end
    return allowed, before, spent


def _segments(batches: Iterator[pa.RecordBatch], group: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, bool]]]]:
    """Batches of sorted input with their runs of one group: begin, end, and whether the group begins there."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        first = last is None or bool(changes(pa.Table.from_batches([last, batch.slice(0, 1)]), group)[0])
        last = batch.slice(batch.num_rows - 1)
        starts = [0, *(np.flatnonzero(changes(batch, group)) + 1).tolist()]
        yield batch, [(a, b, a > 0 or first) for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True)]


def asking(amount: str, spends: str, budget: float) -> Column:
    """Whether a request can spend at all."""
    return F.coalesce(F.col(spends) & (F.col(amount) <= budget), F.lit(False))


def of_blocks(rows: DataFrame, table: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """Rows with what ``table`` has of their block."""
    small = table.limit(_SMALL + 1).count() <= _SMALL
    of = prefixed(table, group)
    return rows.join(F.broadcast(of) if small else of, same(group)).drop(*[f"_r_{c}" for c in group])


def within_budget(rows: DataFrame, amount: str, spends: str, budget: float, key: tuple[str, ...], order: tuple[str, ...] = ("us",), block_us: int = BLOCK_US, steps: tuple[float, ...] = (), joined: Callable[[DataFrame], DataFrame] | None = None, summed: Callable[[Column], DataFrame] | None = None) -> DataFrame:
    """``rows`` with allowed and spent_before, as ``greedy.within_budget`` says.

    For every m, a key that was asked for T in amounts up to m has spent all of T, or has
    refused one of them and so has less than m left.  That bounds, for each block and
    before any walk, what can be left; amounts above it are refused for certain.  ``steps``
    are further m, best the least amounts that occur.  Only the other requests are walked
    in order, to find what was spent before each block.  In a block without a spend that
    number judges every row where it is; only rows of blocks that spend are sorted and
    walked again.  The table of blocks is stored; rows are read four times.  Ties in
    ``order`` are broken by the rows' hashes.

    Two functions can do without rows what is done to all of them: ``joined`` makes the rows
    of a table's blocks, with _block and what the table has of it; ``summed`` adds up
    amounts by key, _block and the given level, as sum and least.  Rows are then made for
    blocks that may spend, and once for the result.
    """
    if budget < 0:
        return rows.withColumn("allowed", F.lit(False)).withColumn("spent_before", F.lit(0.0))
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "budget")

    def stored(table: DataFrame, name: str) -> DataFrame:
        table.write.parquet(f"{path}/{name}")
        return spark.read.schema(table.schema).parquet(f"{path}/{name}")

    blocked = rows.withColumn("_block", F.floor(F.col("us") / block_us))
    group, sorting = (*key, "_block"), (*order, "_tie")
    asks, value = asking(amount, spends, budget), F.col(amount).cast("double")
    levels = sorted({budget / 2.0**j for j in range(_STEPS)} | {float(m) for m in steps if m <= budget})
    # the least level that an amount is within; most amounts are large, so from above
    level = F.when(~asks, None)
    for i, below in reversed(list(enumerate(levels[:-1], 1))):
        level = level.when(value > below, i)
    level = level.otherwise(0).alias("_level")
    by_level = summed(level) if summed else blocked.groupBy(*group, level).agg(F.sum(value).alias("sum"), F.min(F.when(asks, value)).alias("least"))
    asked_of = F.when(F.col("_level").isNotNull(), F.struct("_level", "sum"))
    sums = stored(by_level.groupBy(*group).agg(F.collect_list(asked_of).alias("sums"), F.min("least").alias("least")), "sums")
    types = ddl(sums, *group)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.array(levels)
        total, negative = np.zeros(len(levels)), False
        for batch, runs in _segments(batches, key):
            left = []
            begins = {a for a, _, first in runs if first}
            for i, (own, least) in enumerate(zip(batch["sums"].to_pylist(), batch["least"].to_pylist(), strict=True)):
                if i in begins:
                    total, negative = np.zeros(len(levels)), False
                negative |= least is not None and least < 0
                # what is left before the block, with room for rounding; negative amounts give money back
                some = np.maximum(budget - total, steps) * (1 + 1e-9) + 1e-9 * budget
                # more than can be spent was asked for, so one of these was refused and all as large are
                some = np.where(total > budget * (1 + 1e-9), np.nextafter(steps, -np.inf), some)
                most = float("inf") if negative else float(some.min())
                left.append(most if least is not None and least <= most else None)
                more = np.zeros(len(levels))
                for x in own:
                    more[x["_level"]] += x["sum"]
                total = total + np.cumsum(more)
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in group], pa.array(left, pa.float64())], [*group, "left"])

    joined = joined or (lambda table: of_blocks(blocked, table, group))
    tie = F.xxhash64(*rows.columns).alias("_tie")
    bound = stored(dealt(sums, key, ("_block",)).mapInArrow(bounds, f"{types}, left double"), "bound")
    able = joined(bound.where("left is not null")).where(asks & (value <= F.col("left"))).select(*dict.fromkeys((*group, *order)), tie, value.alias("_amount"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is spent after each request that spends."""
        spent = 0.0
        for batch, runs in _segments(batches, key):
            amounts, keep, after = batch["_amount"].to_numpy(), [], []
            for a, b, first in runs:
                allowed, before, spent = _spend(amounts[a:b], np.ones(b - a, bool), 0.0 if first else spent, budget)
                at = np.flatnonzero(allowed)
                keep.append(at + a)
                after.append(before[at] + amounts[a:b][at])
            taken = batch.take(pa.array(np.concatenate(keep)))
            yield pa.RecordBatch.from_arrays([*[taken[c] for c in group], pa.array(np.concatenate(keep), pa.int64()), pa.array(np.concatenate(after), pa.float64())], [*group, "_nth", "spent"])

    # amounts may be negative, so the newest sum of a block is found by its place among the walked
    walked = dealt(able, key, sorting).mapInArrow(_numbered(walk), f"{types}, _nth long, spent double")
    after = walked.groupBy(*group).agg(F.max_by("spent", "_nth").alias("spent"))
    every = sums.select(*group).withColumn("spent", F.lit(None).cast("double")).withColumn("_is", F.lit(0))
    marks = after.select(*group, "spent").withColumn("_is", F.lit(1)).unionByName(every)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What was spent before each block, the newest sum of an earlier one, and whether the block itself spends."""
        for table, starts in whole_groups(batches, key):
            begins, keep, before, moves, spent = set(starts.tolist()), [], [], [], 0.0
            kinds = table["_is"].to_pylist()
            for i, (kind, value) in enumerate(zip(kinds, table["spent"].to_pylist(), strict=True)):
                spent = 0.0 if i in begins else spent
                if kind:
                    spent = value
                else:
                    keep.append(i)
                    before.append(spent)
                    moves.append(i + 1 < len(kinds) and i + 1 not in begins and kinds[i + 1] == 1)
            found = table.select(list(group)).take(pa.array(keep, pa.int64()))
            yield from found.append_column("_spent", pa.array(before, pa.float64())).append_column("_moves", pa.array(moves, pa.bool_())).to_batches()

    given = stored(dealt(marks, key, ("_block", "_is")).mapInArrow(carry, f"{types}, _spent double, _moves boolean"), "given")
    fits = F.coalesce(F.col("_spent") + value <= budget, F.lit(False))
    still = joined(given.where("not _moves")).select(*rows.columns, fits.alias("allowed"), F.col("_spent").alias("spent_before"))
    names = still.columns

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent = 0.0
        for batch, runs in _segments(batches, group):
            amounts = batch["_value"].fill_null(float("nan")).to_numpy(zero_copy_only=False)
            counts = batch[spends].fill_null(False).to_numpy(zero_copy_only=False)
            found = []
            for a, b, first in runs:
                *parts, spent = _spend(amounts[a:b], counts[a:b], batch["_spent"][a].as_py() if first else spent, budget)
                found.append(parts)
            allowed, before = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names[:-2]], pa.array(allowed), pa.array(before)], names)

    moving = joined(given.where("_moves")).select("*", value.alias("_value"), tie)
    return still.unionByName(dealt(moving, group, sorting).mapInArrow(decide, ddl(still)))


def _numbered(walk):
    """``walk`` with _nth counted over the whole partition instead of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in walk(batches):
            names = batch.schema.names
            nth = pa.array(np.arange(n, n + batch.num_rows))
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([nth if c == "_nth" else batch[c] for c in names], names)

    return run
