"""Structured Streaming jobs: hourly volume, dedup, cooldown state, held delivery, fan-out.

State ends: what a key can no longer need is removed by an event-time timer once the
watermark has passed it, so idle keys leave the state store and results stay those of
the batch jobs.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import baseline
from ..operators.baseline import KEY
from .window_sum import WindowSum

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """State on local disk with changelogs in the checkpoint, as ``transformWithState`` needs, for queries started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def hourly_volume(events: DataFrame, key: tuple[str, ...] = KEY, late: str = "2 hours") -> DataFrame:
    """USD by key and hour of event time; rows later than ``late`` are dropped, not reopened."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), *key).agg(F.sum("usd").alias("volume")).select(*key, F.col("window.start").alias("hour"), "volume")


def deduplicate(events: DataFrame, key: tuple[str, ...] = ("chain", "tx", "log_index"), within: str = "2 hours") -> DataFrame:
    """Each identity once; remembered for as long as the watermark waits."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(list(key))


class Expiring(StatefulProcessor):
    """A processor that keeps at most one timer for a key, moved on as the key goes on."""

    timers = False

    def move_timer(self, us: int, new: bool = False) -> None:
        """Let the key's timer fire once event time has passed ``us``; a ``new`` key has no timer to remove, which saves asking for one."""
        if self.timers:
            for at in [] if new else list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(us // 1000 + 1)

    def close(self) -> None:
        pass


class Cooldown(Expiring):
    """Emits a row of a key unless one was emitted within the cooldown before it.

    State is the time of the last emission, one number for each key; with ``timers`` it is
    removed when the cooldown is over by event time, as it has no effect from then on.
    """

    def __init__(self, cooldown_us: int, columns: list[str], timers: bool):
        self.cooldown_us, self.columns, self.timers = cooldown_us, columns, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.last.get()
        last = None if known is None else known[0]
        parts = list(rows)
        frame = parts[0] if len(parts) == 1 else pd.concat(parts)
        frame = frame if len(frame) == 1 else frame.sort_values("us", kind="stable")
        us = frame["us"].to_numpy()
        keep, at = [], 0 if last is None else int(np.searchsorted(us, last + self.cooldown_us))
        # from one emission to the first row that is a cooldown later
        while at < len(us):
            keep.append(at)
            last = int(us[at])
            at = max(at + 1, int(np.searchsorted(us, last + self.cooldown_us)))
        if keep:
            self.last.update((last,))
            self.move_timer(last + self.cooldown_us, new=known is None)
            yield frame.iloc[keep][self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])


class RollingBaseline(Expiring):
    """z-scores against the completed hours of a key, from at most ``hours`` sums in state.

    Rows of an hour earlier than the open one are marked late: they are scored against what
    is complete and their volume is left out, so an hour is never reopened.  The state is
    one value, read and written once for a key and batch; rows are scored hour by hour.
    """

    STATE = "first long, hour long, volume double, hours array<long>, volumes array<double>"

    def __init__(self, hours: int = 336, min_hours: int = 24):
        self.hours, self.min_hours = hours, min_hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.baseline = handle.getValueState("baseline", self.STATE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Begin with what ``baseline.open_state`` has of a history."""
        for first, hour, volume, hours, volumes in initialState[["first", "hour", "volume", "hours", "volumes"]].itertuples(index=False):
            self.baseline.update((int(first), int(hour), float(volume), [int(h) for h in hours], [float(v) for v in volumes]))

    def scored(self, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        """The batch's rows of the key by time, with mean, std and late; moves the state on."""
        frame = pd.concat(list(rows)).sort_values("us", kind="stable")
        first, hour, volume, hours, volumes = self.baseline.get() if self.baseline.exists() else (None, None, 0.0, [], [])
        done = dict(zip(hours, volumes, strict=True))
        of = frame["us"].to_numpy() // 3_600_000_000
        usd = frame["usd"].to_numpy(float)
        mean, std, late = np.zeros(len(of)), np.full(len(of), np.nan), np.zeros(len(of), bool)
        starts = np.flatnonzero(np.diff(of, prepend=of[0] - 1))
        stats = None
        for a, b in zip(starts, [*starts[1:], len(of)], strict=True):
            now = int(of[a])
            if hour is None:
                first = hour = now
            if now > hour:
                done[hour] = volume
                done = {h: v for h, v in done.items() if h >= now - self.hours}
                hour, volume, stats = now, 0.0, None
            if stats is None:
                stats = self._stats(done, first, hour)
            if now == hour:
                volume += float(usd[a:b].sum())
            mean[a:b], std[a:b], late[a:b] = *stats, now < hour
        self.baseline.update((int(first), int(hour), float(volume), [int(h) for h in done], [float(v) for v in done.values()]))
        return frame.assign(mean=mean, std=std, late=late)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = self.scored(rows)
        z = (frame["usd"] - frame["mean"]) / frame["std"]
        yield pd.DataFrame({"event_id": frame["event_id"], "z": z, "late": frame["late"]})

    def _stats(self, done: dict[int, float], first: int, hour: int) -> tuple[float, float]:
        n = min(self.hours, hour - first)
        if n < self.min_hours:
            return 0.0, np.nan
        values = np.array([v for h, v in done.items() if h >= hour - self.hours])
        mean = values.sum() / n
        var = (((values - mean) ** 2).sum() + (n - len(values)) * mean * mean) / n
        level = len(values) == n and (values == values[0]).all()
        return mean, np.nan if level or var <= 0 else var**0.5


class WalletWindows(RollingBaseline):
    """Alerts of wallets that act together, from the baseline and the last window of a key's events in state.

    An event that can be scored is alerted when its window holds 2 to ``max_wallets``
    wallets and ``min_usd``, and this sum's z-score reaches ``limit``, unless the key
    alerted within the cooldown or the same wallets did within the window.  State holds at
    most ``cap`` events and the wallet sets of one window; with ``timers`` both are removed
    once the window of the key's last event is over, and the baseline alone stays.
    """

    def __init__(self, window_us: int, min_usd: float, max_wallets: int, cap: int, limit: float, timers: bool = False):
        super().__init__()
        self.timers = timers
        self.window_us, self.min_usd, self.max_wallets, self.cap, self.limit = window_us, min_usd, max_wallets, cap, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.recent = handle.getListState("recent", "us long, wallet string, usd double")
        self.alerts = handle.getListState("alerts", "us long, wallets string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = self.scored(rows)
        frame = frame[frame["std"].notna()]
        window = deque(tuple(r) for r in self.recent.get()) if self.recent.exists() else deque()
        alerts = [tuple(r) for r in self.alerts.get()] if self.alerts.exists() else []
        inside, volume = Counter(x[1] for x in window), WindowSum(x[2] for x in window)
        out = []
        for event_id, us, wallet, usd, mean, std in zip(*(frame[c].tolist() for c in ("event_id", "us", "wallet", "usd", "mean", "std")), strict=True):
            window.append((us, wallet, usd))
            volume.append(usd)
            inside[wallet] += 1
            while window[0][0] < us - self.window_us or len(window) > self.cap:
                gone = window.popleft()[1]
                volume.popleft()
                inside[gone] -= 1
                if not inside[gone]:
                    del inside[gone]
            if not 2 <= len(inside) <= self.max_wallets:
                continue
            total = volume.total
            if total < self.min_usd or (total - mean) / std < self.limit or (alerts and us - alerts[-1][0] < self.window_us):
                continue
            signature = ",".join(sorted(inside))
            alerts = [x for x in alerts if x[0] >= us - self.window_us]
            if signature not in (x[1] for x in alerts):
                alerts.append((us, signature))
                out.append((event_id, len(inside), total))
        if len(frame):
            self.recent.put(list(window))
            self.move_timer(window[-1][0] + self.window_us)
        if alerts:
            self.alerts.put(alerts)
        if out:
            yield pd.DataFrame(out, columns=["event_id", "n_wallets", "window_usd"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        self.alerts.clear()
        return iter([])


class Held(Expiring):
    """Rows that wait in state until their time; a processing-time timer releases them."""

    def __init__(self, due: str, types: dict[str, str]):
        self.due, self.types, self.timers = due, types, True

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("held", ", ".join(f"`{c}` {t}" for c, t in self.types.items()))

    def _release(self, held: pd.DataFrame, now_us: int) -> pd.DataFrame:
        """The rows that are due; the others are kept, and the timer set to the first of them."""
        late = held[self.due] > now_us
        if late.any():
            self.rows.put(list(held[late].itertuples(index=False, name=None)))
            self.move_timer(int(held.loc[late, self.due].min()))
        else:
            self.rows.clear()
        return held[~late].assign(released_us=now_us)

    def _held(self) -> pd.DataFrame:
        rows = list(self.rows.get()) if self.rows.exists() else []
        return pd.DataFrame([tuple(r) for r in rows], columns=list(self.types))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))[list(self.types)]
        held = self._held()
        yield self._release(pd.concat([held, new]) if len(held) else new, timerValues.getCurrentProcessingTimeInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._release(self._held(), timerValues.getCurrentProcessingTimeInMs() * 1000)


def _stateful(rows: DataFrame, key: tuple[str, ...], processor: StatefulProcessor, schema: str, late: str | None, seed: DataFrame | None = None) -> DataFrame:
    """``processor`` by key; with ``late``, a bound of lateness on the column ts, its timers run by event time."""
    rows = rows.withWatermark("ts", late) if late else rows
    start = {"initialState": seed.groupBy(*key)} if seed is not None else {}
    return rows.groupBy(*key).transformWithStateInPandas(processor, schema, "Append", "EventTime" if late else "None", **start)


def wallet_alerts(
    rows: DataFrame,
    key: tuple[str, ...] = KEY,
    window_us: int = 1_800_000_000,
    min_usd: float = 100_000.0,
    max_wallets: int = 15,
    cap: int = 500,
    limit: float = 2.5,
    excluded: tuple[str, ...] = ("transfer",),
    late: str | None = None,
    seed: DataFrame | None = None,
) -> DataFrame:
    """Streaming multi-wallet alerts with all gates of the batch job; ``rows`` has the key, event_id, us, wallet and usd.

    With ``late``, rows have the event time ts too, and windows of idle keys leave the state.
    """
    processor = WalletWindows(window_us, min_usd, max_wallets, cap, limit, late is not None)
    rows = rows.where(~F.col("type").isin(*excluded)) if excluded else rows
    return _stateful(rows, key, processor, "event_id long, n_wallets long, window_usd double", late, seed)


def delayed(rows: DataFrame, key: tuple[str, ...], due: str = "deliver_us") -> DataFrame:
    """``rows`` once their time ``due`` (microseconds) has come by the clock, with released_us.

    Rows wait in the state of their key, over restarts too.  The stream runs on by a
    processing-time trigger: it never counts as finished, as the clock goes on.  A clock
    without rows is merged in, as a stream that was started again would else run no
    batch, and so release nothing, before new rows come.
    """
    types = dict(rows.dtypes)
    clock = rows.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load().where(F.lit(False))
    rows = rows.unionByName(clock.select(*[F.lit(None).cast(t).alias(c) for c, t in types.items()]))
    schema = ", ".join(f"`{c}` {t}" for c, t in types.items()) + ", released_us long"
    return rows.groupBy(*key).transformWithStateInPandas(Held(due, types), schema, "Append", "ProcessingTime")


def bursts(events: DataFrame, key: tuple[str, ...], gap: str = "30 minutes") -> DataFrame:
    """Sessions of a key's events that are closer than ``gap``; works on streams with a watermark too."""
    return events.groupBy(*key, F.session_window("ts", gap).alias("session")).agg(F.count("*").alias("n"), F.sum("usd").alias("usd")).select(*key, F.unix_micros("session.start").alias("start_us"), "n", "usd")


def cooldown(rows: DataFrame, key: tuple[str, ...], cooldown_us: int, columns: list[str], late: str | None = None) -> DataFrame:
    """Streaming form of the cooldown operators; ``rows`` has the key, us and ``columns``.

    With ``late``, rows have the event time ts too, and a key leaves the state when its
    cooldown is over by the watermark.
    """
    types = dict(rows.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in columns)
    return _stateful(rows, key, Cooldown(cooldown_us, columns, late is not None), schema, late)


def score(rows: DataFrame, key: tuple[str, ...] = KEY, seed: DataFrame | None = None) -> DataFrame:
    """(event_id, z, late) of a stream of events, with the baseline in state; late rows are those of an hour before the open one.

    ``seed`` is the state to begin with, ``baseline.open_state`` of a history.
    """
    return _stateful(rows, key, RollingBaseline(), "event_id long, z double, late boolean", None, seed)


def seeded_score(history: DataFrame, live: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """``score`` of a stream whose baselines begin with what the batch table ``history`` has."""
    return score(live, key, baseline.open_state(baseline.hourly_volume(history, key), key))


def hour_versions(events: DataFrame, path: str, checkpoint: str, key: tuple[str, ...] = KEY, late: str = "14 days", **trigger: object):
    """Hourly volumes that late rows reopen: each batch writes the hours that it changed, as a new version.

    An hour can change until the watermark is ``late`` past it; the state holds the hours
    until then.  The version is the batch, and a batch that is repeated replaces its own
    rows.  ``current_hours`` and ``corrections`` read what it writes.
    """
    sums = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), *key).agg(F.sum("usd").alias("volume"))
    changed = sums.select(*key, F.unix_micros("window.start").alias("hour_us"), "volume")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")

    return changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def current_hours(versions: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """The newest version of every hour."""
    return versions.groupBy(*key, "hour_us").agg(F.max_by("volume", "version").alias("volume"), F.max("version").alias("version"))


def corrections(versions: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """The versions as changes: (op, volume, version) with a row that retracts the volume before, if any, and one that states the new."""
    w = Window.partitionBy(*key, "hour_us").orderBy("version")
    before = versions.withColumn("_before", F.lag("volume").over(w))
    change = F.array(F.struct(F.lit("retract").alias("op"), F.col("_before").alias("volume")), F.struct(F.when(F.col("_before").isNull(), "insert").otherwise("replace").alias("op"), F.col("volume")))
    rows = before.withColumn("x", F.explode(F.filter(change, lambda x: x["volume"].isNotNull())))
    return rows.select(*key, "hour_us", "version", "x.op", "x.volume")


def fan_out(rows: DataFrame, sinks: dict[str, Callable[[DataFrame], DataFrame]], root: str, checkpoint: str, **trigger: object):
    """One stream written to several folders by batch; a repeated batch replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for name, shape in sinks.items():
            shape(batch).write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
        batch.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def run_once(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drive a stream over all that is there, into Parquet, and read the result.

    Run again with the same checkpoint it goes on where it stopped: a batch counts once
    its files are in the sink's log, and a repeated one replaces what it left.
    """
    with rocksdb_state(rows.sparkSession):
        rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
