"""Benchmark decontamination by template windows.

Numbers, names and units become typed placeholders, so a question keeps its template
when it is asked with other values.  Windows of template words of the benchmark and of
the documents are hash-joined; a match counts only if its slots are consistent: one
value of the benchmark must stand for one value in the document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .near_dups import mix
from .substrings import rabin_karp

#: Units of measure, currencies and time (fixed values).
UNITS = frozenset("% cm day days dollar dollars euro euros ft g gallons gram grams h hour hours inch inches kg kilometers kilometres km l lb lbs liter liters litres m meter meters metres mg mi mile miles min minute minutes ml mm month months mph ounces oz pound pounds s second seconds week weeks year years yards $ € £".split())
_NUMBER = re.compile(r"[-+$€£]?\d[\d.,/:]*(%|[^\W\d_]{0,10})")
_EDGE = "".join(map(chr, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])) + "«»“”‘’…¡¿–—"
_WORD, _NUM, _NAME, _UNIT = range(4)
#: Words that begin sentences and are no names, so they need one reading only (fixed values).
_NO_NAMES = frozenset("a an the this that these those it its he she they we you i his her their our your my if in on at by for from of to with as after before during when while since until then there here how what who whom whose which where why and or but so yet each every all both some any no not is are was were be do does did has have had can could should would".split())
#: Words of a window with two readings of which all combinations are tried; with more, none, each one and all.
_READINGS = 8
#: Windows of fewer words, or with fewer that are no slots, say too little as templates; they are compared by value.
_LEAST_WORDS, _LEAST_LITERALS = 5, 2
#: Benchmark windows of which the hashes go to every task as a sorted array (8 bytes each).
FILTER_WINDOWS = 2_000_000
#: Up to so many leaked documents are broadcast (16 bytes each).
BROADCAST_LEAKS = 2_000_000


class Canonicalizer:
    """Typed template words of a text; facts about a word are cached in the worker."""

    def __init__(self, max_entries: int = 100_000):
        self.max_entries = max_entries
        self.number: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.number.clear()
        self.template, self.value = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)
        self.kind, self.ends = np.zeros(1024, np.int8), np.zeros(1024, bool)

    def _learn(self, word: str) -> int:
        core = word.strip(_EDGE)
        lower = core.lower()
        kind = _WORD
        if (m := _NUMBER.fullmatch(core)) and (not m[1] or m[1].lower() in UNITS or len(m[1]) <= 2):
            kind = _NUM
        elif lower in UNITS or (not core and word in UNITS):
            kind = _UNIT
        elif core[:1].isupper() and core[1:] == core[1:].lower() and lower not in _NO_NAMES:
            kind = _NAME
        self.number[word] = n = len(self.number)
        if n == len(self.kind):
            self.template, self.value, self.kind, self.ends = (np.concatenate([x, np.zeros_like(x)]) for x in (self.template, self.value, self.kind, self.ends))
        self.template[n] = xxhash.xxh3_64_intdigest(lower or word)
        self.value[n] = xxhash.xxh3_64_intdigest(lower or word, 1)
        self.kind[n] = kind
        self.ends[n] = word.rstrip("\"')]»”’")[-1:] in (".", "!", "?", ":", "")
        return n

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Template hash, value hash, slot mark, mark of a second reading and plain hash of each word.

        A capitalised word is a name; where it begins the text or follows a sentence's
        end it is read as a word, and its second reading is a name.  A unit is one only
        after a number.
        """
        words = text.split()
        if len(self.number) + len(words) > self.max_entries:
            self._reset()
        found = list(map(self.number.get, words))
        if None in found:
            get, learn = self.number.get, self._learn
            found = [learn(w) if (i := get(w)) is None else i for w in words]
        at = np.array(found, np.int64)
        kind, template = self.kind[at], self.template[at]
        if not len(at):
            return template, template, kind.astype(bool), kind.astype(bool), template
        before_end = np.concatenate([[True], self.ends[at[:-1]]])
        before_number = np.concatenate([[False], kind[:-1] == _NUM])
        slot = (kind == _NUM) | ((kind == _NAME) & ~before_end) | ((kind == _UNIT) & before_number)
        plain = template
        if slot.any():
            template = np.where(slot, kind.astype(np.uint64), template)
        either = (kind == _NAME) & before_end
        value = self.value[at] if slot.any() or either.any() else template
        return template, value, slot, either, plain


def _choices(places: list[int]) -> list[tuple[int, ...]]:
    """Which of the words with two readings are read as names."""
    if len(places) > _READINGS:
        return [(), *((p,) for p in places), tuple(places)]
    return [chosen for n in range(len(places) + 1) for chosen in combinations(places, n)]


def _windows(template: np.ndarray, slot: np.ndarray, plain: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window, and which windows are compared by value, without slots.

    Else a window of slots alone ("NUM NUM NUM ...") would meet every such window of the corpus.
    """
    hashes = mix(rabin_karp(template, size) + np.uint64(size))
    by_value = np.full(len(hashes), size < _LEAST_WORDS)
    if size >= _LEAST_WORDS and slot.any():
        sums = np.concatenate([[0], np.cumsum(~slot)])
        by_value = (sums[size:] - sums[:-size])[: len(hashes)] < _LEAST_LITERALS
    if by_value.any():
        hashes = np.where(by_value, mix(rabin_karp(plain, size) + np.uint64(size + (1 << 32))), hashes)
    return hashes, by_value


_BENCH = "item_id long, n_windows int, size int, hash long, place int, slots array<long>"
_HITS = "doc_id long, text_hash long, hash long, place int, slots array<long>"


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Template windows of the items in all readings; an item of fewer words than a window is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical = Canonicalizer()
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                template, value, slot, either, plain = canonical(text or "")
                if not len(template):
                    continue
                size = min(window, len(template))
                n = len(template) - size + 1
                for p in range(n):
                    v, marks, words = (x[p : p + size] for x in (value, slot, plain))
                    for chosen in _choices(np.flatnonzero(either[p : p + size]).tolist()):
                        read, named = template[p : p + size].copy(), marks.copy()
                        if chosen:
                            read[list(chosen)], named[list(chosen)] = np.uint64(_NAME), True
                        hashes, by_value = _windows(read, named, words, size)
                        rows.append((item, n, size, int(hashes.view(np.int64)[0]), p, [] if by_value[0] else v[named].view(np.int64).tolist()))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["item_id", "n_windows", "size", "hash", "place", "slots"])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).mapInArrow(run, _BENCH)


def document_windows(docs: DataFrame, sizes: list[int], wanted: np.ndarray | None) -> DataFrame:
    """Template windows of the documents; with ``wanted`` (sorted hashes) only those.

    A window is read with the words at its sentence starts as words and, if it has
    capitalised ones there, with all of these as names; the items' windows have the mixed readings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical = Canonicalizer()
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc_id, text_hash, text in zip(*(part[c].to_pylist() for c in ("doc_id", "text_hash", "text")), strict=True):
                    template, value, slot, either, plain = canonical(text)
                    readings = [(slot, size, *_windows(template, slot, plain, size)) for size in sizes]
                    if either.any():
                        named = np.where(either, np.uint64(_NAME), template)
                        readings += [(slot | either, size, *_windows(named, slot | either, plain, size)) for size in sizes]
                    for k, (marks, size, hashes, by_value) in enumerate(readings):
                        if wanted is None:
                            hit = range(len(hashes))
                        else:
                            hit = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)] == hashes).tolist() if len(hashes) else []
                        if k >= len(sizes):  # windows without a second reading are there already
                            hit = [p for p in hit if either[p : p + size].any()]
                        rows += [(doc_id, text_hash, int(hashes[p : p + 1].view(np.int64)[0]), p, [] if by_value[p] else value[p : p + size][marks[p : p + size]].view(np.int64).tolist()) for p in hit]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "text_hash", "hash", "place", "slots"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, _HITS)


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_share: float = 0.5, min_consistent: float = 0.8) -> DataFrame:
    """(doc_id, text_hash, item_id, n_matched, n_windows, n_slots, n_consistent) for each leaked item.

    An alignment of an item with a document is judged by itself: at least
    ``min_consistent`` of its slot values must stand for a single value each, or its
    windows don't count.  An item leaks into a document that holds at least
    ``min_share`` of its template windows in consistent alignments.  An item of fewer words
    than a window is one window; items under five words, and windows with fewer than two
    words that are no slots, must occur with their own values.  Null and empty texts and
    items hold nothing; long texts are read whole; repeated rows are reported once; a null
    doc_id or item_id is reported as null.  Only doc_id, item_id and text are read, so other
    columns may have any name.  An empty table on either side gives no rows.

    The benchmark's windows are filtered by in the scan while they are at most
    ``FILTER_WINDOWS``; beyond, all windows go to the shuffled join.
    """
    with common.scratch(docs.sparkSession) as scratch, common.small_batches(docs.sparkSession):
        bench = scratch.table(benchmark_windows(benchmark, window), "benchmark")
        sizes = sorted(r.size for r in bench.select("size").distinct().collect())
        hashes = bench.select("hash").distinct()
        wanted = None
        if hashes.count() <= FILTER_WINDOWS:
            wanted = np.sort(np.array([r.hash for r in hashes.collect()], np.int64).view(np.uint64))
            sizes = sizes if len(wanted) else []
        hits = document_windows(docs, sizes, wanted).withColumnRenamed("place", "at").withColumnRenamed("slots", "filled")
        found = scratch.table(hits.join(bench, "hash").where(F.size("slots") == F.size("filled")), "matches")
        pair = ["doc_id", "text_hash", "item_id"]
        found = found.withColumn("shift", F.col("at") - F.col("place"))
        slots = found.select(*pair, "shift", F.explode(F.arrays_zip("slots", "filled")).alias("s")).select(*pair, "shift", "s.slots", "s.filled").distinct()
        per_value = slots.groupBy(*pair, "shift", "slots").agg(F.count("*").alias("values"))
        judged = per_value.groupBy(*pair, "shift").agg(F.count("*").alias("n_slots"), F.count_if(F.col("values") == 1).alias("n_consistent"))
        consistent = F.col("n_consistent") >= min_consistent * F.col("n_slots")
        bad = judged.where(~consistent)
        alike = [found[c].eqNullSafe(bad[c]) for c in (*pair, "shift")]
        kept = found.join(bad, alike[0] & alike[1] & alike[2] & alike[3], "left_anti")
        matched = kept.groupBy(*pair).agg(F.countDistinct("place").alias("n_matched"), F.max("n_windows").alias("n_windows"))
        per_item = judged.where(consistent).groupBy(*pair).agg(F.sum("n_slots").alias("n_slots"), F.sum("n_consistent").alias("n_consistent"))
        same = [matched[c].eqNullSafe(per_item[c]) for c in pair]
        joined = matched.join(per_item, same[0] & same[1] & same[2], "left").select(*[matched[c] for c in pair], "n_matched", F.col("n_windows").cast("long").alias("n_windows"), F.coalesce("n_slots", F.lit(0)).alias("n_slots"), F.coalesce("n_consistent", F.lit(0)).alias("n_consistent"))
        return common.materialize(joined.where(F.col("n_matched") >= min_share * F.col("n_windows")), "leaked")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """``docs`` without the documents into which an item leaks, with exactly their columns.

    Null and empty texts stay, repeated rows go or stay together, rows without doc_id are
    judged by their text, and columns of ``docs`` may have any name.
    """
    of, hashed = common.fresh("leak_id", docs.columns), common.fresh("leak_hash", docs.columns)
    found = find_leaks(docs, benchmark, **options).select(F.col("doc_id").alias(of), F.col("text_hash").alias(hashed))
    leaks = common.materialize(found.distinct(), "leaks")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(hashed))
    return docs.join(F.broadcast(leaks) if leaks.count() <= BROADCAST_LEAKS else leaks, same, "left_anti")
