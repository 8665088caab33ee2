"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Documents are dealt into batches by a hash of their row and its place, so that equal
rows spread too; all batches read one exchange, and an answer that does not fit a batch
is an error.  A batch sends the sorted
distinct hashes of its windows, split into ranges of the hash, with a mark for those
that it holds more than once: a window that very many documents share travels once per
batch.  A range finds the hashes that two batches hold and answers each batch with one
bit per hash; the batch then joins overlapping repeated windows into maximal intervals.
The text is shuffled once, as both steps read the same exchange.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .near_dups import mix, word_hashes

#: Text of a batch and windows of a range on small inputs, and on large ones at most.
BATCH_BYTES, MOST_BATCH_BYTES = 8_000_000, 48_000_000
RANGE_WINDOWS, MOST_RANGE_WINDOWS = 500_000, 8_000_000
#: Hashes that a row between a batch and a range should hold, at least.
ROW_HASHES = 100
#: Bytes of a word and its space in prose; one-letter words make three times as many windows.
WORD_BYTES = 6
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept between batches."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        both = []
        for factor in (_BASE, pow(_BASE, -1, 2**64)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        _powers = tuple(both)
    return _powers[0][:n], _powers[1][:n]


def rabin_karp(words: np.ndarray, window: int) -> np.ndarray:
    """Hash of each window of word hashes, from prefix sums of a polynomial modulo 2^64."""
    if len(words) < window:
        return np.zeros(0, np.uint64)
    up, down = powers(len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * down, out=sums[1:])
    return mix((sums[window:] - sums[:-window]) * up[: len(words) - window + 1])


def batch_windows(texts: list[bytes], window: int) -> list[np.ndarray]:
    """Window hashes of each text; its words are not kept."""
    return [rabin_karp(word_hashes(t.split()), window) for t in texts]


def removal_intervals(repeated: np.ndarray, window: int, n_words: int) -> np.ndarray:
    """Maximal [from, to) word intervals that repeated windows cover."""
    steps = np.zeros(n_words + 1, np.int32)
    at = np.flatnonzero(repeated)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + window, -1)
    covered = np.concatenate([[0], (np.cumsum(steps[:-1]) > 0).astype(np.int8), [0]])
    edges = np.diff(covered)
    return np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)], axis=1)


def layout(size: int, tasks: int) -> tuple[int, int]:
    """Number of batches and bits of ranges for so many bytes of text.

    Batches times ranges is the number of rows between them, which grows with the square of
    the input while both keep their size.  So beyond some 40 GB both grow, within what a
    task can hold, for rows of ``ROW_HASHES`` hashes: at 1 TB a row still holds 50,
    at 100 TB about four.
    """
    windows = size / WORD_BYTES
    more = math.sqrt(max(1.0, ROW_HASHES * windows / (BATCH_BYTES / WORD_BYTES * RANGE_WINDOWS)))
    batch = min(MOST_BATCH_BYTES, BATCH_BYTES * more)
    held = min(MOST_RANGE_WINDOWS, RANGE_WINDOWS * more * more * BATCH_BYTES / batch)
    return max(2 * tasks, math.ceil(size / batch)), max(4, int(windows / held).bit_length())


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """Words of each document that lie in no repeated window.

    Result: doc_id, n_words, n_removed, starts and ends of the removed word intervals,
    kept_text (kept words joined by one space, as UTF-8 bytes).  A word is removed if a
    window of ``window`` words over it has a word sequence that also starts anywhere
    else, in the same document too.  Null and empty texts have no words; texts shorter
    than a window keep all; long texts are read whole; repeated rows repeat each other; an
    empty table gives no rows.  Only doc_id and text are read, so other columns may have any
    name.
    Two different windows are taken for one with a chance of 2^-64.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("text"))
    row = F.xxhash64("doc_id", "text")
    held = texts.groupBy(row.alias("row")).agg(F.sum(F.length("text")).alias("bytes")).agg(F.sum("bytes").alias("size"), F.max("bytes").alias("most")).first()
    n_batches, bits = layout(held.size or 0, common.shuffle_partitions(spark))
    # the deal is read twice, so a row's batch must come out the same when its task runs again
    dealt = texts.withColumn("batch", F.pmod(row, F.lit(n_batches)))
    if (held.most or 0) > BATCH_BYTES:
        # equal rows that would fill a batch are dealt out, and the deal is stored
        dealt = common.materialize(texts.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(n_batches))), "dealt")

    def distinct_hashes(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]), return_counts=True)

    def cuts(sorted_hashes: np.ndarray) -> np.ndarray:
        return np.searchsorted(sorted_hashes >> np.uint64(64 - bits), np.arange(2**bits + 1, dtype=np.uint64))

    def send(table: pa.Table) -> pa.Table:
        unique, counts = distinct_hashes(batch_windows(table["text"].to_pylist(), window))
        at = cuts(unique)
        used = np.flatnonzero(np.diff(at)).tolist()
        parts = [(int(r), unique[at[r] : at[r + 1]].tobytes(), np.packbits(counts[at[r] : at[r + 1]] > 1).tobytes()) for r in used]
        batch = table["batch"][0].as_py() if table.num_rows else 0
        return pa.table({"range": pa.array([p[0] for p in parts], pa.int32()), "batch": pa.array([batch] * len(parts), pa.int64()), "hashes": pa.array([p[1] for p in parts], pa.binary()), "marks": pa.array([p[2] for p in parts], pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        sent = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
        marks = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(h)).astype(bool) for m, h in zip(table["marks"].to_pylist(), sent, strict=True)]
        merged = np.sort(np.concatenate(sent))
        shared = np.unique(merged[1:][merged[1:] == merged[:-1]])

        def repeated(h: np.ndarray, m: np.ndarray) -> bytes:
            if len(shared):
                m = m | (shared[np.minimum(np.searchsorted(shared, h), len(shared) - 1)] == h)
            return np.packbits(m).tobytes()

        return pa.table({"batch": table["batch"].combine_chunks(), "range": table["range"].combine_chunks(), "n": pa.array(map(len, sent), pa.int32()), "repeated": pa.array(map(repeated, sent, marks), pa.binary())})

    def cut(texts_of: pa.Table, answers: pa.Table) -> pa.Table:
        texts = texts_of["text"].to_pylist()
        hashes = batch_windows(texts, window)
        unique, _ = distinct_hashes(hashes)
        at, flags = cuts(unique), np.zeros(len(unique), bool)
        if sum(answers["n"].to_pylist()) != len(unique):
            raise RuntimeError("the answers are not those of this batch")
        for r, n, answer in zip(answers["range"].to_pylist(), answers["n"].to_pylist(), answers["repeated"].to_pylist(), strict=True):
            if n != at[r + 1] - at[r]:
                raise RuntimeError("the answers are not those of this batch")
            flags[at[r] : at[r + 1]] = np.unpackbits(np.frombuffer(answer, np.uint8), count=n).astype(bool)
        wanted = unique[flags]
        rows = []
        for text, h in zip(texts, hashes, strict=True):
            w = text.split()
            hit = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h if len(wanted) else np.zeros(len(h), bool)
            spans = removal_intervals(hit, window, len(w)) if hit.any() else np.zeros((0, 2), int)
            kept, last = [], 0
            for a, b in spans.tolist():
                kept += w[last:a]
                last = b
            kept += w[last:]
            rows.append((len(w), len(w) - len(kept), spans[:, 0], spans[:, 1], b" ".join(kept)))
        columns = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
        return pa.table([texts_of["doc_id"].combine_chunks(), *columns], ["doc_id", "n_words", "n_removed", "starts", "ends", "kept_text"])

    types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
    sent = dealt.groupBy("batch").applyInArrow(send, "range int, batch long, hashes binary, marks binary")
    answers = sent.groupBy("range").applyInArrow(count, "batch long, range int, n int, repeated binary")
    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, starts array<int>, ends array<int>, kept_text binary")
