"""Best-fit packing of token sequences with large-item matching.

A packing depends on lengths alone, and there are at most ``capacity`` lengths.  So the
plan is made on the counts per length, whose size no amount of data changes; documents
then find their places by their rank among the pieces of their length, counted by Spark.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokenize import END_ID, encoder

#: ``row`` numbers the pieces of a task, so that equal ones are told apart; once stored it no longer changes.
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"
#: Pieces of one length that are ranked together, and parts of all lengths together, about, at most.
PART_ROWS, MOST_PARTS = 256, 65_536


def token_pieces(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every whole text as ids with an end id, cut into pieces of ``capacity`` ids only where longer.

    Columns are those of ``PIECE_SCHEMA``, and ids (little-endian, 32 bits) on request.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, "<u4")
        end, width = np.array([END_ID], enc.dtype).tobytes(), 4 * capacity
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "row", "ids"][: 6 + with_ids]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())[: 6 + with_ids]
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for d, x in zip(part["doc_id"].to_pylist(), enc.encode(part["text"].to_pylist()), strict=True):
                    x += end
                    for p, i in enumerate(range(0, len(x), width)):
                        ids = x[i : i + width]
                        row += 1
                        rows.append((d, p, p * capacity, len(ids) // 4, zlib.crc32(ids), row, ids)[: 6 + with_ids])
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("text"))
    return texts.mapInArrow(run, PIECE_SCHEMA + ", ids binary" * with_ids)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Groups of equal bins, as ([(length, how many in a bin)], number of bins).

    Lengths above a third of the capacity go first, the longest with the longest partner
    above a third that fits, so at most two share a bin.  The others follow by decreasing
    length, each into the bin with the smallest gap that holds it; bins of one kind are
    filled together.  Every step uses up a length or a kind of bin.
    """
    left = {n: c for n, c in counts.items() if c}
    open_bins: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    gaps: list[int] = []

    def put(items: list[tuple[int, int]], n: int) -> None:
        gap = capacity - sum(a * k for a, k in items)
        if gap not in open_bins:
            open_bins[gap] = []
            bisect.insort(gaps, gap)
        open_bins[gap].append((items, n))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        i = bisect.bisect_right(large, capacity - n) - 1
        if i < 0:
            large.pop()
            put([(n, 1)], left.pop(n))
        elif large[i] == n:
            if left[n] > 1:
                put([(n, 2)], left[n] // 2)
            left[n] %= 2
            if left[n]:
                # one is left over; its partner is the next shorter length
                large.pop()
                if large:
                    m = large[-1]
                    put([(n, 1), (m, 1)], 1)
                    left[m] -= 1
                    if not left[m]:
                        large.pop()
                else:
                    put([(n, 1)], 1)
            else:
                large.pop()
            left.pop(n)
        else:
            m = large[i]
            both = min(left[n], left[m])
            put([(n, 1), (m, 1)], both)
            for x in (n, m):
                left[x] -= both
                if not left[x]:
                    large.remove(x)
                    del left[x]
    for n in sorted((n for n in left if left[n]), reverse=True):
        need = left[n]
        while need:
            i = bisect.bisect_left(gaps, n)
            if i == len(gaps):
                put([], -(-need // (capacity // n)))
                continue
            gap = gaps[i]
            items, bins = open_bins[gap].pop()
            if not open_bins[gap]:
                del open_bins[gap]
                gaps.pop(i)
            fit = gap // n
            full = min(bins, need // fit)
            if full:
                put([*items, (n, fit)], full)
            need -= full * fit
            rest = bins - full
            if rest and need and need < fit:
                put([*items, (n, need)], 1)
                need, rest = 0, rest - 1
            if rest:
                put(items, rest)
    return [group for found in open_bins.values() for group in found]


def _places(groups: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """Ranges of ranks of a length and where their pieces go."""
    rows, used, first_bin = [], {}, 0
    for items, bins in groups:
        offset = 0
        for n, k in items:
            at = used.get(n, 0)
            rows.append((n, at, first_bin, k, offset))
            used[n] = at + bins * k
            offset += n * k
        first_bin += bins
    rows.sort()
    return {name: np.array(v, np.int64) for name, v in zip(("length", "rank", "bin", "per_bin", "offset"), zip(*rows, strict=True) if rows else [[]] * 5, strict=True)}


def place_pieces(pieces: DataFrame, capacity: int = 4096, part_rows: int = PART_ROWS) -> DataFrame:
    """Stored ``pieces`` with sequence_id and offset in place of row.

    A length with many pieces is ranked in several parts by a hash of the stored row
    number, so neither a hot length nor many equal pieces land in one task.  There are at
    most capacity + ``MOST_PARTS`` parts, whatever the data.
    """
    names = [c for c in pieces.columns if c != "row"]
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    target = max(part_rows, -(-sum(counts.values()) // MOST_PARTS))
    parts = [max(1, -(-counts.get(n, 0) // target)) for n in range(1, capacity + 1)]
    salt = F.pmod(F.xxhash64("row"), F.element_at(F.lit(parts), F.col("length").cast("int"))).cast("int")
    dealt = pieces.withColumn("part", salt)
    sizes = sorted((r.length, r.part, r.n) for r in dealt.groupBy("length", "part").agg(F.count("*").alias("n")).collect())
    part_key = np.array([n << 20 | p for n, p, _ in sizes], np.int64)
    size = np.array([c for *_, c in sizes], np.int64)
    before = np.cumsum(size) - size
    lengths = part_key >> 20
    part_rank = before - before[np.searchsorted(lengths, lengths)] if len(sizes) else before
    places = _places(plan_bins(counts, capacity))
    place_key = places["length"] << 44 | places["rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, p, nth = (batch[c].to_numpy().astype(np.int64) for c in ("length", "part", "nth"))
            rank = part_rank[np.searchsorted(part_key, n << 20 | p)] + nth - 1
            i = np.searchsorted(place_key, n << 44 | rank, side="right") - 1
            bins, slot = np.divmod(rank - places["rank"][i], places["per_bin"][i])
            kept = [batch[c] for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(places["bin"][i] + bins), pa.array(places["offset"][i] + slot * n)], [*names, "sequence_id", "offset"])

    order = Window.partitionBy("length", "part").orderBy("row")
    schema = ", ".join(f"`{n}` {t}" for n, t in [*[x for x in pieces.dtypes if x[0] != "row"], ("sequence_id", "long"), ("offset", "long")])
    return dealt.withColumn("nth", F.row_number().over(order)).drop("row").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None) -> DataFrame:
    """Place of every piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone; a long text is encoded whole and cut into
    pieces; rows that repeat a doc_id, null ids too, are documents of their own; an empty
    table gives no rows.  Only doc_id and text are read, so other columns may have any name.
    Which of equally long pieces goes where is left to the stored row order.
    """
    with common.small_batches(docs.sparkSession, 2 << 20):
        pieces = common.materialize(token_pieces(docs, capacity, tokenizer), "pieces")
        return place_pieces(pieces, capacity)


def packed_sequences(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None) -> DataFrame:
    """The sequences themselves: sequence_id, ids, and the lengths of the pieces in them.

    Documents are treated as in ``pack_documents``.
    """
    with common.small_batches(docs.sparkSession, 2 << 20):
        pieces = common.materialize(token_pieces(docs, capacity, tokenizer, with_ids=True), "pieces", **{"parquet.block.size": 16 << 20})
        placed = place_pieces(pieces, capacity)
    inside = F.array_sort(F.collect_list(F.struct("offset", "length", F.hex("ids").alias("ids"))))
    return placed.groupBy("sequence_id").agg(inside.alias("inside")).select("sequence_id", F.unhex(F.array_join(F.transform("inside", lambda x: x.ids), "")).alias("ids"), F.transform("inside", lambda x: x.length).alias("lengths"))
