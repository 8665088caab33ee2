"""Token-id store: concatenated ids with Elias-Fano document boundaries.

A store is a Parquet table of segments, so Spark's committer keeps the files of
a lost or repeated task out and any store that Spark reads will do.  A segment's
``payload`` is the binary format: head, Elias-Fano code of the document
boundaries, Elias-Fano code of the document ids, then the id array.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, elias_fano
from .tokenize import END_ID, encoder

MAGIC = b"EFTOK1\x00\x00"
_HEAD = struct.Struct("<8sQQQBxxxxxxx")
SEGMENT_SCHEMA = "part int, segment int, n_docs long, n_tokens long, first_id long, last_id long, payload binary"


def pack_segment(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """One segment; null document ids must come first, the others ascending."""
    nulls = sum(d is None for d in doc_ids)
    ends = np.cumsum([0, *(len(x) // width for x in ids)])
    return b"".join([
        _HEAD.pack(MAGIC, len(ids), int(ends[-1]), nulls, width),
        elias_fano.encode(ends),
        elias_fano.encode(np.array(doc_ids[nulls:], np.int64)),
        *ids,
    ])


class Segment:
    """Random access to one segment's documents."""

    def __init__(self, payload: bytes):
        raw = memoryview(payload)
        magic, self.n, self.n_tokens, self.nulls, width = _HEAD.unpack(raw[: _HEAD.size])
        if magic != MAGIC:
            raise ValueError("not a token segment")
        self.bounds = elias_fano.EliasFano(raw[_HEAD.size :])
        at = _HEAD.size + self.bounds.nbytes
        self.doc_ids = elias_fano.EliasFano(raw[at:])
        self.ids = np.frombuffer(raw[at + self.doc_ids.nbytes :], f"<u{width}", count=self.n_tokens)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.doc_ids.select(i - self.nulls)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


def encode_segments(docs: DataFrame, tokenizer: str | None = None, segment_tokens: int = 1_000_000, partitions: int | None = None) -> DataFrame:
    """Segments of all documents in ascending ``doc_id`` order.

    Each text is encoded whole and ended with id 1.  A null text counts as empty;
    null ids come first; rows that share an id follow each other in an order that
    their text fixes.  Columns besides ``doc_id`` and ``text`` are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer, "<u2"), TaskContext.get().partitionId()
        end = np.array([END_ID], enc.dtype).tobytes()
        doc_ids: list[int | None] = []
        ids: list[bytes] = []
        size = segment = 0

        def flush() -> pa.RecordBatch:
            nonlocal doc_ids, ids, size, segment
            row = [part, segment, len(ids), size // enc.dtype.itemsize, doc_ids[0], doc_ids[-1], pack_segment(doc_ids, ids, enc.dtype.itemsize)]
            doc_ids, ids, size, segment = [], [], 0, segment + 1
            types = (pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], ["part", "segment", "n_docs", "n_tokens", "first_id", "last_id", "payload"])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part_of = batch.slice(at, 512)
                for d, x in zip(part_of["doc_id"].to_pylist(), enc.encode(part_of["text"].to_pylist()), strict=True):
                    doc_ids.append(d)
                    ids.append(x + end)
                    size += len(x) + len(end)
                    if size >= segment_tokens * enc.dtype.itemsize:
                        yield flush()
        if ids:
            yield flush()

    n = partitions or common.shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("text"))
    tie = F.xxhash64("text")
    return rows.repartitionByRange(n, "doc_id", tie).sortWithinPartitions("doc_id", tie).mapInArrow(run, SEGMENT_SCHEMA)


def write_store(docs: DataFrame, path: str, **options: object) -> None:
    """Encode ``docs`` into a store at ``path``."""
    encode_segments(docs, **options).write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)


def segment_starts(store: DataFrame) -> DataFrame:
    """Ids before each segment: sums within a part, then over the parts."""
    index = store.select("part", "segment", "n_tokens")
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = parts.select("part", (F.sum("part_tokens").over(Window.orderBy("part")) - F.col("part_tokens")).alias("part_start"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_tokens")
    return index.withColumn("within", within).join(before, "part").select("part", "segment", (F.col("part_start") + F.col("within")).alias("segment_start"))


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """A row for each document of a store: doc_id, start, n_tokens, ids_crc32, and its ids on request."""
    schema = "part int, segment int, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, payload in zip(*(batch[c].to_pylist() for c in ("part", "segment", "payload")), strict=True):
                segment = Segment(payload)
                bounds = segment.bounds.select_many(np.arange(segment.n + 1))
                raw = segment.ids.astype("<u4").tobytes()
                each = [raw[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                doc_ids = [None] * segment.nulls + segment.doc_ids.select_many(np.arange(segment.n - segment.nulls)).tolist()
                columns = [pa.array([part] * segment.n, pa.int32()), pa.array([number] * segment.n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                names = ["part", "segment", "doc_id", "within", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(each, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    store = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    rows = store.select("part", "segment", "payload").mapInArrow(run, schema)
    kept = ["doc_id", (F.col("segment_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    return rows.join(segment_starts(store), ["part", "segment"]).select(*kept)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document, once for each row that had this id.

    Binary search and select on the segments' codes find it; no bounds are expanded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, payload in zip(*(batch[c].to_pylist() for c in ("part", "segment", "payload")), strict=True):
                segment = Segment(payload)
                at = segment.nulls + segment.doc_ids.rank(doc_id)
                found = []
                while at < segment.n and segment.doc_id(at) == doc_id:
                    found.append(segment.document(at).astype("<u4").tobytes())
                    at += 1
                if found:
                    columns = [pa.array([part] * len(found), pa.int32()), pa.array([number] * len(found), pa.int32()), pa.array(found, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "segment", "ids"])

    store = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    near = store.where((F.col("first_id").isNull() | (F.col("first_id") <= doc_id)) & (F.col("last_id") >= doc_id))
    rows = near.select("part", "segment", "payload").mapInArrow(run, "part int, segment int, ids binary").collect()
    return [np.frombuffer(r.ids, "<u4") for r in sorted(rows, key=lambda r: (r.part, r.segment))]


def token_store(docs: DataFrame, **options: object) -> DataFrame:
    """Write a store in the shared folder and read its documents back.

    A row for each document: doc_id, start, n_tokens, ids_crc32.  Null texts count as
    empty and have their end id alone; null ids come first; long texts are encoded whole;
    rows that share an id follow each other in an order that their text fixes; an empty
    table gives no rows.  Only doc_id and text are read, so other columns may have any name.
    """
    spark = docs.sparkSession
    path = common.shared_path(spark, "tokens")
    with common.small_batches(spark):
        write_store(docs, path, **options)
        return common.materialize(read_documents(spark, path), "token-index")
