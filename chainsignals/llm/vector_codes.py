"""Vector code compression: integer product codes, assigned by Orchard search.

Vectors become integers once and are stored in the shared folder.  Each round assigns
all parts in tasks, starting from the entries of the round before, and sums the parts of
each entry in the task before the shuffle; what reaches the driver are the codebooks, whose
size does not grow with the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .orchard import Codebooks

#: Components stay within so many units on either side, so that sums of squares fit 64 bits.
_BOUND = 1 << 26
#: Vectors whose searches advance together.
BLOCK = 1024
_CODED = "vec_id long, label string, whole binary, codes binary, error long"


def usable(vector: Column) -> Column:
    """Whether a vector is there and all of its components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def _integers(vectors: list[list[float]], scale: int) -> np.ndarray:
    return np.clip(np.floor(np.array(vectors, np.float64) * scale), -_BOUND, _BOUND).astype("<i4")


def integer_vectors(embeddings: DataFrame, dimension: int, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, label, whole) of usable vectors with ``dimension`` components, each floor(scale * x) in 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                whole = _integers(batch["vector"].to_pylist(), scale)
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array([x.tobytes() for x in whole], pa.binary())], ["vec_id", "label", "whole"])

    rows = embeddings.where(usable(F.col(vector)) & (F.size(vector) == dimension))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col(vector).alias("vector"))
    return rows.mapInArrow(run, "vec_id long, label string, whole binary")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, np.frombuffer(b"".join(part["whole"].to_pylist()), "<i4").reshape(part.num_rows, -1)


def assign(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """``vectors`` with codes, one byte for each part, and error, the squared distances summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, whole in _blocks(batches):
            start = np.frombuffer(b"".join(part["codes"].to_pylist()), "u1").reshape(len(whole), -1) if "codes" in part.schema.names else None
            codes, away = books.nearest(whole, start)
            packed = pa.array([x.tobytes() for x in codes.astype("u1")], pa.binary())
            yield pa.RecordBatch.from_arrays([part["vec_id"], part["label"], part["whole"], packed, pa.array(away.sum(axis=1))], ["vec_id", "label", "whole", "codes", "error"])

    return vectors.mapInArrow(run, _CODED)


def part_sums(coded: DataFrame, parts: int, entries: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) to the count and the componentwise sum of its parts; one row for each used entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(parts * entries, np.int64), None
        for part, whole in _blocks(batches):
            codes = np.frombuffer(b"".join(part["codes"].to_pylist()), "u1").reshape(len(whole), parts)
            at = (codes + np.arange(parts) * entries).ravel()
            x = whole.reshape(len(at), -1)
            total = np.zeros((parts * entries, x.shape[1]), np.int64) if total is None else total
            order = np.argsort(at, kind="stable")
            used, first, n = np.unique(at[order], return_index=True, return_counts=True)
            count[used] += n
            total[used] += np.add.reduceat(x[order].astype(np.int64), first, axis=0)
        if total is not None:
            used = np.flatnonzero(count)
            columns = [used // entries, used % entries, count[used]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    rows = coded.select("whole", "codes").mapInArrow(run, "part long, entry long, n long, total array<long>")
    # sums of many tasks, component by component
    each = rows.select("part", "entry", "n", F.posexplode("total").alias("place", "x"))
    sums = each.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    found: dict = {}
    for r in sums.orderBy("part", "entry", "place").collect():  # parts * entries * width rows at most
        found.setdefault((r.part, r.entry), (r.n, []))[1].append(r.x)
    return found


def first_entries(embeddings: DataFrame, vector: str = "embedding", entries: int = 64, scale: int = 256) -> np.ndarray:
    """The usable vectors with the smallest ids as integers, of the first one's dimension.

    Equal ids follow each other by their components, and null ids come last.
    """
    kept = embeddings.where(usable(F.col(vector)))
    id_ = F.col("vec_id").cast("long").asc_nulls_last()
    head = kept.select("vec_id", F.col(vector).alias("vector")).orderBy(id_, "vector").limit(1).collect()
    if not head:
        return np.zeros((0, 0), "<i4")
    same = kept.where(F.size(vector) == len(head[0].vector)).select("vec_id", F.col(vector).alias("vector"))
    return _integers([r.vector for r in same.orderBy(id_, "vector").limit(entries).collect()], scale)


def compress(embeddings: DataFrame, vector: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, whole, codes, error) of all usable vectors, stored, and the final codebooks.

    A vector that is null or holds null or non-finite components is dropped, and so is one
    whose length is not that of the vector with the smallest id; this length must be a
    multiple of ``parts``.  Components beyond 2^26 units count as 2^26.  Of equally near
    entries the lower index is taken, unused entries stay, tables with fewer vectors than
    ``entries`` have as many entries, repeated rows count each, and an empty table gives
    no rows and no codebooks.  ``entries`` is 256 at most: a code is one byte.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    spark = embeddings.sparkSession
    first = first_entries(embeddings, vector, entries, scale)
    if not first.size:
        return spark.createDataFrame([], _CODED), None
    if first.shape[1] % parts:
        raise ValueError(f"{first.shape[1]} components are not {parts} equal parts")
    books = Codebooks(first.reshape(len(first), parts, -1).swapaxes(0, 1))
    with common.scratch(spark) as scratch:
        coded = scratch.table(integer_vectors(embeddings, first.shape[1], vector, scale), "vectors")
        for _ in range(rounds):
            coded = scratch.table(assign(coded, books), "codes")
            scratch.drop(last=1)
            moved = books.entries.copy()
            for (part, entry), (n, total) in part_sums(coded, parts, books.k).items():
                moved[part, entry] = [x // n for x in total]
            books = Codebooks(moved)
        return common.materialize(assign(coded, books), "vector-codes"), books


def code_digest(coded: DataFrame, books: Codebooks | None) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of ``compress``'s result.

    Errors are summed by label before the shuffle; the join with the sums is left to
    adaptive execution, which splits a label of very many rows.  Null labels are one label.
    """
    digest = hashlib.sha256(",".join(map(str, books.entries.ravel().tolist() if books else [])).encode()).hexdigest()
    sums = coded.groupBy(F.col("label").alias("of_label")).agg(F.try_sum("error").alias("label_error"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def decoded(coded: DataFrame, books: Codebooks, scale: int = 256) -> DataFrame:
    """(vec_id, vector): what the codes stand for, the middle of each unit."""
    parts = books.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.frombuffer(b"".join(batch["codes"].to_pylist()), "u1").reshape(batch.num_rows, parts)
            x = (books.flat[codes + np.arange(parts) * books.k].reshape(batch.num_rows, -1) + 0.5) / scale
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(x.tolist(), pa.list_(pa.float64()))], ["vec_id", "vector"])

    return coded.select("vec_id", "codes").mapInArrow(run, "vec_id long, vector array<double>")
