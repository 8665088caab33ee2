"""Cross-tokenizer alignment by lockstep merging.

One NumPy state vector holds the A and B pointers of all segments of a batch of
documents.  Each step compares the byte ends at the pointers, advances the nearer side or
both, emits the cuts where both end and the links of the groups that they close, and
takes finished segments out.  How many documents hold a linked id pair is counted over
the corpus: a batch sends each of its distinct pairs once and gets its count back, so
no table of pairs is broadcast and none is held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .two_tokenizers import SHIFT, TwoTokenizers, two_tokenizers

#: A pair of ids is a * PAIR + b.
PAIR = 1 << 16
#: Bytes of text that are aligned together; one longer text is aligned alone.
BATCH_BYTES = 4 << 20
#: Groups of more links are counted by distinct ids instead of link by link.
LARGE_GROUP = 4096
_DOCUMENT = "batch long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, times binary"


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b_from: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Per step the groups that close there: segment, first and end place in A, first and end place in B.

    ``a_ends`` and ``b_ends`` are byte ends of all tokens of a batch, in which segment i
    has the A tokens ``a_from[i]`` to ``a_to[i]`` and the B tokens from ``b_from[i]`` on;
    both sides of a segment hold tokens and end at the same byte.
    """
    segment = np.arange(len(a_from))
    at_a, at_b, group_a, group_b, to = a_from.copy(), b_from.copy(), a_from.copy(), b_from.copy(), a_to
    while len(segment):
        end_a, end_b = a_ends[at_a], b_ends[at_b]
        cut = np.flatnonzero(end_a == end_b)
        at_a += end_a <= end_b
        at_b += end_b <= end_a
        if len(cut):
            yield segment[cut], group_a[cut], at_a[cut], group_b[cut], at_b[cut]
            group_a[cut], group_b[cut] = at_a[cut], at_b[cut]
            left = at_a < to
            if not left.all():
                segment, at_a, at_b, group_a, group_b, to = (x[left] for x in (segment, at_a, at_b, group_a, group_b, to))


def _links(of: np.ndarray, a: np.ndarray, b: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document and pair as one number, times) of the links of groups; large groups by their distinct ids."""
    n_b, n = b1 - b0, (a1 - a0) * (b1 - b0)
    large = n > LARGE_GROUP
    if large.any():
        for d, p, q, r, s in zip(*(x[large].tolist() for x in (of, a0, a1, b0, b1)), strict=True):
            (x, nx), (y, ny) = np.unique(a[p:q], return_counts=True), np.unique(b[r:s], return_counts=True)
            yield (d << 32) + (x[:, None] * PAIR + y).ravel(), np.outer(nx, ny).ravel()
        of, a0, b0, n_b, n = (x[~large] for x in (of, a0, b0, n_b, n))
    if (n == 1).all():
        yield (of << 32) + a[a0] * PAIR + b[b0], n
    else:
        group = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
        yield (of[group] << 32) + a[a0[group] + k // n_b[group]] * PAIR + b[b0[group] + k % n_b[group]], np.ones(len(group), np.int64)


@cache
def _signs() -> np.ndarray:
    """Every id with the sign after it: of a token within a side, of the last A and of the last B token of a group."""
    return np.array([f"{i}{s}" for s in ",|;" for i in range(PAIR)], "S6")


class Aligned:
    """Groups and links of a batch of texts."""

    def __init__(self, texts: list[str], both: TwoTokenizers):
        ids, ends, of = both.segments(texts)
        second = ids >= SHIFT
        self.a, self.b = ids[~second].astype(np.int64), (ids[second] - SHIFT).astype(np.int64)
        b_to = np.concatenate([[0], np.cumsum(second)])[ends]
        a_to = ends - b_to
        a_from, b_from = np.concatenate([[0], a_to])[:-1], np.concatenate([[0], b_to])[:-1]
        cuts, keys, times = [], [], []
        # both sides of a segment have the same bytes, so ends in the whole batch compare as well
        for segment, *group in lockstep(np.cumsum(both.a_width[self.a]), np.cumsum(both.b_width[self.b]), a_from, a_to, b_from):
            cuts.append((group[1], group[3]))
            for key, n in _links(of[segment], self.a, self.b, *group):
                keys.append(key)
                times.append(n)
        none = np.zeros(0, np.int64)
        #: Ends of all groups in either stream, in order of the texts.
        self.a_cuts, self.b_cuts = (np.sort(np.concatenate([none, *x])) for x in (zip(*cuts, strict=True) if cuts else ([], [])))
        #: Tokens before each text, and the end.
        self.a_at, self.b_at = (np.concatenate([[0], np.cumsum(np.bincount(of, to - begin, len(texts)))]).astype(np.int64) for begin, to in ((a_from, a_to), (b_from, b_to)))
        keys, times = np.concatenate([none, *keys]), np.concatenate([none, *times])
        order = np.argsort(keys)
        keys, first = np.unique(keys[order], return_index=True)
        #: Distinct (text, pair) and how many links it has.
        self.pair, self.text = keys & 0xFFFFFFFF, keys >> 32
        self.times = np.add.reduceat(times[order], first) if len(first) else none

    def per_text(self) -> tuple[np.ndarray, np.ndarray]:
        """Groups and links of each text."""
        at = np.searchsorted(self.a_cuts, self.a_at, "right")
        links = np.diff(self.a_cuts, prepend=0) * np.diff(self.b_cuts, prepend=0)
        return np.diff(at), np.diff(np.concatenate([[0], np.cumsum(links)])[at])

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups written out as ``a1,a2|b1;a3|b2,b3``."""
        signs = _signs()
        a_n, b_n = np.diff(self.a_cuts, prepend=0), np.diff(self.b_cuts, prepend=0)
        a_code, b_code = self.a.copy(), self.b.copy()
        a_code[self.a_cuts - 1] += PAIR
        b_code[self.b_cuts - 1] += 2 * PAIR
        code = np.empty(len(a_code) + len(b_code), np.int64)
        code[np.arange(len(a_code)) + np.repeat(self.b_cuts - b_n, a_n)] = a_code
        code[np.arange(len(b_code)) + np.repeat(self.a_cuts, b_n)] = b_code
        out = []
        for at, to in zip((self.a_at + self.b_at)[:-1].tolist(), (self.a_at + self.b_at)[1:].tolist(), strict=True):
            written = signs[code[at:to]].tobytes().translate(None, b"\0")[:-1]
            out.append(hashlib.sha256(written).hexdigest() if at < to else "")
        return out


def _batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of up to ``most`` bytes, or of one longer text."""
    doc_ids, texts, size = [], [], 0
    for batch in batches:
        for d, raw in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            if texts and size + len(raw) > most:
                yield doc_ids, texts
                doc_ids, texts, size = [], [], 0
            doc_ids.append(d)
            texts.append(raw.decode("utf-8", "replace"))
            size += len(raw)
    if texts:
        yield doc_ids, texts


def _narrow(values: np.ndarray) -> bytes:
    """Unsigned numbers in the fewest bytes each, the width first."""
    kind = np.min_scalar_type(int(values.max())) if len(values) else np.dtype("u1")
    return bytes([kind.itemsize]) + values.astype(kind.newbyteorder("<")).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def aligned_documents(docs: DataFrame, first: str | None = None, second: str | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """A row for each document with its counts and digest, its links as places in the pairs of its batch.

    The first row of a batch also has ``pairs``, the batch's distinct id pairs in order,
    and ``held``, how many of its documents have each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, task = two_tokenizers(first, second), TaskContext.get().partitionId()
        for number, (doc_ids, texts) in enumerate(_batches(batches, batch_bytes)):
            found = Aligned(texts, both)
            groups, links = found.per_text()
            pairs, place, held = np.unique(found.pair, return_inverse=True, return_counts=True)
            at = np.searchsorted(found.text, np.arange(len(texts) + 1))
            own = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            columns = [
                pa.array([task << 32 | number] * len(texts), pa.int64()),
                pa.array(doc_ids, pa.int64()),
                pa.array(np.diff(found.a_at)),
                pa.array(np.diff(found.b_at)),
                pa.array(groups),
                pa.array(links),
                pa.array(found.digests()),
                pa.array([_narrow(np.diff(place[i:j], prepend=0)) for i, j in own], pa.binary()),
                pa.array([_narrow(found.times[i:j]) for i, j in own], pa.binary()),
                pa.array([pairs.tolist(), *[None] * (len(texts) - 1)], pa.list_(pa.int64())),
                pa.array([held.tolist(), *[None] * (len(texts) - 1)], pa.list_(pa.int64())),
            ]
            names = ["batch", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times", "pairs", "held"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("text"))
    return rows.mapInArrow(run, f"{_DOCUMENT}, pairs array<long>, held array<long>")


def pair_counts(aligned: DataFrame, scratch: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """(batch, place, pair) of every batch, and (pair, count, best) of the corpus.

    ``count`` is how many documents hold the pair linked; ``best`` says that no pair of
    its A id has a higher one.  The highest counts are one row for each A id of a vocabulary.
    """
    sent = aligned.where("pairs is not null").select("batch", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "x"))
    sent = sent.select("batch", "place", F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    counts = scratch.table(sent.groupBy("pair").agg(F.sum("held").alias("count")), "pair-counts")
    a_id = F.shiftright("pair", 16)
    highest = counts.groupBy(a_id.alias("a_id")).agg(F.max("count").alias("highest"))
    facts = counts.join(F.broadcast(highest), a_id == F.col("a_id")).select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    return sent.drop("held"), facts


def align_tokenizers(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document.

    Tokens are those of space and text; places where tokens of both vocabularies end cut
    them into groups, and all A-B tokens of a group are linked.  A null or empty text, and
    one whose tokens do not give its bytes back, has no tokens: zeros and no digest.
    Repeated rows are documents of their own, also in the counts, null ids stay null,
    of pairs with equal counts all are the best, long texts are aligned whole, and an
    empty table gives no rows.  Only doc_id and text are read, so other columns may have
    any name.
    """
    spark = docs.sparkSession

    def counted(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        count, best = np.zeros(len(answers), np.int64), np.zeros(len(answers), np.int64)
        at = answers["place"].to_numpy()
        count[at], best[at] = answers["count"].to_numpy(), answers["best"].to_numpy().astype(np.int64)
        n_best, total = [], []
        for places, times in zip(rows["places"].to_pylist(), rows["times"].to_pylist(), strict=True):
            here, n = np.cumsum(_wide(places)), _wide(times)
            n_best.append(int((n * best[here]).sum()))
            total.append(int((n * count[here]).sum()))
        kept = rows.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64())).append_column("groups_sha256", rows["groups_sha256"])

    with common.scratch(spark) as scratch, common.small_batches(spark):
        aligned = scratch.table(aligned_documents(docs, first, second), "aligned")
        sent, facts = pair_counts(aligned, scratch)
        answers = sent.join(facts, "pair").select("batch", F.col("place").cast("long").alias("place"), "count", "best")
        rows = aligned.drop("pairs", "held").withColumnRenamed("batch", "of_batch")
        result = rows.groupBy("of_batch").cogroup(answers.groupBy("batch")).applyInArrow(counted, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
        return common.materialize(result, "alignment")


def link_table(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """(a_id, b_id, count, best) of every id pair that some document holds linked."""
    spark = docs.sparkSession
    with common.scratch(spark) as scratch, common.small_batches(spark):
        aligned = scratch.table(aligned_documents(docs, first, second), "aligned")
        _, facts = pair_counts(aligned, scratch)
        return common.materialize(facts.select(F.shiftright("pair", 16).alias("a_id"), F.col("pair").bitwiseAND(PAIR - 1).alias("b_id"), "count", "best"), "links")
