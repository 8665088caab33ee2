"""Near-duplicate documents by MinHash: universal hash minima, banding, verification, components.

Documents with equal shingle sets form a class; one document stands for it.  Bands
of minima put classes into buckets.  A small bucket is compared pair by pair, a large
one with a centre: the class that shares most buckets with others.  Classes that a
centre does not link are joined exactly with all classes of their buckets by prefixes
of their sets in order of rarity, so no pair that a bucket holds is left undecided.
A bucket whose classes are copies of its centre, or texts of one template that differ
by more than the similarity allows, costs in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

#: Bytes of a shingle's hash that a stored set keeps.
_WIDTH = 6
#: A bucket up to this size is compared pair by pair.
SMALL_BUCKET = 12
BROADCAST_IDS = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text, A-Z lower-cased.

    A text with fewer words has its whole sequence as one shingle, a text without
    words none.
    """
    w = word_hashes(text.lower().split())
    if not len(w):
        return w
    if len(w) < size:
        size = len(w)
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + mix(w[k : len(w) - size + 1 + k])
    return np.unique(mix(h))


class MinHasher:
    """Minima of multiply-shift universal hashes, fixed by a seed."""

    def __init__(self, bands: int, rows: int, seed: int = 20):
        rng = np.random.default_rng(seed)
        n = bands * rows
        self.a = rng.integers(0, 2**63, n, np.uint64) << np.uint64(1) | np.uint64(1)
        self.b = rng.integers(0, 2**63, n, np.uint64)
        self.c = rng.integers(0, 2**63, rows, np.uint64) << np.uint64(1) | np.uint64(1)
        self.bands, self.rows = bands, rows

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), 2**64 - 1, np.uint64)
        for at in range(0, len(shingles), 512):
            np.minimum(least, (shingles[at : at + 512, None] * self.a + self.b).min(axis=0), out=least)
        return (least >> np.uint64(32)).astype("<u4")

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """A key for each band, of shape (documents, bands)."""
        rows = signatures.reshape(-1, self.bands, self.rows).astype(np.uint64)
        return mix((rows * self.c).sum(axis=2, dtype=np.uint64) + mix(np.arange(1, self.bands + 1, dtype=np.uint64))).view(np.int64)


_SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, signature binary"


def sign(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """Set size, set identity and signature of every document; an empty set has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHasher(bands, rows)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = []
                for text in part["text"].to_pylist():
                    s = shingle_set(text, shingle)
                    if len(s):
                        h1, h2 = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8").tolist()
                        out.append((len(s), h1, h2, hasher.signature(s).tobytes()))
                    else:
                        out.append((0, None, None, None))
                columns = [pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *columns], ["doc_id", "n_shingles", "h1", "h2", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("text")).mapInArrow(run, _SIGNED)


def band_members(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, node) for each class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHasher(bands, rows)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                signatures = np.frombuffer(b"".join(part["signature"].to_pylist()), "<u4").reshape(part.num_rows, bands * rows)
                node = np.repeat(part["node"].to_numpy(), bands)
                yield pa.RecordBatch.from_arrays([pa.array(hasher.keys(signatures).reshape(-1)), pa.array(node)], ["key", "node"])

    return classes.select("node", "signature").mapInArrow(run, "key long, node long")


def class_sets(docs: DataFrame, nodes: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """Full sets and signatures of the classes in ``nodes`` (node, h1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHasher(bands, rows)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keep, out = [], []
                for i, (text, h1) in enumerate(zip(part["text"].to_pylist(), part["h1"].to_pylist(), strict=True)):
                    s = shingle_set(text, shingle)
                    if len(s) and int(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")[0]) == h1:
                        keep.append(i)
                        short = np.unique(s >> np.uint64(8 * (8 - _WIDTH)))
                        out.append((short.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_WIDTH].tobytes(), hasher.signature(s).tobytes()))
                if keep:
                    sets, signatures = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([part["node"].take(pa.array(keep)), pa.array(sets, pa.binary()), pa.array(signatures, pa.binary())], ["node", "shingles", "signature"])

    few = nodes.count() <= BROADCAST_IDS
    wanted = F.broadcast(nodes) if few else nodes
    rows_of = docs.select(F.col("doc_id").cast("long").alias("node"), common.text_bytes().alias("text")).join(wanted, "node")
    return rows_of.mapInArrow(run, "node long, shingles binary, signature binary").dropDuplicates(["node"])


def _unpack(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // _WIDTH, 8), np.uint8)
    wide[:, :_WIDTH] = np.frombuffer(raw, np.uint8).reshape(-1, _WIDTH)
    return wide.view("<u8").reshape(-1)


def compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Signature check, then the similarity on full sets: (a, b, linked).

    Signatures that agree far less than the similarity asks for (by a quarter of all minima,
    over nine standard deviations) settle a pair without its sets.
    """

    floor = percent / 100 - 0.25

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for s, t, x, y in zip(*(part[c].to_pylist() for c in ("sig_a", "sig_b", "set_a", "set_b")), strict=True):
                    alike = np.frombuffer(s, "<u4") == np.frombuffer(t, "<u4")
                    if alike.mean() < floor:
                        linked.append(False)
                        continue
                    u, v = _unpack(x), _unpack(y)
                    common_to_both = len(np.intersect1d(u, v, assume_unique=True))
                    union = len(u) + len(v) - common_to_both
                    linked.append(100 * common_to_both >= percent * union)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    def side(x: str) -> DataFrame:
        return sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}"), F.col("signature").alias(f"sig_{x}"))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sig_a", "sig_b", "set_a", "set_b").mapInArrow(run, "a long, b long, linked boolean")


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def rare_prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(token, node, size, place, shorter): the rarest shingles of each set that a similar set must share one of.

    Sets are ordered by how many sets hold a shingle.  Shingles of one set alone come
    first and are left out, but count for the places of the others.  ``shorter`` marks the
    places that suffice where the partner is at least as large as the set itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                tokens = [_unpack(x) for x in part["shingles"].to_pylist()]
                sizes = np.array([len(t) for t in tokens])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(part["node"].to_numpy(), sizes)), pa.array(np.repeat(sizes, sizes))], ["token", "node", "size"])

    held = sets.select("node", "shingles").mapInArrow(run, "token long, node long, size long")
    spread = held.groupBy("token").agg(F.count("*").alias("spread")).where("spread > 1")
    shared = held.join(spread, "token").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("spread", "token"))).alias("tokens"))
    alone = F.col("size") - F.size("tokens")
    # any similar set holds percent of this one at least; one as large as this one holds 2 percent / (100 + percent) of it
    places = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1 - alone
    fewer = F.col("size") - F.ceil(F.col("size") * 2 * percent / (100 + percent)) + 1
    first = shared.where(places > 0).select("node", "size", alone.alias("alone"), F.posexplode(F.slice("tokens", F.lit(1), places.cast("int"))).alias("i", "t"))
    return first.select("t.token", "node", "size", (F.col("alone") + F.col("i")).alias("place")).withColumn("shorter", F.col("place") < fewer)


def prefix_pairs(prefixes: DataFrame, outliers: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of an outlier and a set of another group that can reach the similarity.

    ``prefixes`` are ``rare_prefixes`` with the group of each set.  The smaller set of a
    pair shares one of its ``shorter`` places; what stands after a shared shingle in
    either set bounds the intersection, and so does the number of shingles shared up to the last one.
    A shingle that a whole template has stands behind the shorter places of sets that are
    too different to be linked, so these never meet through it.
    """
    marked = prefixes.join(outliers.withColumn("outlier", F.lit(True)), "node", "left").withColumn("outlier", F.coalesce("outlier", F.lit(False)))

    def meet(smaller: DataFrame, larger: DataFrame) -> DataFrame:
        x, y = (side.select("token", *[F.col(c).alias(f"{c}_{n}") for c in ("node", "size", "place", "group")]) for side, n in ((smaller, "x"), (larger, "y")))
        ordered = (F.col("size_x") < F.col("size_y")) | ((F.col("size_x") == F.col("size_y")) & (F.col("node_x") < F.col("node_y")))
        alike = (100 * F.col("size_x") >= percent * F.col("size_y")) & (F.col("group_x") != F.col("group_y"))
        rest = F.least(F.col("size_x") - F.col("place_x"), F.col("size_y") - F.col("place_y"))
        fits = (100 + percent) * rest >= percent * (F.col("size_x") + F.col("size_y"))
        return x.join(y, "token").where(ordered & alike & fits)

    shorter = marked.where("shorter")
    met = meet(shorter.where("outlier"), marked).unionByName(meet(shorter.where("not outlier"), marked.where("outlier")))
    pairs = met.groupBy("node_x", "node_y", "size_x", "size_y").agg(F.count("*").alias("n"), F.max("place_x").alias("x"), F.max("place_y").alias("y"))
    most = F.col("n") + F.least(F.col("size_x") - F.col("x"), F.col("size_y") - F.col("y")) - 1
    return pairs.where((100 + percent) * most >= percent * (F.col("size_x") + F.col("size_y"))).select(*_ordered("node_x", "node_y"))


def _with_group(rows: DataFrame, groups: DataFrame, node: str = "node", group: str = "group") -> DataFrame:
    """``rows`` with the group of a node; a node without links is its own."""
    named = groups.select(F.col("node").alias(node), F.col("component").alias("_found"))
    return rows.join(named, node, "left").withColumn(group, F.coalesce("_found", node)).drop("_found")


def verified_groups(scratch: common.Scratch, placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) by all pairs of classes that share a bucket and reach the similarity.

    ``placed`` has key, node and n, the size of the bucket.  A pair of a bucket that could
    join two groups has a class outside the group of the bucket's centre, so only these
    outliers are looked at again; what they add links groups, not classes.
    """
    small = placed.where(F.col("n") <= SMALL_BUCKET).select("key", "node")
    other = small.select("key", F.col("node").alias("other"))
    near = small.join(other, "key").where("node < other").select(*_ordered("node", "other"))
    large = placed.where(F.col("n") > SMALL_BUCKET)
    popular = placed.groupBy("node").agg(F.sum("n").alias("met"))
    best = large.join(popular, "node").groupBy("key").agg(F.max(F.struct("met", (-F.col("node")).alias("minus"))).alias("c"))
    # stored, so that the join with a hot bucket's members is a plain one that can be split
    centres = scratch.table(best.select("key", (-F.col("c.minus")).alias("centre")), "centres")
    spokes = scratch.table(large.join(centres, "key").where("node <> centre").select("key", "node", "centre", *_ordered("node", "centre")), "spokes")
    found = compare(near.unionByName(spokes.select("a", "b")).distinct(), sets, percent).where("linked")
    groups = connected_components(found.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    grouped = _with_group(_with_group(spokes, groups), groups, "centre", "centre_group")
    undecided = scratch.table(grouped.where(F.col("group") != F.col("centre_group")).select("key", "node"), "undecided")
    if undecided.isEmpty():
        return groups
    outliers = undecided.select("node").distinct()
    crowd = placed.join(undecided.select("key").distinct(), "key", "left_semi").select("node").distinct()
    prefixes = scratch.table(_with_group(rare_prefixes(sets.join(crowd, "node", "left_semi"), percent), groups), "prefixes")
    more = scratch.table(compare(prefix_pairs(prefixes, outliers, percent), sets, percent).where("linked").select("a", "b"), "more")
    if more.isEmpty():
        return groups
    ends = _with_group(_with_group(more, groups, "a", "u"), groups, "b", "v").select("u", "v").distinct()
    merged = connected_components(ends, scratch).select(F.col("node").alias("group"), F.col("component").alias("merged"))
    every = groups.select("node", F.col("component").alias("group")).unionByName(merged.select(F.col("group").alias("node"), "group")).distinct()
    return every.join(merged, "group", "left").groupBy("node").agg(F.min(F.coalesce("merged", "group")).alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 30, rows: int = 6) -> DataFrame:
    """Near-duplicate groups: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= ``percent`` * union of their sets
    of ``shingle``-word shingles; component_id is the smallest doc_id reachable and
    kept says that it is the document's own.  Null, empty and word-free texts are linked
    with nothing; long texts are read whole.  A row without doc_id is its own group
    (component_id null) and kept.  Rows that repeat a doc_id count as one document and
    each get a row; an empty table gives none.  Only doc_id and text are read, so other
    columns may have any name.

    Shingles of two sets are compared by 48 bits of their hashes: that two different ones
    of sets of n and m shingles are taken for one has a chance of n * m / 2^48, about
    4e-9 for texts of a thousand words each.
    """
    with common.scratch(docs.sparkSession) as scratch, common.small_batches(docs.sparkSession):
        signed = scratch.table(sign(docs, shingle, bands, rows), "signed")
        full = signed.where("h1 is not null and doc_id is not null")
        classes = full.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"))
        own = classes.groupBy("node").agg(F.min(F.struct("h1", "h2")).alias("h")).select("node", "h.h1", "h.h2")
        keyed = full.join(own, (full.doc_id == own.node) & (full.h1 == own.h1) & (full.h2 == own.h2)).select("node", "signature").dropDuplicates(["node"])
        every = scratch.table(band_members(keyed, bands, rows), "bands")
        crowded = scratch.table(every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "crowded")
        members = scratch.table(every.join(crowded, "key"), "members")
        nodes = scratch.table(own.join(members.select("node").distinct(), "node", "left_semi").select("node", "h1"), "nodes")
        sets = scratch.table(class_sets(docs, nodes, shingle, bands, rows), "sets", **{"parquet.block.size": 16 << 20})
        groups = verified_groups(scratch, members, sets, percent)
        placed = classes.join(groups, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component"))
        by_set = signed.select("doc_id", "n_shingles", "h1", "h2").join(placed, ["h1", "h2"], "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
        return common.materialize(by_set.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")), "groups")


def drop_near_duplicates(docs: DataFrame, **options: int) -> DataFrame:
    """``docs`` with one document of each near-duplicate group left, with exactly their columns.

    Texts are read as in ``near_duplicates``: rows without doc_id and those without words
    stay, repeated rows of a kept doc_id too, and columns of ``docs`` may have any name.
    """
    of = common.fresh("gone", docs.columns)
    gone = common.materialize(near_duplicates(docs, **options).where("not kept").select(F.col("doc_id").alias(of)).distinct(), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(of), "left_anti")
