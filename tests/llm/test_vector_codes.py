"""Vector codes against searches of all entries, in Python integers."""

import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from conftest import SF

from chainsignals.llm import orchard, queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code int, whole string, `a.b` int"


def brute(rows, parts=16, entries=64, rounds=2):
    """Expected digest rows of (vec_id, vector, label)."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    cut = [[math.floor(float(np.float32(x)) * 256) for x in r[1]] for r in kept]
    w = len(cut[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in cut]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def near(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        held = defaultdict(list)
        for v in cut:
            for p in range(parts):
                held[p, near(v[p], p)[1]].append(v[p])
        for (p, i), x in held.items():
            books[p][i] = [sum(c) // len(x) for c in zip(*x, strict=True)]
    final = [[near(v[p], p) for p in range(parts)] for v in cut]
    errors = [sum(d for d, _ in f) for f in final]
    by_label = Counter()
    for r, e in zip(kept, errors, strict=True):
        by_label[r[2]] += e
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return Counter((r[0], "".join(f"{i:02x}" for _, i in f), e, by_label[r[2]], digest) for r, f, e in zip(kept, final, errors, strict=True))


def rows_of(df):
    return Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def test_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute(rows)
    assert rows_of(queries.op11_vector_codes(spark, SF)) == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert Counter(map(tuple, con.sql(queries.OP11_SQL).select("vec_id", "code", "error", "label_error", "codebooks_sha256").fetchall())) == want


@pytest.mark.parametrize("spread", [3, 200])
def test_orchard_finds_the_nearest_with_ties(spread):
    rng = np.random.default_rng(spread)
    entries = rng.integers(-spread, spread, (5, 40, 3))
    entries[:, 7] = entries[:, 3]
    books = orchard.Codebooks(entries)
    x = rng.integers(-2 * spread, 2 * spread, (700, 15))
    away = ((x.reshape(700, 5, 1, 3) - entries) ** 2).sum(axis=3)
    for start in (None, rng.integers(0, 40, (700, 5))):
        codes, least = books.nearest(x, start)
        assert (codes == away.argmin(axis=2)).all() and (least == away.min(axis=2)).all()


def edge_vectors():
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.2, 32).astype(np.float32).tolist(), None if i % 3 == 0 else i % 2) for i in range(90)]
    rows += [rows[5], rows[5], (None, rows[7][1], 1), (None, None, None)]
    rows += [(200, None, 1), (201, [None] * 32, 1), (202, [math.nan] * 32, 1), (203, [math.inf] * 32, 1), (204, [-math.inf, *[0.0] * 31], 0), (205, [], 0), (206, [0.5] * 16, 0)]
    rows += [(300, [7000.0] * 32, 5), (-4, [0.0] * 32, 0), (301, [-0.001] * 32, 0)]
    return rows


def edge_table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def test_edges(spark):
    rows = edge_vectors()
    coded, books = vector_codes.compress(edge_table(spark, rows))
    assert rows_of(vector_codes.code_digest(coded, books)) == brute(rows)
    few = rows[:3]
    assert rows_of(vector_codes.code_digest(*vector_codes.compress(edge_table(spark, few)))) == brute(few)
    for none in ([], rows[94:98]):
        assert vector_codes.code_digest(*vector_codes.compress(edge_table(spark, none))).count() == 0
    huge = [(i, [3e38 if i else -3e38] * 16, 1) for i in range(3)]
    assert vector_codes.code_digest(*vector_codes.compress(edge_table(spark, huge))).count() == 3
    with pytest.raises(ValueError):
        vector_codes.compress(edge_table(spark, [(1, [0.5] * 10, 0)]))


def test_decoded(spark):
    rows = [r for r in edge_vectors() if r[0] is not None and r[0] < 90 and r[1]]
    coded, books = vector_codes.compress(edge_table(spark, rows), entries=90)
    errors = {r.vec_id: r.error for r in coded.collect()}
    vectors = {r.vec_id: r.vector for r in vector_codes.decoded(coded, books).collect()}
    for i, x, _ in rows:
        away = sum((math.floor(a * 256) - math.floor(b * 256)) ** 2 for a, b in zip(x, vectors[i], strict=True))
        assert away == errors[i]
