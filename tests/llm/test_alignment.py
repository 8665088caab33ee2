"""Cross-tokenizer alignment against a merge of whole encodings by loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from edge_rows import edge_docs, edge_rows, empty_docs, long_docs

from chainsignals.llm import alignment, queries
from chainsignals.llm.two_tokenizers import TwoTokenizers


@pytest.fixture(scope="module")
def both():
    return TwoTokenizers()


def by_loops(text, both):
    """(n_a, n_b, n_groups, n_links, digest) and the links of one text, encoded whole."""
    raw = (" " + text).encode()
    a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    a_bytes, b_bytes = [both.a_bytes[i] for i in a], [both.b_bytes[i] for i in b]
    if not text or b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
        return (0, 0, 0, 0, ""), Counter()
    ends = [np.cumsum([len(x) for x in side]).tolist() for side in (a_bytes, b_bytes)]
    links, groups, i, j = Counter(), [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        p, q = i, j
        i, j = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
        groups.append(",".join(map(str, a[p:i])) + "|" + ",".join(map(str, b[q:j])))
        links.update((x, y) for x in a[p:i] for y in b[q:j])
    return (len(a), len(b), len(groups), sum(links.values()), hashlib.sha256(";".join(groups).encode()).hexdigest()), links


def corpus(texts, both):
    """Expected rows of a corpus, without the ids."""
    each = [by_loops(t, both) for t in texts]
    counts = Counter(pair for _, links in each for pair in links)
    highest: dict = {}
    for (a, _), n in counts.items():
        highest[a] = max(n, highest.get(a, 0))
    return [(*row[:4], sum(n for p, n in links.items() if counts[p] == highest[p[0]]), sum(n * counts[p] for p, n in links.items()), row[4]) for row, links in each]


def rows_of(df):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_query(spark, both):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(queries.op13_tokenizer_alignment(spark, SF)) == Counter((d, *row) for (d, _), row in zip(docs, corpus([t for _, t in docs], both), strict=True))


def test_edges(spark, both):
    want = Counter((r[0], *row) for r, row in zip(edge_rows(), corpus([r[1] or "" for r in edge_rows()], both), strict=True))
    assert rows_of(alignment.align_tokenizers(edge_docs(spark))) == want
    assert alignment.align_tokenizers(empty_docs(spark)).count() == 0
    assert alignment.link_table(empty_docs(spark)).count() == 0


def test_long_texts(spark, both):
    texts = [(r.doc_id, r.text) for r in long_docs(spark).collect()]
    # a text of one word is a single chunk; loops over it are slow, so a shorter one stands for it
    short = spark.createDataFrame([(d, t if " " in t else t[:20_000]) for d, t in texts], "doc_id long, text string")
    got = rows_of(alignment.align_tokenizers(short))
    each = [by_loops(t if " " in t else t[:20_000], both)[0] for _, t in texts]
    assert {(r[0], *r[1:5], r[7]) for r in got} == {(d, *row) for (d, _), row in zip(texts, each, strict=True)}
    whole = {r.doc_id: r for r in alignment.align_tokenizers(long_docs(spark)).collect()}
    assert whole[2].n_a == len(both.a.encode(" " + texts[1][1], add_special_tokens=False).ids)


def test_link_table(spark, both):
    texts = [r[1] or "" for r in edge_rows()]
    counts = Counter(pair for t in texts for pair in by_loops(t, both)[1])
    got = alignment.link_table(edge_docs(spark)).collect()
    assert {(r.a_id, r.b_id): r["count"] for r in got} == counts
    assert all(r.best == (r["count"] == max(n for (a, _), n in counts.items() if a == r.a_id)) for r in got)


def test_chunks_and_groups(both):
    signs = [" ", "  ", "\n", "\t", "'s", "'", "a", "the", "Zx", "9", "12", "é", "東京", "😀", "▁", "\xa0", " ", "\x0b", "\x1c", "\x85", "᠎", "​", ".", "!!", "<|endoftext|>", "<s>", "<0x41>", "x́", "\r\n", "ﬁ", "a b", "\x00", "　"]
    rng = random.Random(1)
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 14))) for _ in range(8000)]
    texts += ["x" * 30_000, " " * 3000, "ab" * 2000 + " " + "é" * 2000, "", " ", "\n", "end "]
    found = alignment.Aligned(texts, both)
    groups, links = found.per_text()
    shapes = zip(np.diff(found.a_at).tolist(), np.diff(found.b_at).tolist(), groups.tolist(), links.tolist(), found.digests(), strict=True)
    want = [by_loops(t, both) for t in texts]
    assert list(shapes) == [row for row, _ in want]
    got = Counter({(t, p // alignment.PAIR, p % alignment.PAIR): n for t, p, n in zip(found.text.tolist(), found.pair.tolist(), found.times.tolist(), strict=True)})
    assert got == Counter({(t, *pair): n for t, (_, links) in enumerate(want) for pair, n in links.items()})


def test_large_groups_count_by_distinct_ids():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 9, 90), rng.integers(0, 7, 80)
    whole = [np.array([x]) for x in (3, 0, 90, 0, 80)]
    (keys, times), *_ = alignment._links(whole[0], a, b, *whole[1:])
    want = Counter((3 << 32) + int(x) * alignment.PAIR + int(y) for x in a for y in b)
    assert 90 * 80 > alignment.LARGE_GROUP and dict(zip(keys.tolist(), times.tolist(), strict=True)) == want


def test_batches_do_not_matter(spark, both):
    docs = edge_docs(spark)
    small = alignment.aligned_documents(docs, batch_bytes=300).select("n_a", "n_links", "groups_sha256").collect()
    assert Counter(small) == Counter(alignment.aligned_documents(docs).select("n_a", "n_links", "groups_sha256").collect())
