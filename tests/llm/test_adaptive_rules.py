"""Quality rules against loops over words and sorted lists of buckets."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from conftest import SF
from edge_rows import CLASHING, VALUES, SCHEMA, edge_docs, edge_rows, empty_docs, long_docs, words
from pyspark.sql import functions as F

from chainsignals.llm import adaptive_rules, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    own = WORD.findall(text)
    windows = Counter(tuple(own[i : i + 5]) for i in range(len(own) - 4))
    covered = {j for i in range(len(own) - 4) if windows[tuple(own[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)


def bucket(v):
    shift = max(v.bit_length() - 6, 0)
    return v >> shift << shift


def brute(rows, min_docs=adaptive_rules.MIN_DOCS):
    """Expected (doc_id, measures, base_failed, kept) of (doc_id, text, lang, source)."""
    found = []
    for d, text, lang, source in rows:
        m = counted(text or "")
        base = m[0] < 10 or 100 * m[4] > 20 * m[0]
        ratio = [1000 * x // y if y else 0 for x, y in ((m[1], m[0]), (m[2], m[0]), (m[3], m[5]), (m[4], m[0]))]
        found.append((d, lang, source, m, base, ratio))
    groups = defaultdict(list)
    for _, lang, source, _, base, ratio in found:
        if not base:
            for key in ((lang, source), (lang,), ()):
                groups[key].append(ratio)

    def passes(lang, source, ratio):
        key = next((k for k in ((lang, source), (lang,)) if len(groups[k]) >= min_docs), ())
        for k, rule in enumerate(adaptive_rules.RULES):
            values = sorted(bucket(r[k]) for r in groups[key])
            q = [next(v for i, v in enumerate(values, 1) if 100 * i >= p * len(values)) for p in (25, 50, 75)]
            if ratio[k] > q[2] + 4 * max(q[2] - q[1], rule.slack) or (rule.low and ratio[k] < q[0] - 4 * max(q[1] - q[0], rule.slack)):
                return False
        return True

    return Counter((d, *m, base, not base and passes(lang, source, ratio)) for d, lang, source, m, base, ratio in found)


def rows_of(df):
    return Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines, r.base_failed, r.kept) for r in df.collect())


def four(rows):
    return [(r[0], r[1], r[2], r[3]) for r in rows]


def test_query_and_sql(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    want = Counter((*r[:6], *r[7:]) for r in brute(docs).elements())
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert Counter(map(tuple, queries.op12_adaptive_rules(spark, SF).select(*columns).collect())) == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert Counter(map(tuple, con.sql(queries.OP12_SQL).select(*columns).fetchall())) == want


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = adaptive_rules.measured(docs, F.col("doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    # measures are computed once, not once for each column
    assert plan.count("xxhash64") == 1


@pytest.mark.parametrize("min_docs", [1, 3, 200])
def test_edges(spark, min_docs):
    rows = edge_rows()
    assert rows_of(adaptive_rules.quality_rules(edge_docs(spark), min_docs)) == brute(four(rows), min_docs)
    kept = adaptive_rules.keep_by_rules(edge_docs(spark), min_docs)
    assert kept.columns == edge_docs(spark).columns
    want = Counter(r[0] for r in brute(four(rows), min_docs).elements() if r[-1])
    assert Counter(r.doc_id for r in kept.collect()) == want
    assert adaptive_rules.quality_rules(empty_docs(spark)).count() == adaptive_rules.keep_by_rules(empty_docs(spark)).count() == 0


def test_groups_of_many_sizes(spark):
    rng = random.Random(8)
    rows = []
    for i in range(900):
        lang = rng.choice(["en", "de", None])
        source = rng.choice(["hot", "hot", "hot", f"s{i % 40}", None])
        text = words(rng, rng.randrange(5, 60))
        if i % 9 == 0:
            text = re.sub(" ", " # $ ", text)
        if i % 11 == 0:
            text = "\n".join([text, text[:20], text[:20], text[:20]])
        rows.append((i, text, lang, source, len(text), 1, *[VALUES[t] for t in list(CLASHING.values())[1:]]))
    got = rows_of(adaptive_rules.quality_rules(spark.createDataFrame(rows, SCHEMA), 50))
    assert got == brute(four(rows), 50)
    assert 0 < sum(not r[-1] and not r[-2] for r in got.elements())


def test_long_texts(spark):
    rows = [tuple(r) for r in long_docs(spark).select("doc_id", "text", "lang", "source").collect()]
    again = (4, rows[0][1] + "\n" + rows[0][1], "en", "s")
    docs = spark.createDataFrame([*rows, again], "doc_id long, text string, lang string, source string")
    assert rows_of(adaptive_rules.quality_rules(docs)) == brute([*rows, again])


def test_sketches_merge(spark):
    rows = adaptive_rules.measured(edge_docs(spark), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    whole = adaptive_rules.sketches(rows)
    parts = adaptive_rules.sketches(rows.where("n_words > 20")).unionByName(adaptive_rules.sketches(rows.where("n_words <= 20")))
    by = ("lang", "source", "rule")
    assert sorted(adaptive_rules.quantiles(whole, by, {"q": 40}).collect()) == sorted(adaptive_rules.quantiles(parts, by, {"q": 40}).collect())
    values = spark.range(0, 5000).select(F.col("id"), adaptive_rules.bucket(F.col("id")).alias("b")).collect()
    assert all(r.b == bucket(r.id) and r.b <= r.id <= r.b + r.b // 32 for r in values)
