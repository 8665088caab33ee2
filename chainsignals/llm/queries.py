"""One query for each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adaptive_rules, alignment, common, decontaminate, media, near_dups, packing, quality, secret_spans, site_lines, substrings, token_store, toxicity, vector_codes


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_store(common.table(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.feature_digest(media.media_features(common.table(spark, sf_dir, "documents")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.table(spark, sf_dir, "documents"), capacity=4096)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans.scan_secrets(common.table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "n_matched", "n_windows", "n_slots", "n_consistent")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = site_lines.drop_boilerplate(common.table(spark, sf_dir, "documents"), counts=True)
    return cleaned.select("doc_id", "source", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(common.table(spark, sf_dir, "documents"), window=35)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "source", "lang", "own_logit", "site_mean", "quality", "kept")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(common.table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_digest(*vector_codes.compress(common.table(spark, sf_dir, "embeddings")))


def op12_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = adaptive_rules.quality_rules(common.table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(common.table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit()}


OP6_SQL = """
WITH pages AS (
    SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents
), on_page AS (
    SELECT source, unnest(list_distinct(list_filter(list_transform(lines, lambda x: trim(x, ' ')), lambda x: x <> ''))) AS line FROM pages
), totals AS (
    SELECT source, count(*) AS site_pages FROM pages GROUP BY source
), dropped AS (
    SELECT o.source, o.line FROM on_page o JOIN totals t USING (source)
    GROUP BY o.source, o.line, t.site_pages HAVING count(*) >= 5 AND count(*) > 0.1 * t.site_pages
), by_site AS (
    SELECT source, list(line) AS drops FROM dropped GROUP BY source
), kept AS (
    SELECT p.doc_id, p.source, p.lines, list_filter(p.lines, lambda x: b.drops IS NULL OR NOT list_contains(b.drops, trim(x, ' '))) AS left_lines
    FROM pages p LEFT JOIN by_site b USING (source)
)
SELECT doc_id, source, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(left_lines) AS BIGINT) AS n_removed,
       sha256(array_to_string(left_lines, chr(10))) AS text_sha256
FROM kept
"""


_WORDS = r"list_filter(regexp_split_to_array({}, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"

OP7_SQL = f"""
WITH w AS (
    SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents
), windows AS (
    SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)
), repeated AS (
    SELECT h FROM windows GROUP BY h HAVING count(*) > 1
), gone AS (
    SELECT doc_id, list(DISTINCT p) AS places FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM windows JOIN repeated USING (h)) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(ws, lambda x, i: places IS NULL OR NOT list_contains(places, i)), ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""

OP10_SQL = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS g FROM w
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS held FROM shingles a JOIN shingles b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * held >= 85 * (x.n + y.n - held)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), roots AS (
    SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM roots LEFT JOIN sizes USING (doc_id)
"""


def _nearest(book: str) -> str:
    """The squared distance and the index of the nearest entry of ``book`` for every part."""
    away = " + ".join(f"(v.x[{i}] - b.x[{i}]) * (v.x[{i}] - b.x[{i}])" for i in range(1, 5))
    return f"SELECT v.vec_id, v.p, any_value(v.x) AS x, min([{away}, b.e]) AS m FROM parts v JOIN {book} b USING (p) GROUP BY v.vec_id, v.p"


def _moved(book: str, assigned: str) -> str:
    """``book`` with each entry at the floor of the mean of its parts."""
    means = ", ".join(f"CAST(floor(sum(x[{i}]) / count(*)) AS BIGINT)" for i in range(1, 5))
    return f"SELECT b.p, b.e, coalesce(c.x, b.x) AS x FROM {book} b LEFT JOIN (SELECT p, m[2] AS e, [{means}] AS x FROM {assigned} GROUP BY ALL) c USING (p, e)"


OP11_SQL = f"""
WITH parts AS (
    SELECT vec_id, p, list_transform(embedding[4 * p + 1:4 * p + 4], lambda x: CAST(floor(x * 256) AS BIGINT)) AS x
    FROM embeddings, range(16) r(p)
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), b0 AS (
    SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS BIGINT) AS e, x FROM parts QUALIFY e < 64
), a0 AS ({_nearest("b0")}), b1 AS ({_moved("b0", "a0")}), a1 AS ({_nearest("b1")}), b2 AS ({_moved("b1", "a1")}), a2 AS ({_nearest("b2")}
), coded AS (
    SELECT vec_id, string_agg(printf('%02x', m[2]), '' ORDER BY p) AS code, CAST(sum(m[1]) AS BIGINT) AS error FROM a2 GROUP BY vec_id
), books AS (
    SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN embeddings USING (vec_id), books
"""

OP12_SQL = f"""
WITH w AS (
    SELECT doc_id, lang, source, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS ws,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS ls FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)
), repeated AS (
    SELECT doc_id, h FROM windows GROUP BY doc_id, h HAVING count(*) > 1
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM windows JOIN repeated USING (doc_id, h)) GROUP BY doc_id
), m AS (
    SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
           CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines
    FROM w LEFT JOIN covered USING (doc_id)
), b AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
), shares AS (
    SELECT doc_id, lang, source, base_failed, unnest(['word_length', 'symbols', 'duplicate_lines', 'repeats']) AS rule, unnest([500, 25, 100, 50]) AS slack,
           unnest([coalesce(1000 * word_chars // nullif(n_words, 0), 0), coalesce(1000 * n_symbols // nullif(n_words, 0), 0),
                   coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0), coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0)]) AS v FROM b
), sketch AS (
    SELECT lang, source, rule, slack, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS bucket, count(*) AS n
    FROM shares WHERE NOT base_failed GROUP BY ALL
), levels AS (
    SELECT 0 AS level, lang AS l, source AS s, rule, slack, bucket, n FROM sketch
    UNION ALL SELECT 1, lang, NULL, rule, slack, bucket, sum(n) FROM sketch GROUP BY ALL
    UNION ALL SELECT 2, NULL, NULL, rule, slack, bucket, sum(n) FROM sketch GROUP BY ALL
), up_to AS (
    SELECT *, sum(n) OVER (PARTITION BY level, l, s, rule ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY level, l, s, rule) AS docs FROM levels
), quartiles AS (
    SELECT level, l, s, rule, slack, docs, min(bucket) FILTER (100 * below >= 25 * docs) AS q25, min(bucket) FILTER (100 * below >= 50 * docs) AS q50,
           min(bucket) FILTER (100 * below >= 75 * docs) AS q75 FROM up_to GROUP BY ALL
), able AS (
    SELECT level, l, s, rule, q75 + 4 * greatest(q75 - q50, slack) AS high, CASE WHEN rule = 'word_length' THEN q25 - 4 * greatest(q50 - q25, slack) END AS low
    FROM quartiles WHERE level = 2 OR docs >= 200
), broken AS (
    SELECT x.doc_id, x.rule, arg_min(x.v > c.high OR coalesce(x.v < c.low, FALSE), c.level) AS fails FROM shares x
    JOIN able c ON c.rule = x.rule AND (c.level = 2 OR c.l IS NOT DISTINCT FROM x.lang) AND (c.level > 0 OR c.s IS NOT DISTINCT FROM x.source)
    GROUP BY x.doc_id, x.rule
), verdicts AS (
    SELECT doc_id, bool_or(fails) AS fails FROM broken GROUP BY doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(fails, FALSE) AS kept
FROM b LEFT JOIN verdicts USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": OP6_SQL, "op7_substring_dedup": OP7_SQL, "op10_near_duplicates": OP10_SQL, "op11_vector_codes": OP11_SQL, "op12_adaptive_rules": OP12_SQL}
