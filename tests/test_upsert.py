"""Batches in a database table: once each, also when one fails on the way."""

import pytest
from pyspark.sql import functions as F

from chainsignals.sources import upsert

TYPES = {"createTableColumnTypes": "state VARCHAR(20)"}
DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@pytest.fixture
def url(tmp_path):
    return f"jdbc:derby:{tmp_path}/db;create=true"


def payments(spark, low, high, state="new"):
    return spark.range(low, high).select("id", F.lit(state).alias("state"), (F.col("id") * 1.5).alias("amount"))


def table(spark, url, name="payments"):
    return spark.read.jdbc(url, f'"{name}"', properties={"driver": DRIVER})


def test_batches_are_merged_by_key(spark, url):
    options = {"stream": "pay", "url": url, "table": "payments", "key": ("id",), "newest": "amount", "driver": DRIVER, **TYPES}
    assert upsert.upsert_batch(payments(spark, 0, 50), 0, **options)
    twice = payments(spark, 40, 60, "seen").unionByName(payments(spark, 40, 60, "later").withColumn("amount", F.lit(1e6)))
    assert upsert.upsert_batch(twice, 1, **options)
    rows = table(spark, url).collect()
    assert sorted(r.id for r in rows) == list(range(60))
    assert {r.id for r in rows if r.state == "later"} == set(range(40, 60))
    # a batch that the ledger has changes nothing
    assert not upsert.upsert_batch(payments(spark, 0, 60, "again"), 1, **options)
    assert table(spark, url).where("state = 'again'").count() == 0
    # other streams have a ledger entry of their own
    assert upsert.upsert_batch(payments(spark, 90, 92), 0, **{**options, "stream": "other"})
    assert {(r.stream, r.batch) for r in table(spark, url, upsert.LEDGER).collect()} == {("pay", 1), ("other", 0)}
    none = payments(spark, 0, 0)
    assert upsert.upsert_batch(none, 2, **options) and table(spark, url).count() == 62


def test_a_batch_that_fails_half_way_counts_once_after_it_is_repeated(spark, url, tmp_path, monkeypatch):
    options = {"url": url, "table": "payments", "key": ("id",), "driver": DRIVER, **TYPES}
    payments(spark, 0, 20).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("id long, state string, amount double").parquet(f"{tmp_path}/in")
    upsert.upsert_stream(stream(), "pay", checkpoint=f"{tmp_path}/cp", **options).awaitTermination()
    payments(spark, 10, 40, "late").write.mode("append").parquet(f"{tmp_path}/in")

    run = upsert._run

    def failing(connection, sql, *values):
        run(connection, sql, *values)
        if sql.startswith("MERGE"):
            raise RuntimeError("lost after the rows, before the ledger")

    monkeypatch.setattr(upsert, "_run", failing)
    with pytest.raises(Exception, match="lost after the rows"):
        upsert.upsert_stream(stream(), "pay", checkpoint=f"{tmp_path}/cp", **options).awaitTermination()
    assert table(spark, url).count() == 20 and table(spark, url).where("state = 'late'").count() == 0
    monkeypatch.setattr(upsert, "_run", run)
    # a row that cannot be computed fails the staging after some of its tasks have written
    bad = payments(spark, 10, 40, "bad").withColumn("amount", F.when(F.col("id") == 39, F.raise_error(F.lit("no amount"))).otherwise(F.col("amount")))
    with pytest.raises(Exception, match="no amount"):
        upsert.upsert_batch(bad, 1, "pay", **options)
    assert table(spark, url).count() == 20
    upsert.upsert_stream(stream(), "pay", checkpoint=f"{tmp_path}/cp", **options).awaitTermination()
    rows = table(spark, url).collect()
    assert sorted(r.id for r in rows) == list(range(40)) and sum(r.state == "late" for r in rows) == 30
