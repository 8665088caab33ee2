"""The log store: what a scan pushes down, which files it reads, and what Bloom filters rule out."""

import pytest
from pyspark.sql import functions as F

from chainsignals.operators import decoding
from chainsignals.plans import ingestion
from chainsignals.sources import log_store

CHAINS = ["mantle", "ethereum", "arbitrum"]


def raw(spark, n=12_000):
    i = F.col("id")
    chain = F.when(i % 3 > 0, F.lit("mantle")).otherwise(F.lit("ethereum"))
    block = F.when(i % 2 == 0, F.concat(F.lit("0x"), F.hex(i))).otherwise(i.cast("string"))
    address = F.concat(F.lit("0xPool"), (i % 50 * 2).cast("string"))
    return spark.range(n).select(chain.alias("chain"), address.alias("address"), F.array(F.lit("0xt")).alias("topics"), F.lit("0x").alias("data"), F.when(i != 77, block).alias("block_number"), F.concat(F.lit("0xtx"), i.cast("string")).alias("tx_hash"), F.lit("0x1").alias("log_index"))


def pools(spark, *numbers):
    return spark.createDataFrame([(c, f"0xPOOL{k}", "p", None, None) for c in CHAINS for k in numbers], "chain string, pool string, protocol string, token0 string, token1 string")


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "logs")
    log_store.append_logs(raw(spark), path, span=1000)
    return path


def scan_metrics(df):
    """Files and rows that the first scan of a finished query read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if "Adaptive" in plan.getClass().getSimpleName() else plan
    leaves = plan.collectLeaves()
    stack = [leaves.apply(i) for i in range(leaves.size())]
    while stack:
        node = stack.pop(0)
        if "QueryStage" in node.getClass().getSimpleName():
            inner = node.plan().collectLeaves()
            stack += [inner.apply(i) for i in range(inner.size())]
        elif "FileSourceScan" in node.getClass().getSimpleName():
            value = lambda name, node=node: node.metrics().apply(name).value()
            return value("numFiles"), value("numOutputRows")
    raise AssertionError("no scan")


def test_same_rows_as_the_plain_scan(spark, store):
    want = decoding.scan_logs(raw(spark), pools(spark, 2, 4, 7), 1500, 4200, ["mantle", "ethereum"])
    got = log_store.scan_range(spark, store, pools(spark, 2, 4, 7), 1500, 4200, ["mantle", "ethereum"], span=1000)
    assert got.count() > 0
    assert sorted(r.tx_hash for r in got.collect()) == sorted(r.tx_hash for r in want.collect())
    # the store gives what route and decode take
    assert sorted(r.tx_hash for r in log_store.as_raw(got).select("tx_hash").collect()) == sorted(r.tx_hash for r in want.collect())


def test_many_pools_are_joined_without_a_list(spark, store, monkeypatch):
    monkeypatch.setattr(log_store, "LISTED", 2)
    got = log_store.scan_range(spark, store, pools(spark, 2, 4, 8), 0, 900, CHAINS, span=1000)
    assert got.count() == decoding.scan_logs(raw(spark), pools(spark, 2, 4, 8), 0, 900, CHAINS).count() > 0


def test_plan_pushes_blocks_and_addresses(spark, store):
    df = log_store.scan_range(spark, store, pools(spark, 2), 1500, 4200, ["mantle"], span=1000)
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = next(x for x in plan.split("\n") if "PushedFilters" in x)
    assert "GreaterThanOrEqual(block,1500)" in pushed and "LessThanOrEqual(block,4200)" in pushed and "EqualTo(address,0xpool2)" in pushed
    partitions = next(x for x in plan.split("\n") if "PartitionFilters" in x)
    assert "span" in partitions and "chain" in partitions


def test_files_read_follow_the_range(spark, store):
    files = [scan_metrics(log_store.scan_range(spark, store, pools(spark, 2), 0, last, ["mantle", "ethereum"], span=1000))[0] for last in (999, 3999, 11_999)]
    assert files[0] < files[1] < files[2] and files[0] <= files[2] / 4


def test_bloom_filters_rule_out_addresses(spark, store):
    # odd pools lie between the least and the greatest address of every row group
    scan = lambda address: scan_metrics(log_store.read_logs(spark, store).where(f"chain = 'mantle' and address = '{address}'"))
    assert scan("0xpool3")[1] == 0
    files, rows = scan("0xpool4")
    assert files >= 12 and rows > 0


def test_blocks_are_integers_and_logs_without_one_are_in_no_range(spark, store):
    rows = log_store.read_logs(spark, store)
    assert dict(rows.dtypes)["block"] == "bigint" and rows.where("block is null").count() == 1
    assert rows.where("block = 4001").count() == rows.where("block = 4000").count() == 1
    empty = raw(spark).where("false")
    log_store.append_logs(empty, store, span=1000)
    assert log_store.read_logs(spark, store).count() == 12_000


def test_query_scans_the_store(spark):
    from conftest import SF

    want = decoding.scan_logs(ingestion.raw_logs(spark, SF), ingestion.pools(spark), 20, 70, ["mantle", "ethereum"])
    assert sorted(ingestion.src1_flt4_log_scan(spark, SF).collect()) == sorted(want.select("tx_hash").collect())


def test_span_follows_the_blocks(spark):
    assert log_store.span_for(raw(spark), 1000) == 1000
    many = spark.range(2).select(F.when(F.col("id") == 0, "0x10").otherwise("4000000").alias("block_number"))
    span = log_store.span_for(many, 25)
    assert 4_000_000 // span < log_store.FOLDERS <= 8_000_000 // span
    assert log_store.span_for(many.where("false"), 25) == 25
