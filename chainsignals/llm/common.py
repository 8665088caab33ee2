"""Pieces that several operators share: scratch tables, table reading, row identity."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``, the folder that driver and executors share.

    A folder of one machine's own would lose what executors on other machines write, so
    a session without that setting is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str = "zstd", **options: object) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    return _stored(df, shared_path(df.sparkSession, name), codec, options)


def _stored(df: DataFrame, path: str, codec: str, options: dict) -> DataFrame:
    df.write.option("compression", codec).options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that only one run of an operator needs; ``scratch`` removes them after it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def table(self, df: DataFrame, name: str, codec: str = "zstd", **options: object) -> DataFrame:
        """As ``materialize``, until the scope ends; ``df`` may only be read within it."""
        self.paths.append(shared_path(self.spark, name))
        return _stored(df, self.paths[-1], codec, options)

    def drop(self, last: int = 0) -> None:
        """Remove all tables but the ``last`` ones."""
        gone, self.paths = self.paths[: len(self.paths) - last], self.paths[len(self.paths) - last :]
        jvm = self.spark.sparkContext._jvm
        for path in gone:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    tables = Scratch(spark)
    try:
        yield tables
    finally:
        tables.drop()


@contextmanager
def small_batches(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """Arrow batches of ``most`` bytes for what runs inside; the session's own setting comes back.

    Whole texts can be long, and a batch is held several times over by an executor and
    its Python worker.
    """
    before = spark.conf.get(_BATCH)
    lower_batches(spark, most)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def lower_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """As ``small_batches``, but for good: for lazy results that send whole texts when they are read."""
    now = spark.conf.get(_BATCH).lower().removesuffix("b")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(_BATCH, str(most))


def fresh(name: str, *taken: Iterable[str]) -> str:
    """``name``, with underscores added while a column of ``taken`` has it (in any case of letters)."""
    used = {c.lower() for columns in taken for c in columns}
    while name.lower() in used:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of ``df`` by name, whatever signs the names hold."""
    return [quoted(c) for c in df.columns]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str = "text") -> Column:
    """The whole text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")
