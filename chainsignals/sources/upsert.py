"""Streams into a database table so that each batch counts once, whatever fails.

A batch is written to a staging table by all tasks; one transaction then merges it into
the target by key and notes the batch in a ledger.  A batch that failed on the way has
changed nothing, one that is repeated after its commit is in the ledger and is left out.
The rows never pass through the driver, only the statements do.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "batch_ledger"


@contextmanager
def transaction(spark: SparkSession, url: str, driver: str | None = None) -> Iterator[object]:
    """A connection whose statements are committed together, or not at all."""
    jvm = spark.sparkContext._jvm
    if driver:
        jvm.java.lang.Class.forName(driver)
    connection = jvm.java.sql.DriverManager.getConnection(url)
    try:
        connection.setAutoCommit(False)
        yield connection
        connection.commit()
    except BaseException:
        connection.rollback()
        raise
    finally:
        connection.close()


def _run(connection, sql: str, *values: object) -> None:
    statement = connection.prepareStatement(sql)
    for i, value in enumerate(values, start=1):
        statement.setObject(i, value)
    statement.executeUpdate()
    statement.close()


def _exists(connection, table: str) -> bool:
    found = connection.getMetaData().getTables(None, None, table, None)
    there = found.next()
    found.close()
    return there


def committed(connection, stream: str) -> int:
    """The newest batch of a stream in the ledger, -1 if there is none."""
    if not _exists(connection, LEDGER):
        _run(connection, f'CREATE TABLE "{LEDGER}" ("stream" VARCHAR(200) PRIMARY KEY, "batch" BIGINT)')
    statement = connection.prepareStatement(f'SELECT "batch" FROM "{LEDGER}" WHERE "stream" = ?')
    statement.setString(1, stream)
    found = statement.executeQuery()
    newest = found.getLong(1) if found.next() else -1
    statement.close()
    return newest


def _merge_sql(table: str, staging: str, columns: list[str], key: tuple[str, ...]) -> str:
    same = " AND ".join(f't."{c}" = s."{c}"' for c in key)
    changed = ", ".join(f'"{c}" = s."{c}"' for c in columns if c not in key)
    names, values = ", ".join(f'"{c}"' for c in columns), ", ".join(f's."{c}"' for c in columns)
    update = f"WHEN MATCHED THEN UPDATE SET {changed} " if changed else ""
    return f'MERGE INTO "{table}" t USING "{staging}" s ON {same} {update}WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({values})'


def upsert_batch(rows: DataFrame, number: int, stream: str, url: str, table: str, key: tuple[str, ...], newest: str | None = None, driver: str | None = None, **options: str) -> bool:
    """Merge one batch into ``table``; False if the ledger has it already.

    Of rows that share a key, which may not be null, that with the greatest ``newest``
    stays, or any one.  The first batch creates the table if it is not there; options are
    those of the JDBC writer.
    """
    spark = rows.sparkSession
    with transaction(spark, url, driver) as connection:
        if committed(connection, stream) >= number:
            return False
    order = F.struct(*dict.fromkeys([*([newest] if newest else []), *rows.columns]))
    once = rows.groupBy(*key).agg(F.max(order).alias("x")).select(*[F.col("x")[c].alias(c) for c in rows.columns])
    staging = f"{table}_{stream}_staging"
    properties = {**options, **({"driver": driver} if driver else {})}
    # not part of the transaction: a batch that fails here leaves the target as it was
    once.write.jdbc(url, f'"{staging}"', mode="overwrite", properties=properties)
    with transaction(spark, url, driver) as connection:
        if not _exists(connection, table):
            _run(connection, f'CREATE TABLE "{table}" AS SELECT * FROM "{staging}" WITH NO DATA')
        _run(connection, _merge_sql(table, staging, rows.columns, key))
        if committed(connection, stream) < 0:
            _run(connection, f'INSERT INTO "{LEDGER}" VALUES (?, ?)', stream, number)
        else:
            _run(connection, f'UPDATE "{LEDGER}" SET "batch" = ? WHERE "stream" = ?', number, stream)
    return True


def upsert_stream(rows: DataFrame, stream: str, url: str, table: str, key: tuple[str, ...], checkpoint: str, newest: str | None = None, driver: str | None = None, trigger: dict | None = None, **options: str):
    """A stream whose batches are merged into a table by key, each once."""

    def write(batch: DataFrame, number: int) -> None:
        upsert_batch(batch, number, stream, url, table, key, newest, driver, **options)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
