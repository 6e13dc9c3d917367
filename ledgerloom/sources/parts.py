"""A table in parts by tenant and row, so that a change rewrites the parts it touches and leaves the files of all others.

The part of a row is a number from the hashes of its tenant and its id: a large tenant is many parts, and a tenant's rows are
in `rows` of them at most. Changes read the touched parts alone and write them by dynamic partition overwrite, one task a
part, so choose their numbers such that a part fits a task. Every change may be run again with the same result,
as a job that is cut may have changed some of its parts; one change of a table runs at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ledgerloom.operators import ledger

_PART = "_part"


@dataclass(frozen=True)
class Parts:
    """Where a table lies, what it has, and how it is parted; without an id a tenant is one part."""

    path: str
    schema: StructType
    tenant: str = "user_id"
    id: str | None = "id"
    tenants: int = 64
    rows: int = 16

    def place(self) -> Column:
        row = F.pmod(F.xxhash64(self.id), F.lit(self.rows)) if self.id else F.lit(0)
        return (F.pmod(F.xxhash64(self.tenant), F.lit(self.tenants)) * self.rows + row).cast("int")

    def write(self, df: DataFrame, mode: str) -> None:
        df.select(self.schema.names).withColumn(_PART, self.place()).repartition(_PART).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(_PART).parquet(self.path)

    def _read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(StructType([*self.schema.fields, StructField(_PART, IntegerType())])).parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._read(spark).drop(_PART)


def stored(df: DataFrame, path: str, **parted) -> Parts:
    """df written to a new table."""
    out = Parts(path, df.schema, **parted)
    out.write(df, "error")
    return out


def rewrite(table: Parts, spark: SparkSession, touched: list[int], change: Callable[[DataFrame], DataFrame]) -> None:
    """Replace the rows of the touched parts by what change makes of them; rows must stay in these parts."""
    if touched:
        table.write(change(table._read(spark).filter(F.col(_PART).isin(touched)).drop(_PART)), "overwrite")


def _touched(table: Parts, df: DataFrame) -> list[int]:
    return sorted(r[0] for r in df.select(table.place()).distinct().collect())  # at most tenants * rows numbers


def patch(table: Parts, changes: DataFrame) -> None:
    """Apply changes (tenant, id, set) as `ledger.patch` does."""
    rewrite(table, changes.sparkSession, _touched(table, changes), lambda held: ledger.patch(held, changes))


def upsert_latest(table: Parts, incoming: DataFrame, keys: list[str], at: str) -> None:
    """One row a key, the latest; keys hold the tenant, and the id if the table has one."""
    rewrite(table, incoming.sparkSession, _touched(table, incoming), lambda held: ledger.upsert_latest(held, incoming.select(table.schema.names), keys, at))


def remove_tenant(table: Parts, spark: SparkSession, tenant) -> None:
    """Remove a tenant's rows; a part in which no other has rows goes as a folder, as nothing would overwrite it."""
    one = spark.range(1).select(F.lit(tenant).cast(table.schema[table.tenant].dataType).alias(table.tenant))
    first = Parts(table.path, table.schema, table.tenant, None, table.tenants, table.rows)
    begin = one.select(first.place()).first()[0]
    touched = list(range(begin, begin + table.rows))
    others = ~F.col(table.tenant).eqNullSafe(F.lit(tenant))
    left = table._read(spark).filter(F.col(_PART).isin(touched) & others)
    shared = sorted(r[0] for r in left.select(_PART).distinct().collect())  # at most `rows` numbers
    rewrite(table, spark, shared, lambda held: held.filter(others))
    for part in set(touched) - set(shared):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{table.path}/{_PART}={part}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
