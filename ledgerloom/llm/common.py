"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch; with documents of a few hundred kB a batch stays under 100 MB.
ARROW_ROWS = 500


def bounded_batches(spark: SparkSession) -> None:
    """Lower Spark's default of 10,000 rows an Arrow batch, which long texts make too large."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the shared folder that the cluster names; a local one only where none is named and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", f"file://{root}")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        root = f"file://{root}"
    folder = f"{root.rstrip('/')}/ledgerloom-{uuid.uuid4().hex}"
    _made.append(folder)
    return folder


_made: list[str] = []


def made() -> int:
    """How many shared folders this process has made, for clear()."""
    return len(_made)


def clear(spark: SparkSession, since: int = 0, keep: str = "") -> None:
    """Remove the shared folders made since then but for one; for when all that was read from them is read or written."""
    for folder in [x for x in _made[since:] if x != keep]:
        remove(spark, folder)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if folder in _made:
        _made.remove(folder)


def staged(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores after it until no column of df has it; column names don't heed case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def identified(df: DataFrame, id_col: str) -> DataFrame:
    """Rows without an id can't be named in a result, so they take no part."""
    return df.filter(F.col(id_col).isNotNull())
