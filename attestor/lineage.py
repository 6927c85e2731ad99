"""Results that several later steps read, computed once, and where they lie."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A folder of this machine is used only where none is named, as in tests."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="attestor-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def once(rows: DataFrame) -> DataFrame:
    """rows, written to the shared folder and read from there by all that follows.

    Without it the plan of an operator whose steps each use the ones before would repeat them many times over.
    """
    if rows.sparkSession.sparkContext.getCheckpointDir() is None:
        rows.sparkSession.sparkContext.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint()


class Shelf:
    """What the steps of one piece of work read more than once, as Parquet in the shared folder, until the work is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.tables = spark, f"{shared_folder(spark)}/shelf-{uuid.uuid4().hex}", 0

    def once(self, rows: DataFrame) -> DataFrame:
        """As once, but compressed, and read by columns."""
        self.tables += 1
        path = f"{self.root}/{self.tables}"
        rows.write.parquet(path)
        # The shuffle files behind a written table go when the driver's garbage is collected; waiting would fill disks.
        self.spark._jvm.System.gc()
        return self.spark.read.schema(rows.schema).parquet(path)

    def clear(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.spark._jvm.System.gc()


#: Rows of a share, and the most shares.
EACH, MOST = 1 << 17, 8


def in_shares(rows: DataFrame, key: str, work: Callable[[DataFrame, Callable[[DataFrame], DataFrame]], DataFrame]) -> DataFrame:
    """work(share, once) of all rows, one share of the keys after another, so that what a share needs on disk is gone before the next.

    Rows of one key are in one share; work must not depend on those of other keys.
    """
    n = min(MOST, max(1, -(-rows.count() // EACH)))
    found, made = Shelf(rows.sparkSession), []
    for k in range(n):
        shelf = Shelf(rows.sparkSession)
        made.append(found.once(work(rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == k) if n > 1 else rows, shelf.once)))
        shelf.clear()
    return reduce(DataFrame.unionByName, made)
