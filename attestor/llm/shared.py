"""What the corpus operators share: tables in the shared folder, bounded bitmaps and connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset and there is only this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="attestor-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def steady(spark: SparkSession, rows: int = 1000) -> None:
    """Keeps what Python workers hold at a time small: Arrow batches of at most so many rows, whatever the texts' lengths."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows or int(spark.conf.get(key, "10000")) <= 0:
        spark.conf.set(key, str(rows))


class Workspace:
    """Tables written under the shared folder, so that lineage ends there and a lost executor loses nothing."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: set[str] = set()
        #: The catalogue's names of the tables that are dealt into buckets.
        self.named: dict[str, str] = {}
        steady(spark)

    def keep(self, df: DataFrame, table: str) -> DataFrame:
        path = f"{self.root}/{table}"
        df.write.parquet(path)
        self.tables.add(table)
        # The shuffle files behind a written table go when the driver's garbage is collected; waiting would fill disks.
        self.spark._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_by(self, df: DataFrame, table: str, column: str, buckets: int) -> DataFrame:
        """As keep, dealt into buckets by a column: joins by it move the other side only."""
        name = f"kept_{uuid.uuid4().hex}"
        df.write.option("path", f"{self.root}/{table}").bucketBy(buckets, column).saveAsTable(name, format="parquet")
        self.tables.add(table)
        self.named[table] = name
        self.spark._jvm.System.gc()
        return self.spark.table(name)

    def drop(self, table: str) -> None:
        """Deletes a table that no later plan reads."""
        if table in self.named:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.named.pop(table)}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.tables.discard(table)

    def only(self, *tables: str) -> None:
        """Deletes all tables but these."""
        for table in sorted(self.tables - set(tables)):
            self.drop(table)


def bitmap(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits, however many keys there are, with the bit of each non-negative key's low bits set.

    Only the bitmap itself (at most 2**bits / 8 bytes) reaches the driver. A reader may meet false positives,
    never false negatives, so it can thin out rows ahead of an exact join.
    """
    low = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = (
        keys.select(F.shiftright(low, 5).cast("int").alias("w"), F.expr("1L").alias("one"), low.bitwiseAND(F.lit(31)).cast("int").alias("b"))
        .groupBy("w").agg(F.bit_or(F.expr("shiftleft(one, b)")).alias("m"))
    )
    out = np.zeros(1 << (bits - 5), np.uint32)
    rows = words.toPandas()
    out[rows.w.to_numpy(int)] = rows.m.to_numpy(np.uint64).astype(np.uint32)
    return out


def in_bitmap(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    low = keys.astype(np.uint64) & np.uint64(len(table) * 32 - 1)
    return (table[(low >> np.uint64(5)).astype(np.int64)] >> (low & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0


def with_totals(rows: DataFrame, keys: list[str], spread: str, salts: int = 64, **totals) -> DataFrame:
    """rows with totals over all rows of equal keys, as name=(column, function); keys are not null, functions may be applied twice (min, max, sum).

    No task meets all rows of one key: they are added up in as many shares as the values of the column spread fall into (at most
    salts), the shares' totals are joined back to the shares, and these to the rows. rows should be a written table, as it is read twice.
    """
    shared = rows.withColumn("_share", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    partly = shared.groupBy(*keys, "_share").agg(*(fold(column).alias(name) for name, (column, fold) in totals.items()))
    whole = partly.groupBy(*keys).agg(*(fold(name).alias(name) for name, (_, fold) in totals.items()))
    back = partly.select(*keys, "_share").join(whole, keys)
    return shared.join(back, [*keys, "_share"]).drop("_share")


def _open_nodes(edges: DataFrame) -> int:
    """How many nodes of edges (a, b) keep them from being stars: a node with two larger ends, or one that is both ends."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or up > 0 and down > 0").count()


def components(work: Workspace, edges: DataFrame, name: str = "cc", rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long): a row (id, component) for each end, component the smallest id.

    Alternates large-star and small-star steps, each a groupBy with map-side combining and a join, and writes the
    edges to the shared folder after each round until every edge ends in its component's smallest id. No step gathers a
    component in one place. Raises if so many rounds do not suffice.
    """
    now = work.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}0")
    k = 0
    while _open_nodes(now):
        k += 1
        if k > rounds:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        pair = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(least, "a").select(F.explode(pair).alias("e")).select("e.*")
        now = work.keep(small.where("a <> b").distinct(), f"{name}{k}")
        work.drop(f"{name}{k - 1}")
    ends = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    # The last table stays, because what is returned reads it.
    return ends.union(now.select("b", "b").distinct())
