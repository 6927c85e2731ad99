"""Keyed tables on Parquet that can be merged into and deleted from without a rewrite of all of them.

A table lies in one folder for each hash bucket of its keys. A merge or delete finds the buckets that it touches, reads and
rewrites those, and replaces their folders (dynamic partition overwrite); the files of all others stay as they are. Conditions
reach the Parquet scan, those that fix all keys also leave out the other buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import once

BUCKET = "_bucket"


@dataclass(frozen=True)
class KeyedTable:
    """path, the key columns with their types, and the number of buckets, which must stay what it was when the table was made."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    buckets: int = 256

    def _bucket(self, *values: Column) -> Column:
        return F.pmod(F.xxhash64(*(values or map(F.col, self.keys))), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def _put(self, rows: DataFrame) -> None:
        # Each bucket is written by one task, which holds one bucket's share of the rows that changed.
        rows.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(BUCKET).distinct().collect())  # at most as many as there are buckets

    def create(self, rows: DataFrame) -> None:
        """Writes rows in place of whatever lies at the path."""
        if BUCKET in rows.columns:
            raise ValueError(f"no column may be named {BUCKET}")
        rows.withColumn(BUCKET, self._bucket()).repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(BUCKET).parquet(self.path)

    def read(self) -> DataFrame:
        return self._rows().drop(BUCKET)

    def at(self, **values) -> DataFrame:
        """Rows of one key; only its bucket is read."""
        types = dict(self._rows().dtypes)
        own = [F.lit(values[k]).cast(types[k]) for k in self.keys]
        rows = self._rows().where(F.col(BUCKET) == self._bucket(*own))
        for k, v in zip(self.keys, own, strict=True):
            rows = rows.where(F.col(k).eqNullSafe(v))
        return rows.drop(BUCKET)

    def merge(self, rows: DataFrame, newest: str | None = None) -> list[int]:
        """Puts rows in place of those with the same keys (null keys are equal) and adds the others. Returns the buckets that were written.

        Of rows with one key the one with the greatest `newest` is taken, else one of them, by the order of their columns.
        """
        columns = self.read().columns
        by = Window.partitionBy(*self.keys).orderBy(*([F.col(newest).desc_nulls_last()] if newest else []), *(c for c in columns if c not in self.keys and c != newest))
        one = rows.select(*columns).withColumn("_place", F.row_number().over(by)).where("_place = 1").drop("_place") if len(columns) > len(self.keys) else rows.select(*columns).distinct()
        fresh = once(one.withColumn(BUCKET, self._bucket()))
        touched = self._touched(fresh)
        if touched:
            old = self._rows().where(F.col(BUCKET).isin(touched)).alias("old")
            same = F.col(f"old.{BUCKET}") == F.col(f"new.{BUCKET}")
            for k in self.keys:
                same = same & F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}"))
            kept = old.join(fresh.select(*self.keys, BUCKET).alias("new"), same, "left_anti")
            self._put(kept.select(*columns, BUCKET).unionByName(fresh))
        return touched

    def delete(self, condition: Column) -> list[int]:
        """Deletes the rows for which the condition is true (not those where it is null). Returns the buckets that were written."""
        touched = self._touched(self._rows().where(condition))
        if touched:
            rows = self._rows().where(F.col(BUCKET).isin(touched))
            left = once(rows.where(~F.coalesce(condition, F.lit(False))))
            held = self._touched(left)
            if held:
                self._put(left)
            # Nothing is left to replace these buckets' files with, so an empty file does.
            for k in sorted(set(touched) - set(held)):
                left.limit(0).drop(BUCKET).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{self.path}/{BUCKET}={k}")
        return touched
