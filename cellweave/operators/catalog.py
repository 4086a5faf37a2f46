"""Catalogue of computed tables: keys, dependencies and exactly-once computation of what is missing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage


def pending(parent: DataFrame, computed: DataFrame, key: list[str]) -> DataFrame:
    """Keys of the parent that are not computed yet; rows with a null key are never pending."""
    return parent.select(*key).dropna().distinct().join(computed.select(*key).distinct(), key, "left_anti")


def insert_ignore(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Existing rows, and of the incoming ones one for each key that is new (the least row, if a key comes twice)."""
    rest = [c for c in incoming.columns if c not in key]
    new = incoming.join(existing.select(*key).distinct(), key, "left_anti").groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, *[F.col(f"_r.`{c}`").alias(c) for c in rest])
    return existing.unionByName(new.select(*existing.columns))


def override(layers: list[DataFrame], key: list[str]) -> DataFrame:
    """One row per key: that of the last layer that has it."""
    columns = layers[0].columns
    rest = [c for c in columns if c not in key]
    marked = None
    for i, layer in enumerate(layers):
        one = layer.select(*columns, F.lit(i).alias("_layer"))
        marked = one if marked is None else marked.unionByName(one)
    best = marked.groupBy(*key).agg(F.max(F.struct("_layer", *rest)).alias("_r"))
    return best.select(*key, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def held(log: DataFrame, key: list[str], now: DataFrame, stale: str, order: list[str]) -> DataFrame:
    """Keys that no worker may take: the last entry of their log (key, status, ts) by ``order`` is an error, is done, or is a reservation not older than ``stale``.

    ``now`` is one row (now). Stale reservations are free again without being deleted.
    """
    last = log.groupBy(*key).agg(F.max_by(F.struct("status", "ts"), F.struct(*order)).alias("l")).select(*key, "l.status", "l.ts")
    fresh = F.col("ts") >= F.col("now") - F.expr(f"INTERVAL {stale}")
    return last.join(now, how="cross").where(F.col("status").isin("error", "done") | fresh).select(*key)


def fetch_one(df: DataFrame, column: str):
    """The value of ``column`` in the only row; anything but one row is an error."""
    rows = df.select(column).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("expected exactly one row")
    return rows[0][0]


@dataclass
class Table:
    name: str
    key: list[str]
    parent: str | None = None
    make: Callable[[DataFrame], DataFrame] | None = None


@dataclass
class Catalog:
    """Tables as Parquet folders under ``root``; a computed table makes rows for keys of its parent."""

    spark: SparkSession
    root: str
    tables: dict[str, Table] = field(default_factory=dict)

    def declare(self, name: str, key: list[str], parent: str | None = None, make: Callable[[DataFrame], DataFrame] | None = None) -> Table:
        if parent is not None and parent not in self.tables:
            raise KeyError(f"unknown parent {parent}")
        self.tables[name] = Table(name, key, parent, make)
        return self.tables[name]

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def insert(self, name: str, rows: DataFrame) -> None:
        """Append rows whose keys are new."""
        key = self.tables[name].key
        new = rows if not self.exists(name) else rows.join(self.read(name).select(*key), key, "left_anti")
        stage(new.dropDuplicates(key), "insert").write.mode("append").parquet(self.path(name))

    def populate(self, name: str) -> int:
        """Make what is missing of a computed table, in one job over all pending keys, and append it; the number of keys made.

        The rows are written to the shared folder first and appended as a whole: a failed or repeated call leaves nothing
        twice.
        """
        t = self.tables[name]
        parent = self.read(t.parent)
        todo = parent.select(*t.key).dropna().distinct() if not self.exists(name) else pending(parent, self.read(name), t.key)
        todo = stage(todo, "pending")
        made = stage(t.make(parent.join(todo, t.key, "left_semi")), "made")
        made.write.mode("append").parquet(self.path(name))
        return todo.count()

    def size(self, name: str) -> int:
        """Bytes of a table on disk."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(hadoop).getLength()

    def drop(self, name: str) -> None:
        """Remove a table and its declaration; one that another is computed from is refused."""
        if any(t.parent == name for t in self.tables.values()):
            raise ValueError(f"{name} is the parent of another table")
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        del self.tables[name]

    def delete(self, name: str, keys: DataFrame) -> None:
        """Remove the rows of the given keys; the rest is written anew and put in the old one's place."""
        rest = stage(self.read(name).join(keys.select(*self.tables[name].key).distinct(), self.tables[name].key, "left_anti"), "rest")
        rest.write.mode("overwrite").parquet(self.path(name))
