"""One snapshot delivery at a time: probe the bucketed index, report, swap."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshots import probe


class SnapshotIndex:
    """The key-to-hash index of a table's last snapshot, as a bucketed table at ``path``.

    A delivery of full rows is hashed, written as the next index in the same buckets and
    joined with the last one without moving it; old values are read for keys with a
    differing hash only. :meth:`apply` then points to the new index. The pointer is
    written last, so a broken delivery leaves the last index in place.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _pointer(self) -> str:
        return f"{self.path}/current"

    def version(self) -> int:
        """The current version, 0 before the first delivery."""
        try:
            rows = self.spark.read.parquet(self._pointer()).agg(F.max("version")).first()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return 0
            raise
        return rows[0] or 0

    def _name(self, version: int) -> str:
        return f"snapshot_{md5(self.path.encode()).hexdigest()[:12]}_{version}"

    def _table(self, version: int) -> DataFrame:
        name = self._name(version)
        if not self.spark.catalog.tableExists(name):
            where = f"{self.path}/v{version}"
            ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(where).schema)
            self.spark.sql(f"CREATE TABLE {name} ({ddl}) USING parquet CLUSTERED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{where}'")
        return self.spark.table(name)

    def apply(self, snapshot: DataFrame) -> DataFrame:
        """(key, change_kind, old, new) against the last snapshot, and the new index in its place.

        Rows with a null key are left out; of rows with one key the smallest stands. ``old``
        and ``new`` are the other columns as structs, null where the key is absent.
        """
        last = self.version()
        values = [c for c in snapshot.columns if c != self.key]
        v = F.struct(*(F.col(f"`{c}`") for c in values))
        rows = snapshot.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.min(v).alias("v"))
        indexed = rows.select(self.key, F.xxhash64(F.to_json("v")).alias("h"), "v")
        name = self._name(last + 1)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        writer = indexed.repartition(self.buckets, self.key).write.format("parquet").mode("overwrite").option("path", f"{self.path}/v{last + 1}")
        writer.bucketBy(self.buckets, self.key).saveAsTable(name)
        new = self.spark.table(name)
        pointer = self.spark.createDataFrame([(last + 1,)], "version int")
        if last == 0:
            pointer.write.mode("append").parquet(self._pointer())
            return new.select(self.key, F.lit("added").alias("change_kind"), F.lit(None).cast(new.schema["v"].dataType).alias("old"), F.col("v").alias("new"))
        old = self._table(last)
        hit = probe(new.select(self.key, "h"), old.select(self.key, "h"), [self.key])
        kind = F.when(F.col("old_h").isNull(), "added").when(F.col("new_h").isNull(), "removed").otherwise("changed")
        found = hit.select(self.key, kind.alias("change_kind"))
        out = found.join(old.select(self.key, F.col("v").alias("old")), self.key, "left").join(new.select(self.key, F.col("v").alias("new")), self.key, "left")
        pointer.write.mode("append").parquet(self._pointer())
        return out
