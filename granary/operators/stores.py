"""Keyed tables that are written in place: only the buckets that new rows touch are read and written again.

A store is a folder of versions. Rows lie in hash buckets of their key; a version is a manifest, a small Parquet table that
names for each bucket the folder its rows are in. A write lands the touched buckets' rows in folders of their own and then
puts the next manifest in place by one rename, which fails if another writer has put one there since. So readers always see
one whole version, a write that fails leaves nothing but folders that no manifest names, and untouched files keep their
names. What the driver holds is the manifest: a line for each bucket.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from granary.operators import sinks

MANIFEST = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("folder", T.StringType())])


class Conflict(RuntimeError):
    """Another writer has written the next version."""


class Store:
    """A table at `path`, keyed by some of its columns, whose rows with equal keys share a bucket.

    Rows with a null in a key are of no key; they share buckets like others and are only ever added. A store is made by
    create(); its columns, keys and number of buckets stay what they were then.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        about = spark.read.parquet(f"{self.path}/about").first()
        self.keys, self.buckets, self.schema = list(about["keys"]), about["buckets"], T.StructType.fromJson(json.loads(about["columns"]))

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = 64) -> Store:
        """An empty store; FileExistsError where there is one."""
        if missing := [k for k in keys if k not in schema.names]:
            raise ValueError(f"no such columns: {missing}")
        fs, at = _files(spark, path)
        if fs.exists(at(f"{path.rstrip('/')}/about")):
            raise FileExistsError(path)
        about = [(keys, buckets, schema.json())]
        spark.createDataFrame(about, "keys array<string>, buckets int, columns string").coalesce(1).write.parquet(f"{path.rstrip('/')}/about")
        return cls(spark, path)

    # --- versions ---

    def version(self) -> int:
        """The latest version; 0 before the first write."""
        fs, at = _files(self.spark, self.path)
        folder = at(f"{self.path}/versions")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _manifest(self, version: int) -> dict[int, str]:
        return dict(map(tuple, self.spark.read.schema(MANIFEST).parquet(f"{self.path}/versions/{version}").collect())) if version else {}

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{f}" for f in sorted(folders))) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, by default the latest."""
        return self._read(list(set(self._manifest(self.version() if version is None else version).values())))

    # --- writes ---

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def write(self, new: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], base: int | None = None) -> int:
        """Puts change(old rows of the touched buckets, new) in their place and returns the new version.

        new must have the store's keys; `base` is the version that the writer has seen, by default the latest. Rows that
        `change` gives must be of touched buckets. With no new row nothing is written.
        """
        base = self.version() if base is None else base
        before, run = self._manifest(base), uuid.uuid4().hex
        touched = [r["b"] for r in new.select(self.bucket().alias("b")).distinct().collect()]  # at most `buckets`
        if not touched:
            return base
        rows = change(self._read(list({before[b] for b in touched if b in before})), new)
        names = self.schema.names
        shaped = rows.select(*(F.col(c).cast(self.schema[c].dataType) if c in rows.columns else F.lit(None).cast(self.schema[c].dataType).alias(c) for c in names)).withColumn("__bucket", self.bucket())
        shaped.repartition(min(len(touched), int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/data/{run}")
        fs, at = _files(self.spark, self.path)
        kept = {f.getPath().getName() for f in fs.listStatus(at(f"{self.path}/data/{run}")) if f.isDirectory()}
        if strange := kept - {f"__bucket={b}" for b in touched}:
            raise ValueError(f"a change made rows of buckets that no new row is in: {sorted(strange)}")
        after = {b: f for b, f in before.items() if b not in touched} | {b: f"{run}/__bucket={b}" for b in touched if f"__bucket={b}" in kept}
        made = f"{self.path}/drafts/{run}"
        self.spark.createDataFrame(sorted(after.items()), MANIFEST).coalesce(1).write.parquet(made)
        self._put(made, base + 1)
        return base + 1

    def _put(self, made: str, version: int) -> None:
        """Renames a draft to the next version; a version that is there already is another writer's."""
        fs, at = _files(self.spark, self.path)
        target = at(f"{self.path}/versions/{version}")
        fs.mkdirs(at(f"{self.path}/versions"))
        claim = at(f"{self.path}/versions/_claim-{version}")  # of two writers only one creates this file
        try:
            fs.create(claim, False).close()
        except Exception as there:
            raise Conflict(f"version {version} of {self.path} was written by another writer") from there
        if fs.exists(target) or not fs.rename(at(made), target):
            raise Conflict(f"version {version} of {self.path} was written by another writer")

    def upsert(self, new: DataFrame, latest: str = "__nth", base: int | None = None) -> int:
        """New rows win by key; see sinks.upsert()."""
        return self.write(new, lambda old, rows: sinks.upsert(old, rows, self.keys, latest), base)

    def merge_columns(self, new: DataFrame, base: int | None = None) -> int:
        """Upsert of the columns that new has; see sinks.merge_columns()."""
        return self.write(new, lambda old, rows: sinks.merge_columns(old, rows, self.keys), base)

    def replace(self, new: DataFrame, base: int | None = None) -> int:
        """Every series (key) that new has is replaced as a whole; see sinks.replace_series()."""
        return self.write(new, lambda old, rows: sinks.replace_series(old, rows, self.keys), base)

    def delete(self, keys: DataFrame, base: int | None = None) -> int:
        """Rows of these keys go."""
        return self.write(keys.select(*self.keys), lambda old, rows: sinks.delete_by(old, rows), base)

    def vacuum(self) -> int:
        """Deletes folders of rows that the latest version doesn't name, and what a writer left that died before its version
        was in place, so that others can go on. No writer may be at work. Returns how many folders."""
        fs, at = _files(self.spark, self.path)
        latest = self.version()
        fs.delete(at(f"{self.path}/versions/_claim-{latest + 1}"), False)
        used, gone = set(self._manifest(latest).values()), 0
        data = at(f"{self.path}/data")
        for run in fs.listStatus(data) if fs.exists(data) else []:
            for folder in fs.listStatus(run.getPath()):
                name = f"{run.getPath().getName()}/{folder.getPath().getName()}"
                if folder.isDirectory() and name not in used:
                    gone += bool(fs.delete(folder.getPath(), True))
        return gone


def _files(spark: SparkSession, path: str):
    """The file system of a path, and what makes a path of a text."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at
