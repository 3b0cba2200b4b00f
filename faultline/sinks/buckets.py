"""A table in buckets of its keys, of which a change rewrites only those it touches.

``path/data-*`` holds the rows by bucket, one folder per rewrite; ``path/manifests/<version>`` lists which folder each
bucket is read from. A change reads the buckets its keys fall into, writes them anew beside the old ones and lists them in
the next manifest, last of all; until then readers see the version before, and a job that dies leaves the table as it was.
Versions stay readable until ``forget`` removes them. Of two writers that start from one version only the first succeeds.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from faultline.sinks import tables

BUCKET = "bucket_no"
_MANIFEST = "kind string, bucket int, text string"


def _names(spark: SparkSession, pattern: str) -> list[str]:
    """Full names of the files and folders that fit a pattern."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return sorted(str(f.getPath().toString()) for f in found or [])


class BucketTable:
    """The table at ``path``; make one with ``create``, open one with its path alone."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: Sequence[str], buckets: int = 64) -> BucketTable:
        """Version 0: ``rows`` in buckets by ``keys``. The number of buckets stays; take it so that one is a few files' worth."""
        if not keys or buckets < 1:
            raise ValueError("keys and at least one bucket are needed")
        if BUCKET in rows.columns:
            raise ValueError(f"{BUCKET} is the name of the table's own column")
        table = cls(rows.sparkSession, path)
        about = [("schema", None, rows.schema.json()), ("buckets", buckets, None), *[("key", i, k) for i, k in enumerate(keys)]]
        table._commit(0, about, table._write(rows, keys, buckets), "errorifexists")
        return table

    def versions(self) -> list[int]:
        return [int(n.rsplit("/", 2)[-2]) for n in _names(self.spark, f"{self.path}/manifests/*/_SUCCESS")]

    def _manifest(self, version: int | None) -> tuple[int, list, dict[int, str]]:
        """Number, the rows about the table, and the folder of each bucket that has rows: at most one row a bucket."""
        there = self.versions()
        if not there or (version is not None and version not in there):
            raise ValueError(f"{self.path} has no version {'' if version is None else version}".rstrip())
        at = there[-1] if version is None else version
        lines = [tuple(r) for r in self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifests/{at:010d}").collect()]
        return at, [r for r in lines if r[0] != "folder"], {r[1]: r[2] for r in lines if r[0] == "folder"}

    @staticmethod
    def _about(about: list) -> tuple[T.StructType, list[str], int]:
        at = {kind: (number, text) for kind, number, text in about if kind != "key"}
        keys = [text for _, _, text in sorted(r for r in about if r[0] == "key")]
        return T.StructType.fromJson(json.loads(at["schema"][1])), keys, at["buckets"][0]

    @staticmethod
    def _bucket(keys: Sequence[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, keys: Sequence[str], buckets: int) -> dict[int, str]:
        """Rows to a new folder; a heavy bucket is written by several tasks, small ones by one."""
        folder = f"{self.path}/data-{uuid.uuid4().hex}"
        rows.withColumn(BUCKET, self._bucket(keys, buckets)).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(folder)
        return {int(n.rsplit("=", 1)[1]): n for n in _names(self.spark, f"{folder}/{BUCKET}=*")}

    def _commit(self, version: int, about: list, folders: dict[int, str], mode: str) -> None:
        lines = [*about, *[("folder", b, f) for b, f in sorted(folders.items())]]
        self.spark.createDataFrame(lines, _MANIFEST).coalesce(1).write.mode(mode).parquet(f"{self.path}/manifests/{version:010d}")

    def _rows(self, schema: T.StructType, folders: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the newest by default."""
        _, about, folders = self._manifest(version)
        return self._rows(self._about(about)[0], list(folders.values()))

    def like(self, rows: DataFrame, version: int | None = None) -> DataFrame:
        """``rows`` with those columns cast that the table has too, so that equal keys fall into one bucket."""
        types = {f.name: f.dataType for f in self._about(self._manifest(version)[1])[0].fields}
        return rows.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in rows.columns])

    def _touched(self, changes: DataFrame, keys: Sequence[str], buckets: int) -> list[int]:
        return [r[0] for r in changes.select(self._bucket(keys, buckets).alias("b")).distinct().collect()]

    def near(self, changes: DataFrame, version: int | None = None) -> DataFrame:
        """Rows of the buckets that the keys of ``changes`` fall into; nothing else is read."""
        _, about, folders = self._manifest(version)
        schema, keys, buckets = self._about(about)
        hit = self._touched(self.like(changes, version), keys, buckets)
        return self._rows(schema, [folders[b] for b in hit if b in folders])

    def apply(self, changes: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], version: int | None = None) -> int:
        """The next version: ``change(rows, changes)`` in place of the rows of the touched buckets. It must keep every
        row in its bucket. Without changes nothing is written. ``version`` says which one is changed: the one after it is
        replaced if it is there, so a step that is run again does not count twice. Gives the new version's number."""
        at, about, folders = self._manifest(version)
        schema, keys, buckets = self._about(about)
        changes = self.like(changes, at)
        hit = self._touched(changes, keys, buckets)
        old = self._rows(schema, [folders[b] for b in hit if b in folders])
        new = self._write(change(old, changes).select(*schema.names), keys, buckets) if hit else {}
        if set(new) - set(hit):
            raise ValueError("a change moved rows into other buckets")
        kept = {b: f for b, f in folders.items() if b not in set(hit)}
        self._commit(at + 1, about, kept | new, "errorifexists" if version is None else "overwrite")
        return at + 1

    def upsert(self, changes: DataFrame, newest: str, ties: Sequence[str] = ()) -> int:
        """The newest row of each key stays; a change beats a row of the same age."""
        keys = self._about(self._manifest(None)[1])[1]
        return self.apply(changes, lambda old, new: tables.upserted(old, new, keys, newest, ties))

    def replace_children(self, new: DataFrame) -> int:
        """Rows whose key, the parent, is in ``new`` are replaced by those of ``new``."""
        [parent] = self._about(self._manifest(None)[1])[1]
        return self.apply(new, lambda old, rows: tables.children_replaced(old, rows, parent))

    def soft_delete(self, corrections: DataFrame, match: Sequence[str], flag: str = "manual_delete") -> int:
        """Sets the flag on the rows that agree with a correction in ``match``, which includes the table's keys."""
        return self.apply(corrections, lambda old, rows: tables.soft_deleted(old, rows, match, flag))

    def forget(self, keep: int) -> None:
        """Only the newest ``keep`` versions stay; folders of buckets that none of them lists go. Readers of older versions
        must have ended. Folders of jobs that died before their manifest are not known and stay."""
        if keep < 1:
            raise ValueError("at least one version stays")
        there = self.versions()
        gone, stay = there[:-keep], there[-keep:]
        needed = {f for v in stay for f in self._manifest(v)[2].values()}
        for v in gone:
            unused = set(self._manifest(v)[2].values()) - needed
            for name in [f"{self.path}/manifests/{v:010d}", *sorted(unused)]:
                hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
                hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
