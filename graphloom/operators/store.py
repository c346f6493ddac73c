"""Keyed tables that keep what is written (rows C1-C4, M1-M5, S3, S4).

A table lies in a folder that all machines share. Its rows are dealt to buckets
by a hash of their key. A write reads and rewrites only the buckets that its
rows fall into, in a folder of its own, and then puts one manifest beside the
earlier ones: it names, for each bucket, the commit that holds it. A manifest is
created or the write fails, so readers see a whole commit or none, and of two
writers at once one fails. Streams leave the number of their last batch in the
manifest, so a batch that is delivered again changes nothing, and a stream may
begin at any number.

Of several rows of one key the one with the largest version stays; of equal
versions a new row wins over a stored one, and among new ones that with the
largest hash, so that repeats give the same table.

Defined results: null keys are keys like others; rows with a null version lose
to all others; columns that a row set lacks become null, columns that the table
lacks are an error; writing an empty row set makes no commit.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The satellite tables of the graph: columns, key and version of each (names and columns are fixed values).
SATELLITES: dict[str, tuple[str, list[str], str]] = {
    "annotations": ("element_qualified string, description string, user_story_id string, feature_id string, updated_at long", ["element_qualified"], "updated_at"),
    "knowledge": ("id string, title string, content string, kind string, branch string, env string, updated_at long", ["id"], "updated_at"),
    "features": ("element_qualified string, feature_id string, updated_at long", ["element_qualified", "feature_id"], "updated_at"),
    "incidents": ("id string, env string, title string, severity string, occurred_at long, resolved_at long, root_cause string, resolution string, affected_services array<string>, author string, updated_at long", ["id"], "updated_at"),
    "service_metadata": ("service string, env string, version string, team string, metadata string, updated_at long", ["service", "env"], "updated_at"),
    "embedding_state": ("qualified_name string, content_hash string, state string, embedded_at long, updated_at long", ["qualified_name"], "updated_at"),
}


class _Files:
    """The files of a folder, through Spark's own file systems."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [x.getPath().getName() for x in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Write a new file; an error if there is one."""
        stream = self.fs.create(self.path(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


@dataclass(frozen=True)
class Manifest:
    number: int
    schema: str  # of the rows, as JSON
    keys: list[str]
    version: str
    buckets: int
    held: dict[str, str] = field(default_factory=dict)  # bucket -> commit
    streams: dict[str, int] = field(default_factory=dict)  # stream -> its last batch


class KeyedTable:
    """A stored table; every write is one commit."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.files = spark, path.rstrip("/"), _Files(spark, path)

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: str | StructType, keys: Sequence[str], version: str, buckets: int = 64) -> KeyedTable:
        table = cls(spark, path)
        kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        table._publish(Manifest(0, kind.json(), list(keys), version, buckets))
        return table

    @classmethod
    def satellite(cls, spark: SparkSession, path: str, name: str, buckets: int = 64) -> KeyedTable:
        """The satellite table of that name in ``path``, made if there is none."""
        table = cls(spark, f"{path.rstrip('/')}/{name}")
        return table if table.files.names("manifests") else cls.create(spark, table.path, *SATELLITES[name], buckets=buckets)

    def _publish(self, m: Manifest) -> None:
        self.files.create(f"manifests/{m.number:010d}.json", json.dumps(m.__dict__))

    def manifest(self, number: int | None = None) -> Manifest:
        """The newest manifest, or an earlier one."""
        if number is None:
            number = max(int(n.split(".")[0]) for n in self.files.names("manifests") if n.endswith(".json"))
        return Manifest(**json.loads(self.files.read(f"manifests/{number:010d}.json")))

    def _rows(self, m: Manifest, buckets: Sequence[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(m.schema))
        paths = [f"{self.path}/commits/{commit}/bucket={b}" for b, commit in m.held.items() if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, number: int | None = None) -> DataFrame:
        """The table as of its newest commit, or as of an earlier one."""
        return self._rows(self.manifest(number))

    def _bucket(self, m: Manifest) -> Column:
        return F.pmod(F.xxhash64(*m.keys), F.lit(m.buckets)).cast("int")

    def get(self, **key: object) -> DataFrame:
        """The rows of one key; only its bucket is read."""
        m = self.manifest()
        if set(key) != set(m.keys):
            raise ValueError(f"the key is {m.keys}")
        kinds = {f.name: f.dataType for f in StructType.fromJson(json.loads(m.schema))}
        one = self.spark.range(1).select(*(F.lit(key[k]).cast(kinds[k]).alias(k) for k in m.keys))
        bucket = str(one.select(self._bucket(m)).first()[0])
        return self._rows(m, [bucket]).where(_all(F.col(k).eqNullSafe(F.lit(key[k]).cast(kinds[k])) for k in m.keys))

    def upsert(self, rows: DataFrame, stream: str | None = None, batch: int | None = None) -> bool:
        """Rows replace those of their keys unless these have a larger version; False if there was nothing to write."""
        m = self.manifest()
        schema = StructType.fromJson(json.loads(m.schema))
        unknown = set(rows.columns) - set(schema.names)
        if unknown:
            raise ValueError(f"the table has no columns {sorted(unknown)}")
        full = rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
        return self._rewrite(m, full, lambda old, new: _newest(m, old, new), stream, batch)

    def delete(self, keys: DataFrame, stream: str | None = None, batch: int | None = None) -> bool:
        """The rows whose key is among ``keys`` go."""
        m = self.manifest()
        asked = keys.select(*m.keys).distinct()

        def without(old: DataFrame, new: DataFrame) -> DataFrame:
            gone = new.select(*(F.col(k).alias(f"gone_{j}") for j, k in enumerate(m.keys))).hint("merge")  # as many as there are keys: not for the driver
            return old.join(gone, _all(F.col(k).eqNullSafe(F.col(f"gone_{j}")) for j, k in enumerate(m.keys)), "left_anti")

        return self._rewrite(m, asked, without, stream, batch)

    def replace(self, rows: DataFrame) -> None:
        """Wipe and reload: the table has these rows alone (of each key the newest), in one commit."""
        m = self.manifest()
        schema = StructType.fromJson(json.loads(m.schema))
        full = rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
        commit = uuid.uuid4().hex
        merged = _newest(m, self.spark.createDataFrame([], schema), full).withColumn("bucket", self._bucket(m))
        merged.repartition(m.buckets, "bucket").write.partitionBy("bucket").parquet(f"{self.path}/commits/{commit}")
        held = {n.split("=")[1]: commit for n in self.files.names(f"commits/{commit}") if n.startswith("bucket=")}
        self._publish(Manifest(m.number + 1, m.schema, m.keys, m.version, m.buckets, held, m.streams))

    def delete_where(self, condition: Column) -> bool:
        """The rows for which ``condition`` is true go; buckets without such a row stay as they are."""
        return self.delete(self.read().where(condition))

    def _rewrite(self, m: Manifest, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], stream: str | None, batch: int | None) -> bool:
        if stream is not None and batch is not None and batch <= m.streams.get(stream, -1):
            return False  # delivered before
        streams = m.streams | ({stream: batch} if stream is not None and batch is not None else {})
        bucketed = rows.withColumn("bucket", self._bucket(m))
        touched = sorted(str(r[0]) for r in bucketed.select("bucket").distinct().collect())  # at most the number of buckets
        if touched:
            commit = uuid.uuid4().hex
            merged = merge(self._rows(m, touched), rows).withColumn("bucket", self._bucket(m))
            merged.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/commits/{commit}")
            written = {n.split("=")[1] for n in self.files.names(f"commits/{commit}") if n.startswith("bucket=")}
            held = {b: c for b, c in m.held.items() if b not in touched} | dict.fromkeys(sorted(written), commit)
        elif streams == m.streams:
            return False
        else:
            held = m.held
        self._publish(Manifest(m.number + 1, m.schema, m.keys, m.version, m.buckets, held, streams))
        return bool(touched)

    def sink(self, stream: str, kind: str | None = None) -> Callable[[DataFrame, int], None]:
        """A function for foreachBatch. With ``kind``, a column of the batch: rows that say 'delete' there take their keys away, if no row of the key in the batch has a larger version."""

        def merge(rows: DataFrame, batch: int) -> None:
            if kind is None:
                self.upsert(rows, stream, batch)
                return
            m = self.manifest()
            if batch <= m.streams.get(stream, -1):
                return
            last = rows.groupBy(*m.keys).agg(F.max_by(F.struct(*rows.columns), F.struct(F.col(m.version), F.col(kind) == "delete", F.xxhash64(*rows.columns))).alias("x")).select("x.*")
            self.delete(last.where(F.col(kind) == "delete"))
            self.upsert(last.where(~F.coalesce(F.col(kind) == "delete", F.lit(False))).drop(kind), stream, batch)

        return merge

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete the commits that none of the last ``keep`` manifests names, and the older manifests; the commits that went."""
        numbers = sorted(int(n.split(".")[0]) for n in self.files.names("manifests") if n.endswith(".json"))
        used = {c for n in numbers[-keep:] for c in self.manifest(n).held.values()}
        gone = [c for c in self.files.names("commits") if c not in used]
        for n in numbers[:-keep]:
            self.files.remove(f"manifests/{n:010d}.json")
        for c in gone:
            self.files.remove(f"commits/{c}")
        return gone


def _all(tests) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def _newest(m: Manifest, old: DataFrame, new: DataFrame) -> DataFrame:
    """One row of each key; combined before the shuffle, so a key that many rows share needs no task of its own."""
    both = old.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)))
    order = F.struct(F.col(m.version), F.col("is_new"), F.xxhash64(*new.columns))
    return both.groupBy(*(F.col(k).alias(f"key_{j}") for j, k in enumerate(m.keys))).agg(F.max_by(F.struct(*new.columns), order).alias("x")).select("x.*")


def reindex(table: KeyedTable, fresh: DataFrame, changed: DataFrame, by: str = "file_path") -> None:
    """S3: what the changed files held goes, then their fresh rows come; both touch only the buckets of those rows."""
    stale = table.read().join(changed.select(by).distinct(), by, "left_semi")
    keys = table.manifest().keys
    table.delete(stale.select(*keys).join(fresh.select(*keys), keys, "left_anti"))
    table.upsert(fresh)
