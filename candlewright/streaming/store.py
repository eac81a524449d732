"""Tables in buckets and topics in files below one folder, changed together by numbered, atomic commits.

A commit writes its files to a folder of its own, then a manifest, and renames the manifest to its version's name. What no
manifest names does not exist: a job that dies before the rename leaves the store as it was, and what it wrote is never
read. The manifest of a version lists every table's bucket folders, of which it took over those that it did not touch, and
the last batch of each source, so that a batch that comes again after its commit changes nothing. Files of topics are
moved into the topics' folders after the rename, each commit's at once, and again by whoever opens the store, if the move
was cut off. One writer at a time; readers may be many.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Manifests that stay behind the newest, and with them the folders they name, for readers under way.
KEPT = 3


class Files:
    """The few file operations of a commit, on any file system of Hadoop's."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        path = self.jvm.org.apache.hadoop.fs.Path(root)
        conf = spark._jsc.hadoopConfiguration()
        self.fs = path.getFileSystem(conf)
        self.gateway = spark.sparkContext._gateway
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        where = self.path(folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> None:
        """Raises if new exists."""
        plain = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self.fs.mkdirs(self.path(new).getParent())
        self.context.rename(self.path(old), self.path(new), plain)

    def size(self, folder: str) -> int:
        return self.fs.getContentSummary(self.path(folder)).getLength()

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


@dataclass
class Manifest:
    """tables: name -> (schema as JSON, bucket -> folder). topics: name -> folder of this version's messages. sources: name ->
    the last batch committed. marks: numbers that go with the tables. made: the folder that the version's commit wrote."""

    version: int = 0
    buckets: int = 32
    tables: dict[str, tuple[str, dict[str, str]]] = field(default_factory=dict)
    topics: dict[str, str] = field(default_factory=dict)
    sources: dict[str, int] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)
    made: str = ""


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 32):
        """buckets: of a store that is new; of others it is what they began with."""
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        self.new_buckets = buckets
        self.deliver()

    def _name(self, version: int) -> str:
        return f"{self.root}/manifests/{version:012d}.json"

    def versions(self) -> list[int]:
        return [int(x[:12]) for x in self.files.names(f"{self.root}/manifests") if x.endswith(".json") and not x.startswith(("_", "."))]

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest, or that of a version; an empty one of a new store."""
        found = self.versions()
        if not found:
            return Manifest(buckets=self.new_buckets)
        return Manifest(**json.loads(self.files.read(self._name(found[-1] if version is None else version))))

    def bucket(self, key: str, buckets: int):
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")

    def read(self, table: str, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """The table, or some of its buckets: only their files are listed and read. None if it has never been written."""
        m = self.manifest(version)
        if table not in m.tables:
            return None
        schema, folders = m.tables[table]
        kind = T.StructType.fromJson(json.loads(schema))
        paths = [f for b, f in sorted(folders.items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def topic(self, name: str) -> str:
        """The folder of a topic's messages, for a stream or a batch; it is made if it is not there."""
        self.files.fs.mkdirs(self.files.path(f"{self.root}/topics/{name}"))
        return f"{self.root}/topics/{name}"

    def seen(self, source: str, batch: int) -> bool:
        return batch <= self.manifest().sources.get(source, -1)

    def begin(self) -> Commit:
        return Commit(self)

    def deliver(self) -> None:
        """Move the newest version's messages to their topics, unless they are there."""
        m = self.manifest()
        for name, folder in m.topics.items():
            target = f"{self.topic(name)}/commit={m.version:012d}"
            if not self.files.exists(target):
                self.files.rename(folder, target)

    def clean(self) -> None:
        """Remove what only versions older than the newest KEPT name."""
        old = self.versions()[: -KEPT - 1]
        if not old:
            return
        rest = [self.manifest(v) for v in self.versions()[-KEPT - 1 :]]
        held = {f for m in rest for _, folders in m.tables.values() for f in folders.values()}
        for v in old:
            for _, folders in self.manifest(v).tables.values():
                for f in folders.values():
                    if f not in held:
                        self.files.remove(f)
            self.files.remove(self._name(v))


class Commit:
    """What one batch changes."""

    def __init__(self, store: Store):
        self.store, self.base = store, store.manifest()
        self.folder = f"{store.root}/data/{uuid.uuid4().hex}"
        self.tables = {k: (schema, dict(folders)) for k, (schema, folders) in self.base.tables.items()}
        self.topics: dict[str, str] = {}
        self.marks = dict(self.base.marks)

    def touched(self, *keys: DataFrame) -> list[int]:
        """The buckets of the keys, each frame's first column; as many numbers at most as there are buckets."""
        found: set[int] = set()
        for df in keys:
            found |= {r[0] for r in df.select(self.store.bucket(df.columns[0], self.base.buckets)).distinct().collect()}
        return sorted(found)

    def old(self, table: str, buckets: Sequence[int]) -> DataFrame | None:
        return self.store.read(table, self.base.version if self.base.version else None, buckets) if table in self.base.tables else None

    def replace(self, table: str, rows: DataFrame, key: str, buckets: Sequence[int]) -> None:
        """rows become all of the table in these buckets; nothing else is read or written."""
        where = f"{self.folder}/{table}"
        rows.withColumn("_bucket", self.store.bucket(key, self.base.buckets)).repartition(len(buckets) or 1, "_bucket").write.partitionBy("_bucket").parquet(where)
        folders = self.tables.get(table, ("", {}))[1]
        there = set(self.store.files.names(where))
        for b in buckets:
            folders.pop(str(b), None)
            if f"_bucket={b}" in there:
                folders[str(b)] = f"{where}/_bucket={b}"
        self.tables[table] = (rows.schema.json(), folders)

    def send(self, topic: str, messages: DataFrame) -> None:
        """messages (value) go to the topic when the commit is made; if there are none, the topic gets no file."""
        where = f"{self.folder}/{topic}"
        messages.select("value").write.text(where)
        if self.store.files.size(where):
            self.topics[topic] = where

    def close(self, source: str, batch: int) -> int:
        """Make the change; its version is returned."""
        store, version = self.store, self.base.version + 1
        made = Manifest(version, self.base.buckets, self.tables, self.topics, {**self.base.sources, source: batch}, self.marks, self.folder)
        draft = f"{store.root}/manifests/_{uuid.uuid4().hex}"
        store.files.write(draft, json.dumps(made.__dict__))
        store.files.rename(draft, store._name(version))
        store.deliver()
        store.clean()
        return version
