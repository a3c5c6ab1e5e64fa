"""A table of rows with a key that is kept in files, and of which a put rewrites only what it touches.

Keys are dealt into a fixed number of buckets by hash. A version of the table is a manifest, a small
file that names for every bucket the folder with its rows. A put reads the buckets that its keys lie in,
writes them anew into folders of their own, and then writes the next manifest; the other
buckets keep their folders. Until the manifest is there nothing has changed, so a job that fails, or a
task that runs twice, leaves the table as it was. Two puts at once both try to write the same manifest,
which one of them cannot, and its caller may put again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from typing import Any, NamedTuple

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fleetlens.operators.ranking import top_per_group

BUCKET = "_bucket"
MANIFESTS = "_manifests"


class Manifest(NamedTuple):
    """One version: folders by bucket, ids of the puts that made it, and values the caller keeps with it."""

    version: int
    key: str
    buckets: int
    schema: str
    folders: dict[str, str]
    last_put: int | None
    values: dict[str, Any]


class Conflict(RuntimeError):
    """Another put has made this version."""


class _Files:
    """The few calls to the file system that Spark works on."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root
        self.conf = spark._jsc.sc().hadoopConfiguration()
        self.hadoop = self.jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.hadoop.Path(f"{self.root}/{name}")

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self.path(folder)):
            return []
        return [f.getPath().getName() for f in self.fs.listStatus(self.path(folder))]

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str, draft: str) -> bool:
        """Writes a file whole or not at all; False if there is one of that name."""
        stream = self.fs.create(self.path(draft), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        source, target = (self.fs.makeQualified(self.path(x)) for x in (draft, name))
        context = self.hadoop.FileContext.getFileContext(self.fs.getUri(), self.conf)
        no_options = SparkContext._gateway.new_array(getattr(self.hadoop, "Options$Rename"), 0)
        try:
            context.rename(source, target, no_options)
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                self.fs.delete(source, False)
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class KeyedTable:
    """A table at ``path``, a folder of the shared file system. Make one with :meth:`create`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = _Files(spark, self.path)

    @classmethod
    def create(
        cls, rows: DataFrame, path: str, key: str, buckets: int, values: Mapping[str, Any] | None = None
    ) -> KeyedTable:
        """Writes the first version. ``rows`` have distinct keys; ``buckets`` stays for the table's life.

        Buckets should be some hundred megabytes each, so that a put of few keys rewrites little.
        """
        table = cls(rows.sparkSession, path)
        if table.files.names(MANIFESTS):
            raise Conflict(f"{path} is a table already")
        schema = T.StructType(rows.schema.fields).json()
        empty = Manifest(-1, key, buckets, schema, {}, None, {})
        table._commit(empty, table._write(rows, empty, 0), None, values or {})
        return table

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest version, or one asked for."""
        if version is None:
            names = [n for n in self.files.names(MANIFESTS) if n.endswith(".json")]
            version = max(int(n.removesuffix(".json")) for n in names)
        return Manifest(**json.loads(self.files.read(f"{MANIFESTS}/{version}.json")))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        now = self.manifest(version)
        return self._rows(now, list(now.folders.values()))

    def bucket(self, manifest: Manifest, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(manifest.buckets)).cast("int")

    def rows_of(self, keys: DataFrame) -> DataFrame:
        """Rows whose key is in the key column of ``keys``; other buckets are not read."""
        now = self.manifest()
        touched = keys.select(self.bucket(now, F.col(now.key)).alias(BUCKET)).distinct().collect()
        folders = [now.folders[str(r[0])] for r in touched if str(r[0]) in now.folders]
        return self._rows(now, folders).join(keys.select(now.key).distinct(), now.key, "left_semi")

    def put(
        self,
        puts: DataFrame,
        order: str,
        deleted: str | None = None,
        put_id: int | None = None,
        values: Mapping[str, Any] | None = None,
    ) -> Manifest:
        """Replaces rows by key; the last put of a key in the order of the column ``order`` counts.

        A row whose column ``deleted`` is true takes its key away. A ``put_id`` that is not greater than
        that of the last put changes nothing, so a batch that is repeated counts once. ``values``
        are kept with the new version. Puts are read twice: for the buckets they touch, whose
        number is bounded, and for their rows.
        """
        now = self.manifest()
        if put_id is not None and now.last_put is not None and put_id <= now.last_put:
            return now
        bucket = self.bucket(now, F.col(now.key)).alias(BUCKET)
        touched = sorted(r[0] for r in puts.select(bucket).distinct().collect())
        names = [f.name for f in T.StructType.fromJson(json.loads(now.schema))]
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        new = puts.select(*names, F.col(order).alias("_order"), gone.alias("_gone"), F.lit(1).alias("_put"))
        folders = [now.folders[str(b)] for b in touched if str(b) in now.folders]
        old = self._rows(now, folders).withColumns(
            {"_order": F.lit(None).cast(puts.schema[order].dataType), "_gone": F.lit(False), "_put": F.lit(0)}
        )
        latest = [F.desc("_put"), F.desc_nulls_last("_order")]
        kept = top_per_group(old.unionByName(new), [now.key], latest, 1).filter(~F.col("_gone"))
        made = self._write(kept.select(*names), now, now.version + 1)
        folders = {b: f for b, f in now.folders.items() if int(b) not in set(touched)}
        return self._commit(now, folders | made, put_id, {**now.values, **(values or {})})

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes folders that none of the last ``keep`` versions names, and older manifests.

        Not while a put is running: its folders are not named by a manifest yet.
        """
        newest = self.manifest().version
        used = set()
        for version in range(max(0, newest - keep + 1), newest + 1):
            used.update(self.manifest(version).folders.values())
        found = [
            f"{version}/{folder}"
            for version in self.files.names("")
            if version.startswith("version=")
            for folder in self.files.names(version)
            if folder.startswith(f"{BUCKET}=")
        ]
        gone = sorted(f for f in found if f not in used)
        for name in gone:
            self.files.delete(name)
        for version in range(newest - keep, -1, -1):
            self.files.delete(f"{MANIFESTS}/{version}.json")
        return gone

    def _rows(self, manifest: Manifest, folders: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest.schema))
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def _write(self, rows: DataFrame, manifest: Manifest, version: int) -> dict[str, str]:
        """Folders of the buckets that ``rows`` lie in, by bucket. A large bucket becomes several files."""
        out = f"version={version}-{uuid.uuid4().hex}"
        dealt = rows.withColumn(BUCKET, self.bucket(manifest, F.col(manifest.key)))
        dealt.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{out}")
        names = [n for n in self.files.names(out) if n.startswith(f"{BUCKET}=")]
        return {n.removeprefix(f"{BUCKET}="): f"{out}/{n}" for n in names}

    def _commit(
        self, before: Manifest, folders: dict[str, str], put_id: int | None, values: Mapping[str, Any]
    ) -> Manifest:
        version = before.version + 1
        last = before.last_put if put_id is None else put_id
        made = before._replace(version=version, folders=folders, last_put=last, values=dict(values))
        draft = f"{MANIFESTS}/.draft-{uuid.uuid4().hex}"
        if not self.files.write_new(f"{MANIFESTS}/{version}.json", json.dumps(made._asdict()), draft):
            raise Conflict(f"version {version} of {self.path} is there already")
        return made
