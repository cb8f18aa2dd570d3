"""A store of tables with a commit log: a batch writes its tables into new folders and then one manifest, by an atomic rename, that names them.

Readers take the folders that manifests name, so they see all of a batch or nothing, and a batch that is run again after its manifest is there does nothing. Folders of batches that failed are never read; `vacuum`
deletes them. Keys of first-wins tables are also kept by hash in buckets, of which a batch reads those that its own keys fall in. `compact` folds the committed folders into one a table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG, KEYS = "_commits", ".keys"
BUCKETS = 64


class Store:
    """Tables under a folder. Names of batches are unique; there is one writer at a time."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._conf, self._fs_package = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs

    # --- files ---

    def _path(self, name: str):
        return self._fs_package.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self._conf) if self.root else None

    def _names(self, folder: str) -> list[str]:
        files, path = self._files(), self._path(folder)
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def _text(self, name: str) -> str:
        stream = self._files().open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> None:
        """The file, whole or not at all; an error if it is there already."""
        parent, _, last = name.rpartition("/")
        draft = self._path(f"{parent}/.{last}.{uuid.uuid4().hex}")
        stream = self._files().create(draft, False)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        rename = getattr(self._fs_package, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        self._fs_package.FileContext.getFileContext(draft.toUri(), self._conf).rename(draft, self._path(name), options)

    # --- the log ---

    def _manifests(self) -> dict[str, dict]:
        return {n.removesuffix(".json"): json.loads(self._text(f"{LOG}/{n}")) for n in self._names(LOG) if n.endswith(".json") and not n.startswith(".")}

    def names(self) -> set[str]:
        """The batches that are committed."""
        found = self._manifests()
        return {*found, *(n for m in found.values() for n in m.get("folded", []))}

    def folders(self, table: str) -> list[str]:
        """The committed folders of a table, in the order of their names."""
        found = self._manifests().values()
        gone = {f for m in found for f in m.get("removed", [])}
        return sorted(f for m in found for f in m["tables"].get(table, []) if f not in gone)

    def begin(self, name: object) -> Batch | None:
        """A batch to write, or None if one of this name is committed."""
        return None if str(name) in self.names() else Batch(self, str(name))

    # --- tables ---

    def read(self, table: str, schema: str, only: Sequence[str] | None = None) -> DataFrame:
        """What is committed of a table, or some of its folders; without rows before the first batch."""
        folders = self.folders(table) if only is None else only
        return self._frame(table, folders, schema) if folders else self.spark.createDataFrame([], schema)

    def _frame(self, table: str, folders: Sequence[str], schema: str | None = None) -> DataFrame:
        reader = self.spark.read.option("basePath", f"{self.root}/{table}")
        return (reader.schema(schema) if schema else reader).parquet(*[f"{self.root}/{f}" for f in folders]).drop("try")

    def _bucketed(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int"))

    def unknown(self, rows: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
        """rows whose key no committed batch has stored; of the stored keys the buckets that the rows fall in are read."""
        touched = [r[0] for r in self._bucketed(rows, keys).select("_bucket").distinct().collect()]
        schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
        known = self.read(f"{table}{KEYS}", f"{schema}, _bucket int").where(F.col("_bucket").isin(touched)).drop("_bucket")
        return rows.join(known, list(keys), "left_anti")

    def compact(self) -> None:
        """One folder a table instead of one a batch, committed at once; the batches' names are kept."""
        found, batch = self._manifests(), Batch(self, f"compact-{uuid.uuid4().hex}")
        old: list[str] = []
        for table in sorted({t for m in found.values() for t in m["tables"]}):
            if folders := self.folders(table):
                rows = self._frame(table, folders)
                batch.write(table, rows.repartition("_bucket") if table.endswith(KEYS) else rows, ["_bucket"] if table.endswith(KEYS) else [])
                old += folders
        batch.removed, batch.folded = [*old, *(f for m in found.values() for f in m.get("removed", []))], sorted(self.names())
        batch.commit()
        for name in found:
            self._files().delete(self._path(f"{LOG}/{name}.json"), False)

    def vacuum(self) -> int:
        """Deletes the folders that no manifest names, when no batch is being written; how many."""
        gone = 0
        for table in self._names(""):
            if table != LOG:
                live = set(self.folders(table))
                for folder in self._names(table):
                    if f"{table}/{folder}" not in live:
                        self._files().delete(self._path(f"{table}/{folder}"), True)
                        gone += 1
        return gone


class Batch:
    """What one batch writes; nothing of it is read before `commit`."""

    def __init__(self, store: Store, name: str):
        self.store, self.name = store, name
        self.tables: dict[str, list[str]] = {}
        self.removed: list[str] = []
        self.folded: list[str] = []

    def write(self, table: str, rows: DataFrame, by: Sequence[str] = ()) -> None:
        folder = f"{table}/try={uuid.uuid4().hex}"
        rows.write.partitionBy(*by).parquet(f"{self.store.root}/{folder}")
        self.tables.setdefault(table, []).append(folder)

    def add(self, table: str, rows: DataFrame, keys: Sequence[str]) -> None:
        """Rows of a first-wins table, and their keys by bucket."""
        self.write(table, rows)
        self.write(f"{table}{KEYS}", self.store._bucketed(rows.select(*keys), keys).repartition("_bucket"), ["_bucket"])

    def commit(self) -> None:
        self.store._put(f"{LOG}/{self.name}.json", json.dumps({"tables": self.tables, "removed": self.removed, "folded": self.folded}))
