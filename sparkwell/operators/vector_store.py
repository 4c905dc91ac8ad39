"""A vector store that lasts: inserts are Parquet deltas, a manifest names what counts, and a compaction makes one table of them."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from .embedding import valid
from .search import topk


class FolderStore:
    """Vectors (id, v, and any attributes) under ``folder``: later rows of an id replace earlier ones, and all rows of an insert are valid or none goes in.

    An insert writes its rows once, then a manifest that names them: before that nobody sees them, after it they are there for every session. A token that is
    in the manifest is not inserted again. Readers take the manifest as it is and read the same rows however long they
    search, until ``vacuum`` removes files that no manifest names any more. The first insert fixes the width of all vectors. One process writes at a time.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    # What counts.

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def manifest(self) -> dict:
        fs, path = self._path("manifest.json")
        if not fs.exists(path):
            return {"width": None, "base": None, "deltas": [], "tokens": []}
        return json.loads(self.spark.read.text(f"{self.folder}/manifest.json", wholetext=True).first().value)

    def _publish(self, manifest: dict) -> None:
        fs, path = self._path("manifest.json")
        _, new = self._path(".manifest.new")
        out = fs.create(new, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        fs.delete(path, False)
        fs.rename(new, path)

    # Writing.

    def insert(self, chunks: DataFrame, token: str | None = None) -> bool:
        """Adds rows; False if the token was inserted before or there are none. Of an id's rows in one insert the last counts."""
        manifest = self.manifest()
        if token is not None and token in manifest["tokens"]:
            return False
        name = f"delta-{len(manifest['deltas']):06d}-{uuid.uuid4().hex[:12]}"
        placed = chunks.withColumn("__place", F.monotonically_increasing_id())
        rest = [c for c in chunks.columns if c != "id"]
        placed.groupBy("id").agg(F.max_by(F.struct(*rest), "__place").alias("r")).select("id", "r.*").write.parquet(f"{self.folder}/{name}")
        written = self.spark.read.parquet(f"{self.folder}/{name}")  # what is checked is what was written
        told = written.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("width"), F.count("v").alias("vectors"), F.count("id").alias("ids")).first()
        width = manifest["width"] or told.width
        good = told.n == told.vectors == told.ids and told.least == told.width == width and not written.where(~F.coalesce(valid(F.col("v"), width or 0), F.lit(False))).limit(1).count()
        if not told.n or not good:
            self._remove(name)
            if told.n:
                raise ValueError(f"a row has no id, or a vector that is not {width} finite numbers")
            return False
        self._publish({**manifest, "width": width, "deltas": [*manifest["deltas"], name], "tokens": [*manifest["tokens"], *([token] if token else [])]})
        return True

    def compact(self) -> None:
        """One table of all that counts now."""
        manifest = self.manifest()
        if not manifest["deltas"]:
            return
        name = f"base-{uuid.uuid4().hex[:12]}"
        self._rows(manifest).write.parquet(f"{self.folder}/{name}")
        now = self.manifest()
        self._publish({**now, "base": name, "deltas": [d for d in now["deltas"] if d not in manifest["deltas"]]})

    def vacuum(self) -> None:
        """Removes tables that the manifest does not name: call it when nobody reads what was before."""
        manifest = self.manifest()
        fs, root = self._path("")
        for entry in fs.listStatus(root):
            name = entry.getPath().getName()
            if name.startswith(("delta-", "base-")) and name != manifest["base"] and name not in manifest["deltas"]:
                self._remove(name)

    def clear(self) -> None:
        self._publish({"width": None, "base": None, "deltas": [], "tokens": []})

    def _remove(self, name: str) -> None:
        fs, path = self._path(name)
        fs.delete(path, True)

    # Reading.

    def _rows(self, manifest: dict) -> DataFrame:
        """Rows of the base that no delta replaces, and of each id in the deltas the newest. Only the deltas are shuffled, and ids where the base meets them."""
        parts = None
        for place, name in enumerate(manifest["deltas"]):
            delta = self.spark.read.parquet(f"{self.folder}/{name}").withColumn("__delta", F.lit(place))
            parts = delta if parts is None else parts.unionByName(delta, allowMissingColumns=True)
        base = self.spark.read.parquet(f"{self.folder}/{manifest['base']}") if manifest["base"] else None
        if parts is None:
            return base
        rest = [c for c in parts.columns if c not in ("id", "__delta")]
        newest = parts.groupBy("id").agg(F.max_by(F.struct(*rest), "__delta").alias("r")).select("id", "r.*") if len(manifest["deltas"]) > 1 else parts.drop("__delta")
        return newest if base is None else base.join(parts.select("id").distinct(), "id", "left_anti").unionByName(newest, allowMissingColumns=True)

    def rows(self) -> DataFrame:
        """The rows that count at this moment; inserts and compactions after it do not change the frame."""
        manifest = self.manifest()
        if not manifest["deltas"] and not manifest["base"]:
            raise ValueError("the store is empty")
        return self._rows(manifest)

    def search(self, queries: DataFrame, k: int = 5, wanted: dict | None = None) -> DataFrame:
        """``topk`` of the queries (query_id, qv) among rows that have all the attributes wanted."""
        if int(k) != k or k < 1:
            raise ValueError("k must be a whole number above 0")
        rows = self.rows()
        return topk(queries, rows.where(tx.agrees(rows, wanted or {})).select("id", "v"), k)
