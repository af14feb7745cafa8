"""State as versions of Parquet tables and a pointer for each version, written last.

All tables of a cycle become visible together; a batch that was committed before is
recognised by its id and changes nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


class State:
    """Versioned tables under a folder of any file system that Spark can write."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list:
        """Paths of all pointers, newest first."""
        folder = self._path(f"{self.folder}/versions")
        found = [f.getPath() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted((p for p in found if p.getName().isdigit()), key=lambda p: -int(p.getName()))

    def current(self) -> dict:
        """version, batch, tables (name: path) of the last commit: the newest pointer that can be read."""
        for path in self._pointers():
            try:
                return json.loads("".join(r[0] for r in self.spark.read.text(path.toString()).collect()))
            except ValueError:  # cut off while it was written: that version was never committed
                continue
        return {"version": 0, "batch": None, "tables": {}}

    def table(self, name: str, schema: str) -> DataFrame:
        """A table of the last commit, in buckets or not; empty if there is none."""
        tables = self.current()["tables"]
        paths = [p for n, p in sorted(tables.items()) if n == name or n.startswith(f"{name}/")]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, tables: dict[str, DataFrame], batch: int | None = None, buckets: dict[str, list[int]] | None = None) -> bool:
        """Write a version of the tables, then its pointer; False if the batch was committed before. Other tables carry forward.

        buckets: of tables that have a column `bucket`, those that are written anew (some may have become
        empty); the others carry forward as well, so a batch rewrites what it touches only.
        """
        now = self.current()
        if batch is not None and now["batch"] is not None and batch <= now["batch"]:
            return False
        pointers = self._pointers()
        version = max([now["version"], *(int(p.getName()) for p in pointers)]) + 1
        paths = dict(now["tables"])
        for name, df in tables.items():
            path = f"{self.folder}/{name}/v={version}"
            if name not in (buckets or {}):
                df.write.mode("overwrite").parquet(path)
                paths[name] = path
                continue
            df.write.mode("overwrite").partitionBy("bucket").parquet(path)
            for b in buckets[name]:
                paths.pop(f"{name}/{b}", None)
                if self._fs.exists(self._path(f"{path}/bucket={b}")):
                    paths[f"{name}/{b}"] = f"{path}/bucket={b}"
        # a pointer appears whole, under a name of its own: until then, and if it never does, the one before counts
        temporary, final = self._path(f"{self.folder}/.pointer-{version}"), self._path(f"{self.folder}/versions/{version}")
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps({"version": version, "batch": now["batch"] if batch is None else batch, "tables": paths}).encode()))
        out.close()
        if not self._fs.rename(temporary, final):
            raise OSError("the pointer could not be put in place")
        for old in pointers[1:]:  # the last one stays, in case a reader has just begun
            self._fs.delete(old, False)
        return True
