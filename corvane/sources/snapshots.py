"""Tables of numbered versions: a commit is seen as a whole or not at all, and readers keep the version that they began with.

Data files lie in a folder of their own for each write. A version is a manifest that lists the folders it is made of; it comes into being under
its number by one step that fails where the number is taken. So of two writers that began at one version only one wins; the other one's commit
raises `Conflict`, and `update` builds its change anew on what is there then. A write that fails leaves a folder that no manifest names.
Readers never list folders. A batch of a stream is committed once, however often it is repeated.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TRIES = 10


class Conflict(Exception):
    """Another writer has committed the version that this one would make."""


class SnapshotTable:
    """A table at a path of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _manifest(self, version: int) -> str:
        return f"versions/{version:012d}.json"

    def version(self) -> int:
        """The number of the last version; 0 if there is none yet."""
        folder = self._at("versions")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_"))), default=0)

    def manifest(self, version: int) -> dict:
        """{"folders": [...], "batch": n}: what a version is made of, and the last batch of a stream that it holds."""
        if version == 0:
            return {"folders": [], "batch": None}
        stream = self._fs.open(self._at(self._manifest(version)))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the last one. Later commits don't change what this frame reads."""
        folders = self.manifest(self.version() if version is None else version)["folders"]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def _write(self, df: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        df.select(*self.spark.createDataFrame([], self.schema).columns).write.parquet(f"{self.path}/{folder}")
        return folder

    def _commit(self, base: int, manifest: dict) -> int:
        """Makes version base + 1, or raises where it is there already."""
        final = self._at(self._manifest(base + 1))
        part = self._at(f"versions/.{uuid.uuid4().hex}")
        out = self._fs.create(part, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        options = self._jvm.org.apache.hadoop.fs.Options
        try:
            if self._fs.getUri().getScheme() == "file":
                # A link is made only where its name is free; a rename of local files would replace what is there.
                files = self._jvm.java.nio.file.Files
                files.createLink(self._jvm.java.io.File(final.toUri().getPath()).toPath(), self._jvm.java.io.File(part.toUri().getPath()).toPath())
            else:
                none = self.spark.sparkContext._gateway.new_array(options.Rename, 1)
                none[0] = options.Rename.NONE
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(part, final, none)
        except Exception as e:
            if self._fs.exists(final):
                raise Conflict(f"version {base + 1} of {self.path} is there already") from e
            raise
        finally:
            self._fs.delete(part, False)
        return base + 1

    def append(self, df: DataFrame, batch: int | None = None) -> int:
        """A version with these rows more. The rows are written once; beside other writers only the manifest is tried anew."""
        folder = None
        for _ in range(TRIES):
            base = self.version()
            own = self.manifest(base)
            if batch is not None and own["batch"] is not None and batch <= own["batch"]:
                return base
            folder = folder or self._write(df)
            try:
                return self._commit(base, {"folders": [*own["folders"], folder], "batch": own["batch"] if batch is None else batch})
            except Conflict:
                continue
        raise Conflict(f"{TRIES} other commits came first")

    def replace(self, df: DataFrame, base: int, batch: int | None = None) -> int:
        """A version of these rows alone, made from what version `base` held; raises if that is no longer the last one."""
        if self.version() != base:
            raise Conflict(f"version {base} of {self.path} is not the last one")
        return self._commit(base, {"folders": [self._write(df)], "batch": self.manifest(base)["batch"] if batch is None else batch})

    def update(self, change: Callable[[DataFrame], DataFrame], batch: int | None = None) -> int:
        """A version that a function makes of the last one; made anew where another commit came first. A batch that is in already changes nothing."""
        for _ in range(TRIES):
            base = self.version()
            had = self.manifest(base)["batch"]
            if batch is not None and had is not None and batch <= had:
                return base
            try:
                return self.replace(change(self.read(base)), base, batch)
            except Conflict:
                continue
        raise Conflict(f"{TRIES} other commits came first")

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes all versions but the last so many, and the data that none of those has; gives the folders that are gone. No writer may be at work."""
        last = self.version()
        kept = [v for v in range(max(1, last - keep + 1), last + 1)]
        used = {f for v in kept for f in self.manifest(v)["folders"]}
        gone = []
        if self._fs.exists(self._at("data")):
            for s in self._fs.listStatus(self._at("data")):
                folder = f"data/{s.getPath().getName()}"
                if folder not in used:
                    self._fs.delete(s.getPath(), True)
                    gone.append(folder)
        for v in range(1, kept[0] if kept else 1):
            self._fs.delete(self._at(self._manifest(v)), False)
        return sorted(gone)
