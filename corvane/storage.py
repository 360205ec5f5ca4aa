"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a folder made once if all tasks run in this process, as in tests; else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        found = f"file://{tempfile.mkdtemp(prefix='corvane-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Tables that are open in the innermost `scope`, if any.
_open: ContextVar[list[Stored] | None] = ContextVar("open", default=None)


class Stored:
    """Tables written to the shared folder to cut lineage; a lost executor costs no more than a reread.

    A result that was built on them reads them when it runs, so they stay until the `scope` around ends,
    or else with the application.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.top = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0
        if (own := _open.get()) is not None:
            own.append(self)

    def cut(self, df: DataFrame) -> DataFrame:
        """Writes df and returns it as read again; its path is in `last`."""
        self.last = f"{self.top}/{self.n}"
        self.n += 1
        df.write.parquet(self.last)
        if self.n == 1:
            top = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.top)
            top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(top)  # with the application
        return self.spark.read.schema(df.schema).parquet(self.last)

    def drop(self, path: str | None = None) -> None:
        """Deletes a table that nothing will read again; without a path, all of them."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path or self.top)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scope() -> Iterator[None]:
    """Tables stored inside are deleted at its end. What was built on them must have been run by then."""
    token = _open.set([])
    try:
        yield
    finally:
        for s in _open.get():
            s.drop()
        _open.reset(token)
