"""A watched folder as a streaming source: spark.readStream.format("folder_changes").load(folder).

Each look at the folder that finds a difference writes a numbered snapshot of the listing: path, size, time of change and a hash of the content. An
offset is such a number, and a batch is the difference between two of them: files that were created, modified, deleted or renamed. Snapshots lie
in a folder that outlives the query, so after a restart a batch is the same as before and nothing is told twice; those before a committed
offset are deleted. Files that are there at the first look are created.

As of other file sources, the listing is made by the driver. It hashes files whose size or time changed, a block at a time. A rename is a file that
is gone and one that is new with the same content; of equal ones they pair in the order of their paths.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..shipping import ship_package
from .archives import file_system

CHANGES = "version long, ts timestamp, workspace string, change_type string, path string, old_path string"
#: What is watched by default.
DEFAULT_PATTERNS = "*.cs,*.ts,*.md,*.py,*.json"
PARTITIONS = 8

#: Size, time of change in nanoseconds and hash of a file.
Entry = tuple[int, int, str]


def differences(before: dict[str, Entry], after: dict[str, Entry]) -> Iterator[tuple[str, str, str | None]]:
    """(change, path, old path) between two listings, in order of paths."""
    gone = sorted(p for p in before if p not in after)
    new = sorted(p for p in after if p not in before)
    by_hash: dict[str, list[str]] = {}
    for p in gone:
        by_hash.setdefault(before[p][2], []).append(p)
    moved = {p: by_hash[after[p][2]].pop(0) for p in new if by_hash.get(after[p][2])}
    left = set(gone) - set(moved.values())
    for p in sorted({*left, *after}):
        if p in left:
            yield "Deleted", p, None
        elif p in moved:
            yield "Renamed", p, moved[p]
        elif p not in before:
            yield "Created", p, None
        elif before[p][2] != after[p][2]:
            yield "Modified", p, None


class Snapshots:
    """Numbered listings in a folder; number 0 is the empty one."""

    def __init__(self, folder: str):
        self.system, self.top = file_system(folder)
        self.system.create_dir(self.top, recursive=True)

    def numbers(self) -> list[int]:
        from pyarrow import fs

        names = [f.base_name for f in self.system.get_file_info(fs.FileSelector(self.top))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def read(self, number: int) -> tuple[float, dict[str, Entry]]:
        if number == 0:
            return 0.0, {}
        with self.system.open_input_file(f"{self.top}/{number:012d}.json") as f:
            held = json.loads(f.read())
        return held["at"], {p: tuple(e) for p, e in held["files"].items()}

    def write(self, number: int, files: dict[str, Entry]) -> None:
        """Under another name first, so that a half-written one is never seen."""
        part = f"{self.top}/.{number:012d}.part"
        with self.system.open_output_stream(part) as f:
            f.write(json.dumps({"at": time.time(), "files": files}).encode())
        self.system.move(part, f"{self.top}/{number:012d}.json")

    def drop_before(self, number: int) -> None:
        for n in self.numbers():
            if n < number:
                self.system.delete_file(f"{self.top}/{n:012d}.json")


@dataclass
class _Part(InputPartition):
    start: int
    end: int
    part: int


class FolderReader(DataSourceStreamReader):
    def __init__(self, folder: str, snapshots: str, patterns: list[str], parts: int):
        self.folder, self.snapshots, self.patterns, self.parts = folder, snapshots, patterns, parts

    def listing(self, known: dict[str, Entry]) -> dict[str, Entry]:
        from pyarrow import fs

        system, top = file_system(self.folder)
        out: dict[str, Entry] = {}
        for f in system.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True)):
            if f.type == fs.FileType.File and any(fnmatch.fnmatch(f.base_name, p) for p in self.patterns):
                had = known.get(f.path)
                if had and had[:2] == (f.size, f.mtime_ns):
                    out[f.path] = had
                    continue
                try:
                    digest = hashlib.sha256()
                    with system.open_input_stream(f.path) as s:
                        while block := s.read(1 << 20):
                            digest.update(block)
                except FileNotFoundError:
                    continue  # deleted since it was listed
                out[f.path] = (f.size, f.mtime_ns, digest.hexdigest())
        return out

    def initialOffset(self) -> dict:  # noqa: N802
        return {"version": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        store = Snapshots(self.snapshots)
        last = (store.numbers() or [0])[-1]
        before = store.read(last)[1]
        after = self.listing(before)
        if any(True for _ in differences(before, after)):
            last += 1
            store.write(last, after)
        return {"version": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Part(start["version"], end["version"], k) for k in range(self.parts)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        store = Snapshots(self.snapshots)
        before, (at, after) = store.read(partition.start)[1], store.read(partition.end)
        when = datetime.fromtimestamp(at, UTC)
        for change, path, old in differences(before, after):
            if zlib.crc32(path.encode()) % self.parts == partition.part:
                yield partition.end, when, self.folder, change, path, old

    def commit(self, end: dict) -> None:
        Snapshots(self.snapshots).drop_before(end["version"])


class FolderChanges(DataSource):
    """Options: path, snapshots (a shared folder), patterns (of file names, by commas) and partitions."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        o = self.options
        return FolderReader(o["path"], o["snapshots"], o.get("patterns", DEFAULT_PATTERNS).split(","), int(o.get("partitions", PARTITIONS)))


def watch(spark: SparkSession, folder: str, snapshots: str, patterns: str = DEFAULT_PATTERNS) -> DataFrame:
    """A stream of changes below a folder, as streaming.changes.with_renames takes them."""
    ship_package(spark)
    spark.dataSource.register(FolderChanges)
    return spark.readStream.format("folder_changes").option("snapshots", snapshots).option("patterns", patterns).load(folder)
