"""Change events: renames as two events, debounced sets, and their application to a table of chunks.

Debounce rule: within a workspace a set of `type:path` gathers; a new entry restarts the silence, one that is
already in the set doesn't; after the silence the set leaves as one batch. The workspace is the grouping
key, so workspaces are apart and run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.mutate import delete_prefix, replace_content
from ..shipping import ship_package
from ..sources.snapshots import SnapshotTable

SILENCE_MS = 500
#: Pauses after which the events of a workspace are another group.
PAUSES = 1000
BATCHES = "workspace string, batch_start timestamp, batch_end timestamp, change_type string, path string"


def with_renames(events: DataFrame) -> DataFrame:
    """(ts, workspace, change_type, path) from events that may hold old_path: a rename is a deletion and a creation."""
    renamed = F.array(F.struct(F.lit("Deleted").alias("change_type"), F.col("old_path").alias("path")), F.struct(F.lit("Created").alias("change_type"), F.col("path").alias("path")))
    plain = F.array(F.struct(F.col("change_type"), F.col("path")))
    e = events.withColumn("e", F.explode(F.when(F.col("change_type") == "Renamed", renamed).otherwise(plain)))
    return e.select("ts", "workspace", F.col("e.change_type").alias("change_type"), F.col("e.path").alias("path"))


class Debouncer:
    """The rule for one workspace, fed in order of time (in milliseconds)."""

    def __init__(self, silence_ms: int, pending: list[str] | None = None, start: int = 0, last: int = 0):
        self.silence, self.pending, self.start, self.last = silence_ms, dict.fromkeys(pending or []), start, last  # in order of arrival

    @property
    def deadline(self) -> int:
        return self.last + self.silence

    def feed(self, ms: int, key: str) -> list[tuple[int, int, str]]:
        """What leaves before this event: (start, end, key)."""
        out = self.flush() if self.pending and ms >= self.deadline else []
        if key not in self.pending:
            if not self.pending:
                self.start = ms
            self.pending[key] = None
            self.last = ms
        return out

    def flush(self) -> list[tuple[int, int, str]]:
        out = [(self.start, self.last, k) for k in self.pending]
        self.pending = {}
        return out


def _frame(workspace: str, rows: list[tuple[int, int, str]]) -> pd.DataFrame:
    split = [k.split(":", 1) for _, _, k in rows]
    return pd.DataFrame(
        {
            "workspace": [workspace] * len(rows),
            "batch_start": pd.to_datetime([r[0] for r in rows], unit="ms"),
            "batch_end": pd.to_datetime([r[1] for r in rows], unit="ms"),
            "change_type": [s[0] for s in split],
            "path": [s[1] for s in split],
        }
    )


def _events(frames: Iterator[pd.DataFrame]) -> list[tuple[int, str]]:
    own = [(int(ts.value // 1_000_000), f"{kind}:{path}") for f in frames for ts, kind, path in zip(f["ts"], f["change_type"], f["path"])]
    return sorted(own)


def debounce_stream(events: DataFrame, silence_ms: int = SILENCE_MS, delay: str = "1 second") -> DataFrame:
    """A stream of flushed sets. The set of a workspace leaves when the watermark passes its silence."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    ship_package(events.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        d = Debouncer(silence_ms, *state.get) if state.exists else Debouncer(silence_ms)
        if state.hasTimedOut:
            out = d.flush()
        else:
            out = [x for ms, k in _events(frames) for x in d.feed(ms, k)]
        if d.pending:
            state.update((list(d.pending), d.start, d.last))
            state.setTimeoutTimestamp(max(d.deadline, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield _frame(key[0], out)

    own = events.withWatermark("ts", delay).select("ts", "workspace", "change_type", "path")
    return own.groupBy("workspace").applyInPandasWithState(step, BATCHES, "pending array<string>, start long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def debounce_batch(events: DataFrame, silence_ms: int = SILENCE_MS) -> DataFrame:
    """The same rule over a finished set of events.

    A pause as long as the silence between two events ends a set whatever is in it, so a workspace can be cut at such pauses: as
    many as PAUSES of them go together, and a workspace isn't gathered in one group.
    """
    ship_package(events.sparkSession)

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        d = Debouncer(silence_ms)
        out = [x for ms, k in _events(iter([f])) for x in d.feed(ms, k)] + d.flush()
        return _frame(key[0], out)

    by_time = Window.partitionBy("workspace").orderBy("ts")
    pause = F.unix_millis("ts") - F.unix_millis(F.lag("ts").over(by_time)) >= silence_ms
    own = events.select("ts", "workspace", "change_type", "path").withColumn("pause", F.coalesce(pause, F.lit(False)).cast("int"))
    pauses = F.sum("pause").over(by_time.rangeBetween(Window.unboundedPreceding, 0))
    parts = own.withColumn("part", F.floor(pauses / PAUSES)).drop("pause")
    return parts.groupBy("workspace", "part").applyInPandas(run, BATCHES)


def apply_changes(chunks: DataFrame, changes: DataFrame, ingest: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """chunks after a batch: created and modified files are chunked anew, deleted ones go. ingest takes (path) rows."""
    last = changes.groupBy("path").agg(F.max_by("change_type", "seq").alias("change_type"))
    gone = chunks.join(last.select(F.col("path").alias("source_path")), "source_path", "left_anti").select(*chunks.columns)
    fresh = ingest(last.filter("change_type != 'Deleted'").select("path"))
    return gone.unionByName(fresh.select(*chunks.columns))


def change_sink(path_of: Callable[[int], str], current: Callable[[], DataFrame], ingest: Callable[[DataFrame], DataFrame], publish: Callable[[str], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: writes the next snapshot under a name of its batch, then publishes it. Repeating a batch writes the same."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("seq", F.struct("batch_end", "change_type"))
        apply_changes(current(), rows, ingest).write.mode("overwrite").parquet(path_of(number))
        publish(path_of(number))

    return write


def snapshot_sink(table: SnapshotTable, ingest: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that commits each batch of changes as a version of a table of chunks, once however often it is repeated."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("seq", F.struct("batch_end", "change_type"))
        table.update(lambda chunks: apply_changes(chunks, rows, ingest), number)

    return write


__all__ = ["snapshot_sink", "apply_changes", "change_sink", "debounce_batch", "debounce_stream", "delete_prefix", "replace_content", "with_renames"]
