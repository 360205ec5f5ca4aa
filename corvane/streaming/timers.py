"""Streams with state per entry: the debounce rule by timers, and a queue of index jobs with workers.

State is kept by entry in a map, so a batch writes what it touches and not what is pending; short queues are kept together in buckets, as each
call of a state goes to the executor's JVM and back. Both need a state store with column families: `use_entry_state` sets Spark's RocksDB
store for the session. A restart from the checkpoint goes on where the stream was.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.paths import normalize_path
from ..shipping import ship_package
from .changes import BATCHES, SILENCE_MS
from .jobs import QUEUE, WORKERS


def use_entry_state(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class DebounceProcessor(StatefulProcessor):
    """The rule of one workspace: each pending `type:path` is an entry of a map, and a timer stands at the end of the silence."""

    def __init__(self, silence_ms: int):
        self.silence = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "change_type string, path string", "place long")
        self.times = handle.getValueState("times", "start long, last long, n long")

    def flush(self, workspace: str, start: int, last: int) -> Iterator[Row]:
        rows = sorted((v[0], k[0], k[1]) for k, v in self.pending.iterator())
        self.pending.clear()
        self.times.clear()
        for _, kind, path in rows:
            yield Row(workspace=workspace, start_ms=start, end_ms=last, change_type=kind, path=path)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        times = self.times.get()
        start, last, n = times if times else (0, 0, 0)
        had = last + self.silence if n else None
        for ms, kind, path in sorted((r["ms"], r["change_type"], r["path"]) for r in rows):
            if n and ms >= last + self.silence:
                yield from self.flush(key[0], start, last)
                n = 0
            if n and self.pending.containsKey((kind, path)):
                continue  # what is in the set already doesn't extend the silence
            self.pending.updateValue((kind, path), (n,))
            start, last, n = (start if n else ms), ms, n + 1
        deadline = last + self.silence
        if had is not None and had != deadline:
            self.handle.deleteTimer(had)
        if n:
            self.times.update((start, last, n))
            if had != deadline:
                self.handle.registerTimer(deadline)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        times = self.times.get()
        if times and times[1] + self.silence <= expiredTimerInfo.getExpiryTimeInMs():
            yield from self.flush(key[0], times[0], times[1])

    def close(self) -> None:
        pass


def debounce_timers(events: DataFrame, silence_ms: int = SILENCE_MS, delay: str = "1 second") -> DataFrame:
    """A stream of flushed sets (BATCHES) of events (ts, workspace, change_type, path), as the rule of streaming.changes gives them."""
    use_entry_state(events.sparkSession)
    own = events.withWatermark("ts", delay).select("workspace", "ts", F.unix_millis("ts").alias("ms"), "change_type", "path")
    out = own.groupBy("workspace").transformWithState(
        DebounceProcessor(silence_ms), "workspace string, start_ms long, end_ms long, change_type string, path string", "Append", "eventTime"
    )
    return out.select("workspace", F.timestamp_millis("start_ms").alias("batch_start"), F.timestamp_millis("end_ms").alias("batch_end"), *[c.split()[0] for c in BATCHES.split(", ")[3:]])


TRANSITIONS = "queue string, seq long, ts timestamp, job_id string, state string, run_by string"
#: What ends a job, and the state that it leaves.
_ENDS = {"completed": "Completed", "failed": "Failed", "cancelled": "Cancelled"}
_ORDER = {e: k for k, e in enumerate((*_ENDS, "folder", "content"))}  # of events at one time


class Entries:
    """A map state during one call: each entry is read once at most, none of a key without state, and what changed is written at the end."""

    def __init__(self, state, known: bool, within: tuple = ()):  # noqa: ANN001
        self.state, self.known, self.within = state, known, within  # the map's keys begin with `within`
        self.held: dict = {}  # what an entry is now, None if there is none
        self.was: dict = {}  # and what the state has

    def get(self, key: object) -> tuple | None:
        if key not in self.held:
            # A value that isn't there comes as None.
            self.held[key] = self.was[key] = self.state.getValue((*self.within, key)) if self.known else None
        return self.held[key]

    def put(self, key: object, value: tuple | None) -> None:
        self.held[key] = value

    def write(self) -> None:
        for key, value in self.held.items():
            if value is None:
                if key in self.was:
                    if self.was[key] is not None:
                        self.state.removeKey((*self.within, key))
                elif self.known:
                    self.state.removeKey((*self.within, key))
            elif self.was.get(key) != value:
                self.state.updateValue((*self.within, key), value)


class QueueProcessor(StatefulProcessor):
    """One queue: places in line by number, jobs by id, active folders by path, and four counters."""

    def __init__(self, capacity: int, workers: int):
        self.capacity, self.workers = capacity, workers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.line_state = handle.getMapState("line", "place long", "job_id string")
        self.jobs_state = handle.getMapState("jobs", "job_id string", "path string, state string")
        self.active_state = handle.getMapState("active", "path string", "job_id string")
        self.counts = handle.getValueState("counts", "seq long, head long, tail long, busy long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        counts = self.counts.get()  # each call of a state goes to the executor's JVM and back
        self.line, self.jobs, self.active = (Entries(s, counts is not None) for s in (self.line_state, self.jobs_state, self.active_state))
        before = self.seq, self.head, self.tail, self.busy = tuple(counts or (0, 0, 0, 0))
        out = [Row(queue=key[0], seq=seq, ts=ts, job_id=job, state=state, run_by=by) for seq, ts, job, state, by in self.follow(rows)]
        for entries in (self.line, self.jobs, self.active):
            entries.write()
        if before != (now := (self.seq, self.head, self.tail, self.busy)):
            self.counts.update(now)
        yield from out

    def follow(self, rows: Iterator[Row | dict]) -> Iterator[tuple[int, object, str, str, str]]:
        """The transitions of the queue whose entries and counters are set."""
        for r in sorted(rows, key=lambda r: (r["ts"], _ORDER.get(r["event"], 9), r["job_id"])):
            for job, state, by in self.steps(r):
                yield self.seq, r["ts"], job, state, by
                self.seq += 1

    def steps(self, r: Row) -> Iterator[tuple[str, str, str]]:
        event, job, path = r["event"], r["job_id"], r["norm"]
        if event in _ENDS:
            held = self.jobs.get(job)
            if held and held[1] == "Processing":
                self.jobs.put(job, None)
                if held[0] is not None:
                    self.active.put(held[0], None)
                self.busy -= 1
                yield job, _ENDS[event], job
        elif self.jobs.get(job):
            return  # a request that is told twice
        elif event == "folder":
            if first := self.active.get(path):
                yield job, "Duplicate", first[0]
                return
            self.active.put(path, (job,))
            yield self.enter(job, path)
        elif event == "content":
            if self.tail - self.head >= self.capacity:
                yield job, "Refused", job  # a single content isn't waited for
                return
            yield self.enter(job, None)
        while self.busy < self.workers and self.head < self.tail:
            (first,) = self.line.get(self.head)
            self.line.put(self.head, None)
            self.head += 1
            self.busy += 1
            yield self.into(first, "Processing")
            if (last := self.head + self.capacity - 1) < self.tail:
                yield self.into(self.line.get(last)[0], "Queued")  # a place is free for the first one that waits

    def enter(self, job: str, path: str | None) -> tuple[str, str, str]:
        """A folder beyond the capacity waits at the door and holds its place."""
        state = "Queued" if self.tail - self.head < self.capacity else "Waiting"
        self.line.put(self.tail, (job,))
        self.tail += 1
        self.jobs.put(job, (path, state))
        return job, state, job

    def into(self, job: str, state: str) -> tuple[str, str, str]:
        self.jobs.put(job, (self.jobs.get(job)[0], state))
        return job, state, job

    def close(self) -> None:
        pass


#: Buckets that queues are dealt into by their hash; a checkpoint holds for one number.
BUCKETS = 4096
#: Entries of a queue that its bucket holds; a longer one is kept by entry from then on.
SHORT = 256
#: Parts of a bucket's state before they are made one.
PARTS = 8


class BucketProcessor(QueueProcessor):
    """The queues of a bucket, of which a call reads and writes all short ones at once.

    A batch appends a part with the queues that it touched to the bucket's state; a queue is as its last part says. Of a long queue a part has only the
    counters.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getListState("parts", "queues string")
        self.line_state = handle.getMapState("line", "queue string, place long", "job_id string")
        self.jobs_state = handle.getMapState("jobs", "queue string, job_id string", "path string, state string")
        self.active_state = handle.getMapState("active", "queue string, path string", "job_id string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        told: dict[str | None, list[dict]] = {}
        for df in rows:
            for queue, us, event, job, path in zip(*(df[c].tolist() for c in ("queue", "us", "event", "job_id", "norm"))):
                one = {"ts": us, "event": event, "job_id": job, "norm": path if isinstance(path, str) else None}
                told.setdefault(queue if isinstance(queue, str) else None, []).append(one)
        parts = [json.loads(p[0]) for p in self.parts.get()]
        known = {q: held for p in parts for q, *held in p}
        out, changed = [], {}
        for queue, events in told.items():
            before = known.get(queue)
            self.open(queue, before)
            out += [(queue, *x) for x in self.follow(events)]
            if (now := self.held(queue, before)) != before:
                changed[queue] = now
        if changed and len(parts) < PARTS:
            self.parts.appendList([(self.packed(changed),)])
        elif changed:
            self.parts.put([(self.packed(known | changed),)])
        if out:
            yield pd.DataFrame(out, columns=["queue", "seq", "us", "job_id", "state", "run_by"])

    @staticmethod
    def packed(queues: dict[str | None, list]) -> str:
        return json.dumps([[q, *held] for q, held in queues.items()])

    def open(self, queue: str | None, held: list | None) -> None:
        """Sets a queue's counters and entries to what its last part says."""
        self.seq, self.head, self.tail, self.busy, *entries = held or (0, 0, 0, 0, [], [], [])
        states = (self.line_state, self.jobs_state, self.active_state)
        self.line, self.jobs, self.active = (Entries(s, not entries, (queue,)) for s in states)
        for mine, there in zip((self.line, self.jobs, self.active), entries):
            mine.held = {k: tuple(v) for k, *v in there}

    def held(self, queue: str | None, before: list | None) -> list:
        """What the next part says of the queue; the entries of a long one are written to the maps."""
        counts = [self.seq, self.head, self.tail, self.busy]
        mine = (self.line, self.jobs, self.active)
        if not self.line.known:
            entries = [[[k, *v] for k, v in x.held.items() if v is not None] for x in mine]
            if sum(map(len, entries)) <= SHORT:
                return counts + entries
        for x in mine:
            x.write()
        return counts


def job_queue(events: DataFrame, capacity: int = QUEUE, workers: int = WORKERS) -> DataFrame:
    """A stream of TRANSITIONS out of events (queue, ts, event, job_id, path): requests of a `folder` or a single `content`, and how jobs end.

    A folder with an active job of the same normalised path is its duplicate. Single contents are refused where the queue is full, folders wait. Free
    workers take what is first in line. Queues are apart, as each has one line, and are dealt into buckets, each of which is one key of the state.
    """
    use_entry_state(events.sparkSession)
    bucket = F.pmod(F.xxhash64("queue"), F.lit(BUCKETS)).cast("int").alias("bucket")
    own = events.select(bucket, "queue", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event", "job_id", normalize_path(F.col("path")).alias("norm"))
    out = own.groupBy("bucket").transformWithStateInPandas(BucketProcessor(capacity, workers), TRANSITIONS.replace("ts timestamp", "us long"), "Append", "None")
    return out.select("queue", "seq", F.timestamp_micros("us").alias("ts"), "job_id", "state", "run_by")


def current_states(transitions: DataFrame) -> DataFrame:
    """(queue, job_id, state, run_by, since): where each job is, of the transitions that a stream has written."""
    last = F.max_by(F.struct("state", "run_by", "ts"), "seq").alias("s")
    return transitions.groupBy("queue", "job_id").agg(last).select("queue", "job_id", "s.state", "s.run_by", F.col("s.ts").alias("since"))
