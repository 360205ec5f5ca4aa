"""Change streams: the debounce rule as a batch and as a stream, renames, and application."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corvane.functions.cron import next_time
from corvane.streaming import changes as CH

from corvane.streaming import jobs as J
from corvane.streaming import timers as T

T0 = dt.datetime(2024, 1, 1)


def at(ms):
    return T0 + dt.timedelta(milliseconds=ms)


EVENTS = [(0, "w", "Created", "a"), (300, "w", "Created", "a"), (450, "w", "Modified", "a"), (940, "w", "Created", "a"), (960, "w", "Created", "b"), (0, "v", "Deleted", "z")]


def expected():
    # A duplicate doesn't restart the silence: the set of 0 and 450 leaves at 950, before the event at 960.
    return {("w", 0, "Created", "a"), ("w", 0, "Modified", "a"), ("w", 960, "Created", "b"), ("v", 0, "Deleted", "z")}


def seen(rows):
    return {(r.workspace, int((r.batch_start - T0).total_seconds() * 1000), r.change_type, r.path) for r in rows}


def test_batch(spark):
    df = spark.createDataFrame([(at(m), w, c, p) for m, w, c, p in EVENTS], "ts timestamp, workspace string, change_type string, path string")
    assert seen(CH.debounce_batch(df).collect()) == expected()


def test_stream(spark, tmp_path):
    schema = "ts timestamp, workspace string, change_type string, path string"
    rows = [(at(m), w, c, p) for m, w, c, p in EVENTS]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / "0"))
    spark.createDataFrame([(at(60_000), "x", "Created", "s")], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    spark.createDataFrame([(at(120_000), "x", "Created", "s")], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "2"))
    source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = CH.debounce_stream(source).writeStream.format("memory").queryName("debounced").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {x for x in seen(spark.sql("SELECT * FROM debounced").collect()) if x[0] in "wv"}
    assert got == expected()


def test_renames(spark):
    df = spark.createDataFrame([(at(0), "w", "Renamed", "old", "new"), (at(1), "w", "Created", None, "c")], "ts timestamp, workspace string, change_type string, old_path string, path string")
    assert sorted((r.change_type, r.path) for r in CH.with_renames(df).collect()) == [("Created", "c"), ("Created", "new"), ("Deleted", "old")]


def test_apply(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "source_path string, content string")
    changes = spark.createDataFrame([(1, "Modified", "a"), (2, "Deleted", "a"), (1, "Deleted", "b"), (2, "Created", "b"), (1, "Created", "d")], "seq int, change_type string, path string")
    ingest = lambda files: files.select(F.col("path").alias("source_path"), F.lit("new").alias("content"))
    assert sorted(map(tuple, CH.apply_changes(chunks, changes, ingest).collect())) == [("b", "new"), ("c", "3"), ("d", "new")]
    published = []
    sink = CH.change_sink(lambda n: str(tmp_path / f"s{n}"), lambda: chunks, ingest, published.append)
    batch = spark.createDataFrame([("w", at(0), at(1), "Deleted", "c")], CH.BATCHES)
    sink(batch, 7)
    sink(batch, 7)
    assert sorted(r.source_path for r in spark.read.parquet(published[-1]).collect()) == ["a", "b"]


@pytest.mark.parametrize("kind,queued,accepted", [("folder", 10_000, True), ("content", 10_000, False), ("content", 9_999, True)])
def test_admission(spark, kind, queued, accepted):
    r = spark.createDataFrame([("j", kind, at(0))], "job_id string, kind string, requested_at timestamp")
    assert J.admitted(r, queued).first().accepted is accepted


def test_dedupe_stream(spark, tmp_path):
    spark.createDataFrame([("1", "C:\\A", at(0)), ("2", "c:/a", at(5)), ("3", "/b", at(5))], "job_id string, path string, requested_at timestamp").coalesce(1).write.json(str(tmp_path / "q"))
    q = J.dedupe_stream(J.request_stream(spark, str(tmp_path / "q"))).writeStream.format("memory").queryName("requests").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.sql("SELECT * FROM requests").count() == 2


# ---- state by entry: timers and the queue


def run_stream(spark, build, source, out, checkpoint):
    """One run over what there is, into a folder, from the checkpoint on."""
    q = build(source).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).outputMode("append").start()
    try:
        q.awaitTermination(240)
        assert q.exception() is None
    finally:
        q.stop()


def add_file(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").json(str(folder / name))


def test_debounce_by_timers_goes_on_after_a_restart(spark, tmp_path):
    schema = "ts timestamp, workspace string, change_type string, path string"
    rng = random.Random(5)
    events = [(at(k * 60 + rng.randrange(60)), rng.choice("wv"), rng.choice(["Created", "Modified"]), rng.choice("abcdef")) for k in range(0, 400) if k % 40 < 25]
    third = len(events) // 3
    sets = [events[:third], events[third : 2 * third], events[2 * third :], [(at(10**6), "x", "Created", "s")], [(at(2 * 10**6), "x", "Created", "s")]]
    source = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    for k, rows in enumerate(sets):  # each in a run of its own, so that what is pending comes from the checkpoint
        add_file(spark, tmp_path / "in", str(k), rows, schema)
        run_stream(spark, T.debounce_timers, source(), tmp_path / "out", tmp_path / "cp")
    got = {x for x in seen(spark.read.parquet(str(tmp_path / "out")).collect()) if x[0] in "wv"}
    want = seen(CH.debounce_batch(spark.createDataFrame(events, schema)).collect())
    assert got == want and len({(w, s) for w, s, _, _ in want}) > 4


def simulate(events, capacity, workers):
    """The queue as plain lists."""
    line, running, active, out = [], set(), {}, []
    known = set()
    order = {"completed": 0, "failed": 1, "cancelled": 2, "folder": 3, "content": 4}
    state = {}
    for ts, event, job, path in sorted(events, key=lambda e: (e[0], order[e[1]], e[2])):
        if order[event] < 3:
            if job in running:
                running.remove(job)
                known.discard(job)
                active = {p: j for p, j in active.items() if j != job}
                out.append((job, event.capitalize(), job))
        elif job in known:
            continue
        elif event == "folder" and path.lower() in active:
            out.append((job, "Duplicate", active[path.lower()]))
            continue
        elif event == "content" and len(line) >= capacity:
            out.append((job, "Refused", job))
            continue
        else:
            known.add(job)
            if event == "folder":
                active[path.lower()] = job
            state[job] = "Queued" if len(line) < capacity else "Waiting"
            line.append(job)
            out.append((job, state[job], job))
        while len(running) < workers and line:
            first = line.pop(0)
            running.add(first)
            out.append((first, "Processing", first))
            if len(line) >= capacity and state[line[capacity - 1]] == "Waiting":
                state[line[capacity - 1]] = "Queued"
                out.append((line[capacity - 1], "Queued", line[capacity - 1]))
    return out


def test_job_queue_follows_the_rule_over_restarts(spark, tmp_path):
    schema = "queue string, ts timestamp, event string, job_id string, path string"
    rng = random.Random(3)
    events, asked = [], 0
    for k in range(180):
        if rng.random() < 0.55 or not asked:
            asked += 1
            kind = rng.choice(["folder", "folder", "content"])
            events.append((at(k * 1000), kind, f"j{asked:03d}", rng.choice("ABCDEFGHIJKLMNOP") if kind == "folder" else None))
        else:
            events.append((at(k * 1000), rng.choice(["completed", "failed", "cancelled"]), f"j{max(1, asked - rng.randrange(12)):03d}", None))
    for n in range(3):
        part = events[n * 60 : (n + 1) * 60]
        add_file(spark, tmp_path / "in", str(n), [("q", *e) for e in part] + [("other", *e) for e in part], schema)
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
        run_stream(spark, lambda s: T.job_queue(s, capacity=4, workers=2), source, tmp_path / "out", tmp_path / "cp")
    rows = spark.read.parquet(str(tmp_path / "out"))
    want = simulate(events, 4, 2)
    assert {s for _, s, _ in want} == {"Queued", "Waiting", "Processing", "Completed", "Failed", "Cancelled", "Duplicate", "Refused"}
    for queue in ("q", "other"):
        assert [(r.job_id, r.state, r.run_by) for r in rows.filter(F.col("queue") == queue).orderBy("seq").collect()] == want
    last = {j: s for j, s, _ in want}
    assert {r.job_id: r.state for r in T.current_states(rows.filter("queue = 'q'")).collect()} == last


#: Next times worked out by hand with a calendar; Monday 1 January 2024 is the start unless another is given.
RULES = [
    ("0 9 L * *", "2024-01-31 09:00"), ("0 9 L 2 ?", "2024-02-29 09:00"), ("30 6 L-3 * *", "2024-01-28 06:30"), ("0 0 15W 6 ?", "2024-06-14 00:00"), ("0 0 1W 6 *", "2024-06-03 00:00"), ("0 0 30W 6 *", "2024-06-28 00:00"),
    ("0 0 LW 3 *", "2024-03-29 00:00"), ("0 0 LW 6 *", "2024-06-28 00:00"), ("0 12 ? * 5L", "2024-01-26 12:00"), ("0 12 * * FRIL", "2024-01-26 12:00"), ("0 12 ? * 1#2", "2024-01-08 12:00"), ("0 12 ? * MON#5", "2024-01-29 12:00"), ("0 0 ? 2 4#5", "2024-02-29 00:00"),
    ("0 0 * * 7L", "2024-01-28 00:00"), ("0 0 L,15 * *", "2024-01-15 00:00"), ("0 0 13 * 5", "2024-09-13 00:00"), ("0 22-1 * * *", "2024-01-01 01:00"), ("0 0 * * FRI-MON", "2024-01-05 00:00"), ("@weekly", "2024-01-07 00:00"), ("@hourly", "2024-01-01 01:00"),
    ("0 0 31W 2 *", None), ("0 0 W * *", None), ("0 0 32 * *", None), ("0 0 ? ? *", None), ("0 0 * * 5#6", None), ("0 0 L-31 * *", None), ("? * * * *", None), ("x", None), ("0 0 ** * *", None),
]


@pytest.mark.parametrize("rule,want", RULES)
def test_rules_of_days(rule, want):
    start = int(dt.datetime(2024, 1, 1, tzinfo=dt.UTC).timestamp())
    found = next_time(rule, start)
    assert (found and dt.datetime.fromtimestamp(found, dt.UTC).strftime("%Y-%m-%d %H:%M")) == want


def test_a_queue_asks_its_state_little():
    """Entries of a new queue aren't read, those of a known one once, and only what is left is written."""
    calls = []

    class State:
        def __init__(self):
            self.rows = {}

        def getValue(self, key):  # noqa: N802
            calls.append("get")
            return self.rows.get(key)

        def updateValue(self, key, value):  # noqa: N802
            calls.append("put")
            self.rows[key] = value

        def removeKey(self, key):  # noqa: N802
            calls.append("remove")
            self.rows.pop(key, None)

        containsKey = lambda self, key: calls.append("has") or key in self.rows  # noqa: E731, N815

    class Value(State):
        get = lambda self: calls.append("get") or self.rows.get(0)
        update = lambda self, value: self.updateValue(0, value)

    class Handle:
        getMapState = lambda self, *a: State()  # noqa: E731, N815
        getValueState = lambda self, *a: Value()  # noqa: E731, N815

    from pyspark.sql import Row

    p = T.QueueProcessor(1, 2)
    p.init(Handle())
    ask = lambda *es: [(r.job_id, r.state) for r in p.handleInputRows(("q",), iter([Row(ts=k, event=e, job_id=j, norm=n) for k, (e, j, n) in enumerate(es)]), None)]
    assert ask(("folder", "a", "/a"), ("folder", "b", "/a"), ("folder", "c", "/c")) == [("a", "Queued"), ("a", "Processing"), ("b", "Duplicate"), ("c", "Queued"), ("c", "Processing")]
    assert sorted(calls) == ["get"] + ["put"] * 5  # two jobs, two folders, the counters
    calls.clear()
    assert ask(("completed", "a", None), ("folder", "a", "/a")) == [("a", "Completed"), ("a", "Queued"), ("a", "Processing")]
    assert len(calls) <= 6


class States:
    """The states of one key as plain lists and dicts, that count calls."""

    def __init__(self):
        self.calls, self.made = 0, {}

    def _state(self, name, start):
        outer = self

        class State:
            rows = start

            def get(self):
                outer.calls += 1
                return iter(self.rows)

            def put(self, rows):
                outer.calls += 1
                self.rows = list(rows)

            def appendList(self, rows):  # noqa: N802
                outer.calls += 1
                self.rows = self.rows + list(rows)

            def getValue(self, key):  # noqa: N802
                outer.calls += 1
                return self.rows.get(key)

            def updateValue(self, key, value):  # noqa: N802
                outer.calls += 1
                self.rows[key] = value

            def removeKey(self, key):  # noqa: N802
                outer.calls += 1
                del self.rows[key]

        return self.made.setdefault(name, State())

    getListState = lambda self, name, *a: self._state(name, [])  # noqa: E731, N815
    getMapState = lambda self, name, *a: self._state(name, {})  # noqa: E731, N815


def told(p, events):
    """The transitions of a call with these (queue, ms, event, job, path), by queue."""
    import pandas as pd

    df = pd.DataFrame([(q, ms, e, j, n and n.lower()) for q, ms, e, j, n in events], columns=["queue", "us", "event", "job_id", "norm"])
    out = {}
    for x in p.handleInputRows((0,), iter([df.iloc[: len(df) // 2], df.iloc[len(df) // 2 :]]), None):
        for r in x.itertuples():
            assert r.seq == len(p.seen.setdefault(r.queue, []))
            p.seen[r.queue].append((r.job_id, r.state, r.run_by))
            out.setdefault(r.queue, []).append((r.job_id, r.state, r.run_by))
    return out


@pytest.mark.parametrize("short,parts", [(256, 8), (5, 2), (0, 1)])
def test_a_bucket_follows_the_rule_of_each_queue(monkeypatch, short, parts):
    """However little a bucket holds itself, each of its queues is as it would be alone."""
    monkeypatch.setattr(T, "SHORT", short)
    monkeypatch.setattr(T, "PARTS", parts)
    rng = random.Random(5)
    queues = {f"q{k}": [] for k in range(7)} | {None: []}
    for events in queues.values():
        asked = 0
        for k in range(rng.randrange(40, 160)):
            if rng.random() < 0.55 or not asked:
                asked += 1
                kind = rng.choice(["folder", "folder", "content"])
                events.append((k, kind, f"j{asked:03d}", rng.choice("ABCDEFGHIJKLMNOP") if kind == "folder" else None))
            else:
                events.append((k, rng.choice(["completed", "failed", "cancelled"]), f"j{max(1, asked - rng.randrange(12)):03d}", None))
    states = States()
    at = 0
    seen = {}
    while at < 160:
        p = T.BucketProcessor(4, 2)  # as after a restart
        p.seen = seen
        p.init(states)
        step = rng.randrange(1, 25)
        told(p, [(q, *e) for q, events in queues.items() if at % 3 or q != "q1" for e in events if at <= e[0] < at + step] or [("q0", 999, "completed", "none", None)])
        if not at % 3:
            told(p, [("q1", *e) for e in queues["q1"] if at <= e[0] < at + step] or [("q1", 999, "completed", "none", None)])
        at += step
    for q, events in queues.items():
        assert seen[q] == simulate(events, 4, 2)
    assert len(states.made["parts"].rows) <= parts
    assert bool(states.made["jobs"].rows) == (short < 256)


def test_a_bucket_asks_its_state_twice():
    """Calls of a state don't grow with the queues: each costs a way to the executor's JVM and back."""
    states = States()
    p = T.BucketProcessor(1, 2)
    p.seen = {}
    p.init(states)
    first = [(f"q{k}", i, "folder", j, f"/{j}") for k in range(500) for i, j in enumerate("abcd")]
    assert told(p, first)["q7"] == [("a", "Queued", "a"), ("a", "Processing", "a"), ("b", "Queued", "b"), ("b", "Processing", "b"), ("c", "Queued", "c"), ("d", "Waiting", "d")]
    assert states.calls == 2
    assert told(p, [(f"q{k}", 9, "completed", "a", None) for k in range(500)])["q499"] == [("a", "Completed", "a"), ("c", "Processing", "c"), ("d", "Queued", "d")]
    assert states.calls == 4


def test_a_batch_of_a_stream_is_read_from_all_its_files(spark):
    from corvane.fixtures import Tables
    from corvane.plans import stores

    batches = [spark.range(30).repartition(3), spark.range(30, 40).repartition(2)]
    rows = stores._streamed(Tables(spark, ""), batches, lambda s: s.select("id", F.input_file_name().alias("file"))).collect()
    assert sorted(r.id for r in rows) == list(range(40)) and len({r.file for r in rows}) == 5
