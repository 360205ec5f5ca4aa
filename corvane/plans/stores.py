"""Queries over stored versions, archives and streams that Spark makes of the tables, and over rules of days."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixtures as X
from ..sources import archives as A
from ..sources.snapshots import SnapshotTable
from ..storage import Stored
from ..streaming import timers as T
from . import catalog as K
from .base import add
from .code_texts import _filled

# ---- tables of versions


def _versions(t: X.Tables) -> SnapshotTable:
    """Nations, then customers more, then those with an odd key alone and in upper case; a batch that is told twice is in once."""
    table = SnapshotTable(t.spark, f"{Stored(t.spark, 'versions').top}/table", "key long, name string")
    rows = t.customer.select(F.col("c_custkey").cast("long").alias("key"), F.col("c_name").alias("name"))
    table.append(t.nation.select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name")))
    for _ in range(2):
        table.append(rows, batch=0)
    table.update(lambda df: df.filter("key % 2 = 1").withColumn("name", F.upper("name")))
    return table


def _of_versions(t: X.Tables) -> DataFrame:
    table = _versions(t)
    return table.read(1).withColumn("version", F.lit(1)).unionByName(table.read(2).withColumn("version", F.lit(2))).unionByName(table.read().withColumn("version", F.lit(table.version())))


add("table_versions", _of_versions,
    """WITH a AS (SELECT n_nationkey::BIGINT AS key, n_name AS name FROM nation), b AS (SELECT * FROM a UNION ALL SELECT c_custkey::BIGINT, c_name FROM customer)
    SELECT *, 1 AS version FROM a UNION ALL SELECT *, 2 FROM b UNION ALL SELECT key, upper(name), 3 FROM b WHERE key % 2 = 1""")  # fmt: skip

# ---- archives


def _archive(t: X.Tables) -> str:
    """Feeds of parts, of so many entries at most, and papers of customers, written by Spark."""
    top = Stored(t.spark, "archive").top
    k = F.col("p_partkey").cast("string")
    entry = t.part.select(
        F.concat(F.lit("http://arxiv.org/abs/2401."), F.lpad(k, 5, "0"), F.lit("v1")).alias("id"), F.concat(F.lit("On  "), "p_name").alias("title"), F.col("p_type").alias("summary"),
        F.concat((2000 + F.col("p_partkey") % 25).cast("string"), F.lit("-01-02")).alias("published"), F.array(F.struct(F.col("p_brand").alias("name")), F.struct(F.lit("B").alias("name"))).alias("author"),
    )
    entry.write.format("xml").option("rootTag", "feed").option("rowTag", "entry").option("maxRecordsPerFile", 50_000).save(f"{top}/feeds")
    c = F.col("c_custkey")
    paper = F.struct(
        F.concat(F.lit("p"), c).alias("paperId"), F.concat(F.lit("About "), "c_name").alias("title"), F.when(c % 3 > 0, (1990 + c % 40).cast("int")).alias("year"), (c * 7 % 1000).cast("int").alias("citationCount"),
        F.array(F.struct(F.col("c_mktsegment").alias("name"))).alias("authors"), F.struct(F.concat(F.lit("10.1/"), c).alias("DOI")).alias("externalIds"),
    )
    t.customer.select(F.array(paper).alias("data")).write.json(f"{top}/papers")
    return top


_FEEDS = """SELECT '2401.' || lpad(p_partkey::VARCHAR, 5, '0') AS source_id, 'arxiv' AS source_type, 'On ' || p_name AS title, p_brand || ',B' AS authors, NULL::VARCHAR AS doi, (2000 + p_partkey % 25)::INTEGER AS year, NULL::INTEGER AS citation_count FROM part"""
_PAPERS = """SELECT 'p' || c_custkey AS source_id, 'paper' AS source_type, 'About ' || c_name AS title, c_mktsegment AS authors, '10.1/' || c_custkey AS doi, CASE WHEN c_custkey % 3 > 0 THEN 1990 + c_custkey % 40 END::INTEGER AS year, (c_custkey * 7 % 1000)::INTEGER AS citation_count FROM customer"""


def _shown(df: DataFrame) -> DataFrame:
    return df.select("source_id", "source_type", "title", F.array_join("authors", ",").alias("authors"), "doi", "year", "citation_count")


add("archive_sources", lambda t: _shown(A.read_archives(t.spark, _archive(t))), f"{_FEEDS} UNION ALL {_PAPERS}")
add("archive_pushed_year", lambda t: _shown(A.read_archives(t.spark, _archive(t), pushed=True).filter("year >= 2010 AND year <= 2015")), f"SELECT * FROM ({_FEEDS} UNION ALL {_PAPERS}) WHERE year BETWEEN 2010 AND 2015")
add("archive_typed", lambda t: _shown(A.read_archives(t.spark, _archive(t), ["paper"], (2020, None))), f"SELECT * FROM ({_PAPERS}) WHERE year >= 2020")
add("archive_search", lambda t: A.search(A.read_archives(t.spark, _archive(t)), "CUSTOMER#0000000", ["paper"], 15).select("source_id", "title", "citation_count"),
    f"SELECT source_id, title, citation_count FROM ({_PAPERS}) WHERE contains(lower(title), 'customer#0000000') ORDER BY citation_count DESC, title, source_id LIMIT 15")


def _asked(t: X.Tables) -> DataFrame:
    k = F.col("p_partkey")
    address = F.when(k % 3 == 0, F.concat(F.lit("https://arxiv.org/abs/2401."), F.lpad((k * 2).cast("string"), 5, "0"))).when(k % 3 == 1, F.concat(F.lit("https://api.semanticscholar.org/paper/p"), k)).otherwise(F.concat(F.lit("urn:"), k))
    return t.part.select(address.alias("address"))


add("archive_fetch", lambda t: A.fetch(A.read_archives(t.spark, _archive(t)), _asked(t)).select("address", "fetcher", "success", "error", "source_id"),
    f"""WITH a AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'arxiv' WHEN 1 THEN 'paper' END AS fetcher FROM part), w AS (SELECT *, CASE fetcher WHEN 'arxiv' THEN '2401.' || lpad((2 * k)::VARCHAR, 5, '0') WHEN 'paper' THEN 'p' || k END AS wanted FROM a),
    s AS ({_FEEDS} UNION ALL {_PAPERS})
    SELECT CASE fetcher WHEN 'arxiv' THEN 'https://arxiv.org/abs/' || wanted WHEN 'paper' THEN 'https://api.semanticscholar.org/paper/' || wanted ELSE 'urn:' || k END AS address, fetcher, source_id IS NOT NULL AS success,
      CASE WHEN fetcher IS NULL THEN 'No fetcher found for this URL or identifier' WHEN source_id IS NULL THEN 'Not found' END AS error, source_id FROM w LEFT JOIN s ON s.source_type = w.fetcher AND s.source_id = w.wanted""")  # fmt: skip

# ---- streams


def _streamed(t: X.Tables, batches: list[DataFrame], build: Callable[[DataFrame], DataFrame], by_file: bool = False) -> DataFrame:
    """What a stream over these batches, one at a time, writes until it has read them all.

    It goes on from its checkpoint after each batch; or it is started once and reads a file a batch, each of which one task writes.
    """
    top = Stored(t.spark, "stream").top
    for k, b in enumerate(batches):
        (b.coalesce(1) if by_file else b).write.parquet(f"{top}/in/{k}")
        if by_file and k < len(batches) - 1:
            continue
        source = t.spark.readStream.schema(batches[0].schema).option("recursiveFileLookup", "true")
        source = (source.option("maxFilesPerTrigger", 1) if by_file else source).parquet(f"{top}/in")
        q = build(source).writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    return t.spark.read.parquet(f"{top}/out")


def _by_timers(t: X.Tables) -> DataFrame:
    """All events in two batches by time; after them one of a workspace of its own lets the watermark pass every silence."""
    e = X.changes(t).select("ts", F.concat(F.lit("w"), F.col("event_id") % 16).alias("workspace"), "change_type", "path")
    cut = F.lit("2024-01-15").cast("timestamp")
    later = lambda days: t.events.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.make_dt_interval(F.lit(days))).alias("ts"), F.lit("none").alias("workspace"), F.lit("Created").alias("change_type"), F.lit("/none").alias("path"))
    parts = [e.filter(F.col("ts") < cut), e.filter(F.col("ts") >= cut), later(1), later(2)]
    return _streamed(t, parts, lambda s: T.debounce_timers(s, 600_000), by_file=True).filter("workspace <> 'none'")


add("debounce_timers", _by_timers, K.CATALOG["debounce_batch"].sql)

#: What happens to a customer's queue of one place and two workers, and the states that each step leads to: (event, job, path, [(job, state, run by)]).
_STEPS = [
    ("folder", "a", "/W/{k}", [("a", "Queued", "a"), ("a", "Processing", "a")]), ("folder", "b", "\\w\\{k}", [("b", "Duplicate", "a")]), ("folder", "c", "/x", [("c", "Queued", "c"), ("c", "Processing", "c")]),
    ("content", "d", None, [("d", "Queued", "d")]), ("content", "e", None, [("e", "Refused", "e")]), ("folder", "f", "/y", [("f", "Waiting", "f")]), ("completed", "a", None, [("a", "Completed", "a"), ("d", "Processing", "d"), ("f", "Queued", "f")]),
    ("folder", "g", "/w/{k}", [("g", "Waiting", "g")]), ("failed", "c", None, [("c", "Failed", "c"), ("f", "Processing", "f"), ("g", "Queued", "g")]), ("completed", "zz", None, []), ("cancelled", "f", None, [("f", "Cancelled", "f"), ("g", "Processing", "g")]),
]


def _queue_events(t: X.Tables) -> list[DataFrame]:
    """The steps of all customers, in two batches; every third customer's queue is told of no more after the sixth."""
    k = F.col("c_custkey")
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(e).alias("event"), F.lit(j).alias("job"), (_filled(p, k=k) if p else F.lit(None).cast("string")).alias("path")) for i, (e, j, p, _) in enumerate(_STEPS)])
    dealt = t.customer.select(k).repartition(t.spark.sparkContext.defaultParallelism)  # a small file becomes many rows
    e = dealt.select(F.concat(F.lit("q"), k).alias("queue"), k, F.explode(rows).alias("s")).filter("c_custkey % 3 > 0 OR s.i < 6")
    ts = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("s.i"))
    own = e.select("queue", ts.alias("ts"), "s.event", F.col("s.job").alias("job_id"), "s.path", F.col("s.i").alias("i"))
    return [own.filter("i < 6").drop("i"), own.filter("i >= 6").drop("i")]


_TRANSITIONS = [(i, *x) for i, s in enumerate(_STEPS) for x in s[3]]
_QUEUE_SQL = " UNION ALL ".join(
    f"SELECT 'q' || c_custkey AS queue, {n} AS seq, make_timestamp({(1704067200 + i) * 1000000}) AS ts, '{job}' AS job_id, '{state}' AS state, '{by}' AS run_by FROM customer" + (" WHERE c_custkey % 3 > 0" if i >= 6 else "") for n, (i, job, state, by) in enumerate(_TRANSITIONS)
)
add("job_queue", lambda t: _streamed(t, _queue_events(t), lambda s: T.job_queue(s, capacity=1, workers=2)).withColumn("ts", F.col("ts").cast("timestamp")), _QUEUE_SQL)
add("job_queue_states", lambda t: T.current_states(_streamed(t, _queue_events(t), lambda s: T.job_queue(s, capacity=1, workers=2))).groupBy("job_id", "state").agg(F.count(F.lit(1)).alias("n")),
    f"SELECT job_id, state, count(*) AS n FROM (SELECT queue, job_id, arg_max(state, seq) AS state FROM ({_QUEUE_SQL}) GROUP BY 1, 2) GROUP BY 1, 2")

# ---- rules of days


def _rules(t: X.Tables) -> DataFrame:
    from ..functions.cron import next_run
    from ..shipping import ship_package

    ship_package(t.spark)
    own = t.orders.select(F.col("o_orderdate").cast("timestamp").alias("since")).distinct()
    rules = {"last_day": "0 0 L * *", "third_before": "0 6 L-3 * ?", "last_weekday": "0 0 LW * *", "last_friday": "30 12 ? * FRIL", "second_tuesday": "0 0 * * 2#2", "near_first": "0 0 1W * *"}
    return own.select("since", *[next_run(F.lit(r), F.col("since")).alias(n) for n, r in rules.items()])


def _day_sql(name: str, day: str, time: str = "INTERVAL 0 MINUTE") -> str:
    """The first of this and the next two months' days, by an expression of the first of a month `m`, that is after `since`."""
    months = ", ".join(f"(SELECT min(x) FROM (SELECT ({day}) + {time} AS x FROM (SELECT (date_trunc('month', since) + INTERVAL {k} MONTH)::DATE AS m)) WHERE x > since)" for k in range(3))
    return f"least({months}) AS {name}"


_LAST = "last_day(m)"
_ON = "(m + (({d} - dayofweek(m) + 7) % 7)::INTEGER)"  # the first such day of the week in the month
add("day_rules", _rules,
    "SELECT since, " + ", ".join([
        _day_sql("last_day", _LAST), _day_sql("third_before", f"{_LAST} - 3", "INTERVAL 6 HOUR"), _day_sql("last_weekday", f"CASE dayofweek({_LAST}) WHEN 6 THEN {_LAST} - 1 WHEN 0 THEN {_LAST} - 2 ELSE {_LAST} END"),
        _day_sql("last_friday", f"{_LAST} - ((dayofweek({_LAST}) - 5 + 7) % 7)::INTEGER", "INTERVAL 750 MINUTE"), _day_sql("second_tuesday", f"{_ON.format(d=2)} + 7"),
        _day_sql("near_first", "CASE dayofweek(m) WHEN 6 THEN m + 2 WHEN 0 THEN m + 1 ELSE m END"),
    ]) + " FROM (SELECT DISTINCT o_orderdate::TIMESTAMP AS since FROM orders)")
