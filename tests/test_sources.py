"""Archives as a data source, a watched folder as a stream, and tables of versions."""

import json
import os
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from corvane.sources import archives as A
from corvane.sources import watched as W
from corvane.sources.snapshots import Conflict, SnapshotTable
from corvane.streaming import changes as CH

FEED = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><id>http://arxiv.org/abs/2401.00001v2</id><title>On\n  graphs</title><summary> Of  graphs. </summary><published>2024-01-02</published><author><name>A</name></author><author><name>B</name></author></entry></feed>"
PAPERS = json.dumps({"data": [{"paperId": "p1", "title": "Graphs of old", "year": 2019, "citationCount": 7, "authors": [{"name": "C"}], "externalIds": {"DOI": "10.1/x"}}, {"paperId": "p2", "title": "Trees"}]})
PAGE = '<html><head><title> Page &amp; graphs </title><link rel="canonical" href="https://x.org/1"><meta name="author" content="D"></head><body><script>var a="<b>";</script><p>Hello <b>you</b></p></body></html>'


@pytest.fixture
def archive(tmp_path):
    top = tmp_path / "in"
    top.mkdir()
    (top / "a.xml").write_text(FEED)
    (top / "b.json").write_text(PAPERS)
    (top / "broken.json").write_text("{")
    (top / "broken.zip").write_text("no zip")
    (top / "other.txt").write_text("x")
    with zipfile.ZipFile(top / "more.zip", "w") as z:
        z.writestr("p/1.html", PAGE)
        z.writestr("p/2.xml", FEED.replace("00001", "00002").replace("2024-", "2018-"))
        z.writestr("p/3.bin", b"\x00")
    return str(top)


def test_archives(spark, archive):
    df = A.read_archives(spark, archive)
    rows = {r.source_id: r for r in df.collect()}
    assert len(rows) == df.count() == 5
    assert (rows["2401.00001"].title, rows["2401.00001"].authors, rows["2401.00001"].abstract, rows["2401.00001"].year) == ("On graphs", ["A", "B"], "Of graphs.", 2024)
    assert (rows["p1"].doi, rows["p1"].citation_count, rows["p2"].authors, rows["p2"].year) == ("10.1/x", 7, None, None)
    page = next(r for r in rows.values() if r.source_type == "web")
    assert (page.title, page.url, page.authors, page.abstract, page.archive, page.entry) == ("Page & graphs", "https://x.org/1", ["D"], "Page & graphs Hello you", "more.zip", "p/1.html")


def test_filters_are_pushed(spark, archive):
    load = lambda: A.read_archives(spark, archive, pushed=True)
    new = load().filter("year >= 2019 AND length(title) > 3")
    plan = new._jdf.queryExecution().executedPlan().toString()
    condition = [line for line in plan.split("\n") if "Filter" in line]
    assert all("year" not in line.split("PushedFilters")[0] or "Scan" in line for line in condition) and any("length" in line for line in condition)
    assert sorted(r.source_id for r in new.collect()) == ["2401.00001", "p1"]
    assert load().filter("source_type = 'web'").count() == 1 and load().filter("source_id IN ('p2', 'none')").count() == 1 and load().filter("year < 2019").count() == 1
    reader = A.PushedReader(archive, 1, [])
    assert list(reader.pushFilters([A.EqualTo(("source_type",), "paper"), A.EqualTo(("title",), "x")])) == [A.EqualTo(("title",), "x")]
    names = [p.rsplit("/", 1)[-1] for part in reader.partitions() for p in part.paths]
    assert names == ["b.json", "broken.json", "broken.zip", "more.zip"] and len(reader.partitions()) == 4
    assert [r[0] for part in reader.partitions() for r in reader.read(part)] == ["p1", "p2"]


def test_options_and_several_uses_of_one_load(spark, archive):
    df = A.read_archives(spark, archive)
    both = df.filter("source_type = 'paper'").unionByName(df.filter("year < 2019"))
    assert sorted(r.source_id for r in both.collect()) == ["2401.00002", "p1", "p2"]
    some = A.read_archives(spark, archive, ["paper", "arxiv"], (2019, 2023))
    assert [r.source_id for r in some.collect()] == ["p1"]


def test_search_and_fetch(spark, archive):
    df = A.read_archives(spark, archive)
    assert [r.source_id for r in A.search(df, "GRAPHS", limit=2).collect()] == ["p1", "2401.00001"]
    assert [r.source_type for r in A.search(df, "graphs", ["Web"]).collect()] == ["web"]
    assert A.search(df, "graphs", ["none"]).count() == 0
    asked = spark.createDataFrame([("https://arxiv.org/abs/2401.00002",), ("2401.00001v3",), ("https://api.semanticscholar.org/paper/p1",), ("https://x.org/1",), ("https://x.org/2",), ("what",)], "address string")
    got = {r.address: (r.fetcher, r.success, r.error, r.title) for r in A.fetch(df, asked).collect()}
    assert got == {
        "https://arxiv.org/abs/2401.00002": ("arxiv", True, None, "On graphs"), "2401.00001v3": ("arxiv", True, None, "On graphs"), "https://api.semanticscholar.org/paper/p1": ("paper", True, None, "Graphs of old"),
        "https://x.org/1": ("web", True, None, "Page & graphs"), "https://x.org/2": ("web", False, "Not found", None), "what": (None, False, "No fetcher found for this URL or identifier", "Unknown"),
    }


def test_every_source_of_an_identifier_is_fetched(spark, tmp_path):
    (tmp_path / "a.xml").write_text(FEED)
    (tmp_path / "b.xml").write_text(FEED.replace("graphs", "trees"))
    asked = spark.createDataFrame([("2401.00001",), ("2401.00003",)], "address string")
    got = A.fetch(A.read_archives(spark, str(tmp_path)), asked).collect()
    assert sorted((r.address, r.success, r.title or "") for r in got) == [("2401.00001", True, "On graphs"), ("2401.00001", True, "On trees"), ("2401.00003", False, "")]


def test_large_files_are_read_in_parts(tmp_path):
    import tracemalloc

    top = tmp_path / "in"
    top.mkdir()
    papers = "\n".join(json.dumps({"data": [{"paperId": f"p{k}", "title": "T" * 100, "year": 2000}]}) for k in range(60_000))
    (top / "a.json").write_text("\n" + papers)
    (top / "b.xml").write_text("<feed>" + "".join(f"<entry><id>http://arxiv.org/abs/2401.{k:05d}</id><summary>{'s' * 100}</summary></entry>" for k in range(60_000)) + "</feed>")
    (top / "c.xml").write_text("<feed>" + "<entry><id>x</id></entry>" * 100_000 + "</fed>")  # broken at its end
    (top / "d.json").write_text('{"data": [\n' + papers)  # torn in its first line, but no document
    with zipfile.ZipFile(top / "e.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.json", papers)
    reader = A.ArchiveReader(str(top), 2 << 20, [])
    parts = reader.partitions()
    assert len(parts) > 8 and sum("a.json" in p for part in parts for p in part.paths) > 3
    tracemalloc.start()
    try:
        got = {}
        for part in parts:
            for r in reader.read(part):
                got[r[9]] = got.get(r[9], 0) + 1
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got == {"a.json": 60_000, "b.xml": 60_000, "d.json": 60_000, "e.zip": 60_000}
    assert peak < 24 << 20
    for most in (1 << 20, 3 << 20, 1 << 30):
        reader = A.ArchiveReader(str(top), most, [])
        assert sorted(r[0] for part in reader.partitions() for r in reader.read(part) if r[9] == "a.json") == sorted(f"p{k}" for k in range(60_000))


def test_what_has_no_papers_form(spark, tmp_path):
    lines = ["5", "[1]", '{"data": 3}', '{"data": [7, {"paperId": 8, "title": "\\ud800x", "year": "2020", "citationCount": 99999999999, "authors": [1, {"name": "A"}], "externalIds": []}]}', "[" * 100_000, '{"data": [{"paperId": "p2", "year": 2021}]}']
    (tmp_path / "a.json").write_text("\n".join(lines))
    (tmp_path / "b.json").write_text(json.dumps({"data": [{"paperId": "p3", "year": 2022}]}, indent=1))
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("a.json", PAPERS)
        z.writestr("b.json", PAPERS.replace("p1", "p4"))
    data = (tmp_path / "c.zip").read_bytes()
    (tmp_path / "c.zip").write_bytes(data.replace(b"Graphs", b"graphs", 1))  # the first entry's checksum is wrong
    rows = {r.source_id: r for r in A.read_archives(spark, str(tmp_path)).collect()}
    assert set(rows) == {"8", "p2", "p3", "p4"}
    assert (rows["8"].title, rows["8"].year, rows["8"].citation_count, rows["8"].authors, rows["8"].doi) == ("?x", None, None, ["A"], None)
    assert sorted(r.source_id for r in A.read_archives(spark, str(tmp_path), ["paper"], (2021, None)).collect()) == ["p2", "p3"]


def test_an_empty_file_comes_first(spark, tmp_path):
    (tmp_path / "a.json").write_text("")  # as Spark writes an empty partition
    (tmp_path / "b.json").write_text(PAPERS)
    (tmp_path / "c.xml").write_text(FEED)
    assert sorted(r.source_id for r in A.read_archives(spark, str(tmp_path), ["paper"]).collect()) == ["p1", "p2"]
    assert [r.source_id for r in A.read_archives(spark, str(tmp_path), ["paper"], (2019, None)).collect()] == ["p1"]
    assert [p.paths for p in A.ArchiveReader(str(tmp_path), 1, []).partitions()] == [[str(tmp_path / n)] for n in ("a.json", "b.json", "c.xml")]


def test_empty_archive(spark, tmp_path):
    assert A.read_archives(spark, str(tmp_path)).count() == 0


# ---- a watched folder


def seen_by(spark, top, tmp_path, out):
    """One run over what there is, from the checkpoint on."""

    def keep(batch, number):
        out.append((number, sorted((r.change_type, os.path.basename(r.path), r.old_path and os.path.basename(r.old_path)) for r in batch.collect())))

    q = W.watch(spark, str(top), str(tmp_path / "listings"), "*.md,*.py").writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        q.awaitTermination(120)
        assert q.exception() is None
    finally:
        q.stop()


def test_watched_folder(spark, tmp_path):
    top = tmp_path / "w"
    (top / "sub").mkdir(parents=True)
    (top / "a.md").write_text("one")
    (top / "sub" / "b.py").write_text("two")
    (top / "c.txt").write_text("not watched")
    out = []
    seen_by(spark, top, tmp_path, out)
    assert out == [(0, [("Created", "a.md", None), ("Created", "b.py", None)])]
    seen_by(spark, top, tmp_path, out)
    assert len(out) == 1  # a restart repeats nothing
    (top / "a.md").write_text("changed")
    os.rename(top / "sub" / "b.py", top / "moved.py")
    (top / "new.md").write_text("new")
    seen_by(spark, top, tmp_path, out)
    assert out[1:] == [(1, [("Created", "new.md", None), ("Modified", "a.md", None), ("Renamed", "moved.py", "b.py")])]
    os.remove(top / "new.md")
    os.utime(top / "a.md", (1, 1))  # touched, with the same content
    seen_by(spark, top, tmp_path, out)
    assert out[2:] == [(2, [("Deleted", "new.md", None)])]
    kept = [n for n in os.listdir(tmp_path / "listings") if n.endswith(".json")]
    assert len(kept) <= 2


def test_changes_of_listings():
    e = lambda h, t=0: (len(h), t, h)
    before = {"a": e("1"), "b": e("2"), "c": e("2"), "d": e("3")}
    after = {"a": e("1", 5), "e": e("2"), "f": e("4"), "d": e("9")}
    assert list(W.differences(before, after)) == [("Deleted", "c", None), ("Modified", "d", None), ("Renamed", "e", "b"), ("Created", "f", None)]
    assert list(W.differences({}, {})) == []


# ---- versions


def test_versions(spark, tmp_path):
    t = SnapshotTable(spark, f"file://{tmp_path}/t", "id long, v string")
    rows = lambda *ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, v string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert t.version() == 0 and ids(t.read()) == []
    assert t.append(rows(1, 2)) == 1
    pinned = t.read()
    assert t.append(rows(3)) == 2 and t.update(lambda df: df.filter("id <> 1")) == 3
    assert ids(pinned) == [1, 2] and ids(t.read(2)) == [1, 2, 3] and ids(t.read()) == [2, 3]
    # Two writers that began at one version: the second one doesn't win, and is told so.
    base = t.version()
    assert t.replace(rows(10), base) == 4
    with pytest.raises(Conflict):
        t.replace(rows(11), base)
    with pytest.raises(Conflict):
        t._commit(base, {"folders": [], "batch": None})
    assert ids(t.read()) == [10]
    # An update meets another one's commit and is made anew.
    met = []

    def change(df):
        if not met:
            met.append(t.append(rows(20)))
        return df.withColumn("v", F.upper("v"))

    assert t.update(change) == 6 and sorted(r.v for r in t.read().collect()) == ["V10", "V20"]
    assert t.update(lambda df: df.filter("id = 10"), batch=5) == 7 and t.update(lambda df: df.limit(0), batch=5) == 7 and t.append(rows(9), batch=4) == 7
    with pytest.raises(Exception, match="raised here"):
        t.append(rows(1).select("id", F.raise_error(F.lit("raised here")).cast("string").alias("v")))
    assert t.version() == 7 and ids(t.read()) == [10]
    gone = t.vacuum(2)
    assert len(gone) > 3 and ids(t.read()) == [10] and ids(t.read(6)) == [10, 20]


def test_many_writers_lose_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    failed = []

    def write(k):
        try:
            SnapshotTable(spark, path, "id long").append(spark.createDataFrame([(k,)], "id long"))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    t = SnapshotTable(spark, path, "id long")
    assert not failed and t.version() == 6 and sorted(r.id for r in t.read().collect()) == list(range(6))


def test_change_sink_over_versions(spark, tmp_path):
    t = SnapshotTable(spark, f"file://{tmp_path}/t", "source_path string, content string")
    t.append(spark.createDataFrame([("a", "1"), ("b", "2")], "source_path string, content string"))
    sink = CH.snapshot_sink(t, lambda files: files.select(F.col("path").alias("source_path"), F.lit("new").alias("content")))
    batch = spark.sql("SELECT 'w' AS workspace, timestamp'2024-01-01' AS batch_start, timestamp'2024-01-01' AS batch_end, t AS change_type, p AS path FROM VALUES ('Deleted', 'a'), ('Modified', 'b'), ('Created', 'c') AS x(t, p)")
    sink(batch, 0)
    sink(batch, 0)
    assert t.version() == 2 and sorted(map(tuple, t.read().collect())) == [("b", "new"), ("c", "new")]
