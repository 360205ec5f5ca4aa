"""What holds beyond the bounds up to which a side goes to every task: the same rows by another way."""

from pyspark.sql import functions as F

from corvane.operators import graph as G
from corvane.operators import retrieval as V


def test_names_of_many_questions(spark, monkeypatch):
    nodes = spark.createDataFrame([(str(k), f"Name{k % 7}", f"a.b.Name{k % 5}" if k % 2 else None) for k in range(40)], "id string, name string, full_name string")
    wanted = spark.createDataFrame([("name1",), ("a.b.name3",), ("name1",), ("none",), (None,)], "key string")
    few = sorted(map(tuple, G.with_key(nodes, wanted).collect()))
    monkeypatch.setattr(G, "FEW_NAMES", 1)
    assert few and sorted(map(tuple, G.with_key(nodes, wanted).collect())) == few
    plan = G.with_key(nodes, wanted)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan


def test_questions_in_blocks(spark, monkeypatch):
    rows = [(f"c{k}", 0, [float((k * j) % 7 - 3) for j in range(1, 5)]) for k in range(60)]
    chunks = spark.createDataFrame(rows, "content_id string, chunk_index int, embedding array<float>")
    queries = spark.createDataFrame([(k, [float((k + j) % 5 - 2) for j in range(4)]) for k in range(9)], "query_id long, query array<float>")
    ask = lambda: [(r.content_id, round(r.score, 6)) for r in V.multi_query_top_k(chunks, queries, 4, 12, ["content_id"]).orderBy(F.desc("score"), "content_id").collect()]
    whole = ask()
    monkeypatch.setattr(V, "MAX_BROADCAST", 4)
    assert len(whole) == 12 and ask() == whole
    plan = V.multi_query_top_k(chunks, queries, 4, 12, ["content_id"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
