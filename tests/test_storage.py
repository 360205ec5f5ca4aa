"""Stored tables: where they stand, and when they go."""

import os
from types import SimpleNamespace

import pytest

from corvane import storage as S


def files(top):
    return os.path.exists(top.removeprefix("file://"))


def test_a_cluster_without_a_shared_folder_is_refused():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        S.shared_folder(session)
    session.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        S.shared_folder(session)


def test_tables_go_with_their_scope(spark):
    outer = S.Stored(spark, "outer")
    kept = outer.cut(spark.range(3))
    with S.scope():
        a = S.Stored(spark, "a")
        assert a.cut(spark.range(5)).count() == 5
        with S.scope():
            b = S.Stored(spark, "b")
            b.cut(spark.range(2))
            first = b.last
            b.cut(spark.range(2))
            b.drop(first)
            assert not files(first) and files(b.last)
        assert not files(b.top) and files(a.top)
    assert not files(a.top) and kept.count() == 3
    outer.drop()
    assert not files(outer.top)
