import os

import pytest

from tarnish import session


def test_staged_tables_go_with_the_session(spark, monkeypatch):
    monkeypatch.setattr(session, "_staged", {})
    staged = session.stage(spark.range(10))
    path = staged.inputFiles()[0].removeprefix("file://").removeprefix("file:")
    assert staged.count() == 10 and os.path.exists(path) and path.startswith(session.staging_dir(spark).removeprefix("file:"))
    assert session.clear_staged(spark) == 1 and not os.path.exists(os.path.dirname(path))
    assert session.clear_staged(spark) == 0


def test_a_freed_table_is_gone_and_others_stay(spark, monkeypatch):
    monkeypatch.setattr(session, "_staged", {})
    first, second = session.stage(spark.range(10)), session.stage(spark.range(5))
    path = first.inputFiles()[0].removeprefix("file://").removeprefix("file:")
    session.free(first, spark.range(3))
    session.free(first)
    assert not os.path.exists(os.path.dirname(path)) and second.count() == 5
    assert session.clear_staged(spark) == 1


def test_local_folders_are_refused_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = {"spark.sql.warehouse.dir": "file:/tmp/x"}

    with pytest.raises(RuntimeError, match="share"):
        session.staging_dir(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs:///shared"}
    assert session.staging_dir(Session()) == "hdfs:///shared"
