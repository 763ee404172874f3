"""Where intermediate tables may be written."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from barloom.session import kept, shared_dir, shared_root


def session(setting, context_dir, master):
    conf = {"spark.checkpoint.dir": setting} if setting else {}
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda k, d: conf.get(k, d), set=conf.__setitem__),
        sparkContext=SimpleNamespace(getCheckpointDir=lambda: context_dir, master=master),
    )


def test_the_session_setting_comes_first():
    assert shared_root(session("hdfs://a/b/", "hdfs://c", "yarn")) == "hdfs://a/b"


def test_then_the_folder_of_the_context():
    assert shared_root(session(None, "hdfs://c/d", "yarn")) == "hdfs://c/d"


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://x", "local-cluster[2,1,1024]"])
def test_a_cluster_without_a_shared_folder_is_refused(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(session(None, None, master))


def test_one_machine_gets_a_temporary_folder():
    alone = session(None, None, "local[4]")
    assert shared_root(alone) == shared_root(alone)


def test_copies_of_an_application_lie_in_one_folder(spark):
    a, b = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]
    assert kept(spark.range(5)).count() == 5
