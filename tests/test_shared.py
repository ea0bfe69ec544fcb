import os

import pytest

from lateweave import shared


class Session:
    """What shared_dir() asks a session for."""

    def __init__(self, master, folder=None):
        self.sparkContext, self.master, self.folder = self, master, folder

    def getConf(self):
        return {"spark.checkpoint.dir": self.folder} if self.folder else {}


def test_the_configured_folder_is_used():
    assert shared.shared_dir(Session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"


def test_no_local_folder_on_a_cluster(monkeypatch):
    monkeypatch.delenv(shared._OWN, raising=False)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.shared_dir(Session(master))
    monkeypatch.setenv(shared._OWN, "")
    assert os.path.isdir(shared.shared_dir(Session("local[4]")))


def test_scratch_is_removed(spark):
    path = shared.scratch(spark, "x")
    spark.range(3).write.parquet(path)
    assert shared.scratch(spark, "x") != path
    shared.remove(spark, path)
    assert not os.path.exists(path.removeprefix("file:"))
