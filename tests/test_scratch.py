"""Shared scratch folder: named by the session, by the context, or refused on a cluster."""

import pytest

from talkgrain.plans import scratch


class Held:
    def __init__(self, path):
        self.path = path

    def isDefined(self):
        return self.path is not None

    def get(self):
        return self.path


class Session:
    """Only what ``shared_dir`` asks of a session."""

    def __init__(self, named=None, held=None, master="local[8]"):
        self.conf = {"spark.checkpoint.dir": named} if named else {}
        self.sparkContext = self
        self._jsc = self
        self.master = master
        self.held = held

    def sc(self):
        return self

    def getCheckpointDir(self):
        return Held(self.held)


def test_named_by_the_session():
    assert scratch.shared_dir(Session(named="hdfs://a/b/")) == "hdfs://a/b"


def test_named_by_the_context():
    assert scratch.shared_dir(Session(held="s3://c/d", master="yarn")) == "s3://c/d"


@pytest.mark.parametrize("master", ["yarn", "spark://h:7077", "local-cluster[2,1,1024]"])
def test_refused_on_a_cluster(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session(master=master))


def test_temporary_on_one_machine():
    assert scratch.shared_dir(Session()) == scratch.shared_dir(Session(master="local"))


def test_stored_rows_come_back(spark):
    assert scratch.stored(spark.range(5), "t").count() == 5
