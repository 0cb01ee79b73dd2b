"""Intermediate results go to a shared folder; a cluster without one is refused."""

import pytest

from stintwise.session import shared_folder


class Context:
    master = "spark://somewhere:7077"


class Session:
    sparkContext = Context()

    def __init__(self, folder=None):
        self.folder = folder
        self.conf = self

    def get(self, key, default=None):
        return self.folder or default


def test_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())
    assert shared_folder(Session("hdfs:///shared")) == "hdfs:///shared"


def test_one_machine_makes_its_own(spark):
    assert shared_folder(spark) == shared_folder(spark)
