import pytest

from stipple.session import shared_dir


class Fake:
    """A session's settings without a JVM."""

    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app-{master}"})()


def test_configured_folder_wins():
    assert shared_dir(Fake("spark://host:7077", "hdfs://x/y")) == "hdfs://x/y"


def test_local_session_without_a_folder_gets_one_and_keeps_it():
    spark = Fake("local[4]")
    assert shared_dir(spark) == shared_dir(spark)


@pytest.mark.parametrize("master", ["spark://host:7077", "local-cluster[2,1,1024]", "yarn"])
def test_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Fake(master))
