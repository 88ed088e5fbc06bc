import pytest

from gristdex.session import shared_folder, written


class Cluster:
    """A session of a cluster, so far as the shared folder is concerned."""

    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder
        self.conf = self.sparkContext = self

    def get(self, name, default=None):
        return self.folder

    def getConf(self):
        return self

    def getCheckpointDir(self):
        return None


def test_a_cluster_must_name_its_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_folder(Cluster(master))
        assert shared_folder(Cluster(master, "hdfs://x/y/")) == "hdfs://x/y"
    assert shared_folder(Cluster("local[4]")).endswith("gristdex-shared")


def test_written_tables(spark):
    df = spark.range(10).selectExpr("id", "CAST(NULL AS STRING) AS text")
    again = written(df)
    assert again.schema.names == ["id", "text"] and again.count() == 10 and shared_folder(spark) in again.inputFiles()[0].replace("file://", "")
    assert written(df.limit(0)).count() == 0
