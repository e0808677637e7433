import os

import pytest

from weftline import staging


def test_staged_tables_are_files_and_go_when_cleared(spark):
    df = staging.stage(spark.range(5), "t")
    path = df._staged_at.removeprefix("file://")
    assert df.count() == 5 and os.path.isdir(path)
    kept = staging.stage(spark.range(2), "t")
    staging.drop(df)
    assert not os.path.exists(path) and kept.count() == 2
    staging.clear(spark)
    assert not os.path.exists(kept._staged_at.removeprefix("file://"))


class Cluster:
    class conf:
        @staticmethod
        def get(*_):
            return None

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_dir(Cluster)
