import os

import pytest
from pyspark.sql import functions as F

from tabpact import staging


class FakeSession:
    def __init__(self, **conf):
        self.conf = {k.replace("_", "."): v for k, v in conf.items()}


def test_the_named_folder_is_used():
    assert staging.shared_folder(FakeSession(spark_checkpoint_dir="hdfs://x/shared/")) == "hdfs://x/shared"


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_folder(FakeSession(spark_master="spark://host:7077"))


def test_a_local_session_may_go_without(spark, monkeypatch):
    monkeypatch.setattr(staging, "CHECKPOINT_DIR", "spark.tabpact.not.set")
    first = staging.shared_folder(spark)
    assert os.path.isdir(first) and staging.shared_folder(spark) == first
    staged = staging.stage(spark.range(5), "numbers")
    assert staged.count() == 5
    staging.remove_staged(spark)
    assert not os.path.exists(staging.application_folder(spark))


def test_staging_counts_in_the_same_job(spark):
    df, rows = staging.stage_at(spark.range(10), staging.new_folder(spark, "n"), counted=F.col("id") > 100)
    assert df.count() == 10 and rows == 0
