"""Where intermediate tables may go, and how wide shuffles are."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from filmloom.plans.session import partition_settings
from filmloom.plans.storage import shared_dir

INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def session_on(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: folder if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf, getCheckpointDir=lambda: None))


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[3,2,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session_on(master))
    assert shared_dir(session_on(master, "s3://bucket/scratch/")) == "s3://bucket/scratch"


def test_shuffles_widen_with_the_input():
    assert partition_settings(0)[INITIAL] == "200"
    assert int(partition_settings(100 * 2**40)[INITIAL]) == 100 * 2**40 // (128 * 2**20)
    assert partition_settings(100 * 2**40, 64)["spark.sql.shuffle.partitions"] == "64"
