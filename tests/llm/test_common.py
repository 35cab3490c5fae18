from types import SimpleNamespace

import pytest

from slotwise.llm import common


def session(master, made):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: default))


@pytest.mark.parametrize("master", ["spark://one:7077", "yarn", "k8s://one", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session(master, []))
    assert common.shared_dir(session(master, ["hdfs://shared"])) == "hdfs://shared"


def test_one_machine_makes_its_own():
    made = []
    assert common.shared_dir(session("local[8]", made)) == made[0]
