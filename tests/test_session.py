"""Where lineage is cut."""

import os
from types import SimpleNamespace

import pytest

from millrace.session import checkpoint_folder, cut


def fake(master, folder=None):
    held = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: held[-1] if held else None, setCheckpointDir=held.append, getConf=lambda: {"spark.checkpoint.dir": folder})
    return SimpleNamespace(sparkContext=context)


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://a:7077", "yarn", "k8s://b", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            checkpoint_folder(fake(master))
        assert checkpoint_folder(fake(master, "/shared/x")) == "/shared/x"


def test_a_local_session_gets_a_folder_of_its_own():
    one, two = (checkpoint_folder(fake("local[2]")) for _ in range(2))
    assert one != two and os.path.isdir(one) and checkpoint_folder(fake("local[*]", "/given")) == "/given"


def test_cut_keeps_rows(spark):
    assert cut(spark.range(9)).count() == 9
