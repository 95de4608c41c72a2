import os
from types import SimpleNamespace

import pytest

from burstseries.session import cut_lineage, drop_scratch, scratch_dir


def fake(master, **conf):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__),
        sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k: conf.get(k))),
    )


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"])
def test_a_cluster_must_name_its_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(fake(master))


def test_a_named_folder_is_used_as_it_is():
    assert scratch_dir(fake("yarn", **{"spark.checkpoint.dir": "hdfs:///tmp/x/"})) == "hdfs:///tmp/x"


def test_scratch_can_be_dropped(spark):
    df = cut_lineage(spark.range(5), "dropme")
    path = df.inputFiles()[0].removeprefix("file:")
    path = "/" + path.lstrip("/")
    assert df.count() == 5 and os.path.exists(path)
    assert drop_scratch(spark) >= 1
    assert not os.path.exists(path)
