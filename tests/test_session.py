from types import SimpleNamespace

import pytest

from larkspur.session import checkpoint_dir, written


def fake(master, named=None):
    said = []
    sc = SimpleNamespace(master=master, getCheckpointDir=lambda: said[-1] if said else None, getConf=lambda: {"spark.checkpoint.dir": named}, setCheckpointDir=said.append)
    return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: d))


def test_a_cluster_must_name_its_shared_folder():
    assert checkpoint_dir(fake("spark://host:7077", "hdfs:///shared")) == "hdfs:///shared"
    assert "larkspur-checkpoint-" in checkpoint_dir(fake("local[4]")) and checkpoint_dir(fake("local", "/named")) == "/named"
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            checkpoint_dir(fake(master))


def test_written_tables_keep_rows_and_schema(spark):
    df = spark.createDataFrame([(1, None), (2, ["a"])], "id bigint, x array<string>")
    assert sorted(map(tuple, written(df).collect())) == [(1, None), (2, ["a"])]
    assert written(df.limit(0)).collect() == [] and written(df.limit(0)).columns == ["id", "x"]
