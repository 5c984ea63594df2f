from pathlib import Path
from types import SimpleNamespace

import pytest

from codekiln import session


def _asking(master, shared=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: shared), sparkContext=SimpleNamespace(master=master))


def test_a_cluster_without_a_shared_folder_is_an_error():
    for master in ("yarn", "spark://host:7077", "local-cluster[3,4,6144]", "k8s://host"):
        with pytest.raises(ValueError):
            session.scratch_dir(_asking(master))


def test_the_shared_folder_is_used_and_emptied(spark, tmp_path):
    folder = session.scratch_dir(_asking("yarn", str(tmp_path)))
    assert Path(folder).parent == tmp_path and session.scratch_dir(_asking("yarn", str(tmp_path))) == folder
    spark.range(5).write.parquet(f"{folder}/five")
    session.clean_scratch(spark, str(tmp_path))
    assert list(tmp_path.iterdir()) == []


def test_tables_are_written_once_and_read_again(spark):
    rows = session.materialize(spark.range(5), "five")
    assert rows.count() == 5 and Path(session.scratch_dir(spark)).is_dir()
