from __future__ import annotations

from types import SimpleNamespace

import pytest

from papyrion import session


class Conf(dict):
    def set(self, key, value):
        self[key] = value


def test_shared_folder_is_required_on_a_cluster():
    assert session.shared_dir(SimpleNamespace(conf=Conf({"spark.checkpoint.dir": "hdfs://x/y/", "spark.master": "yarn"}))) == "hdfs://x/y"
    with pytest.raises(RuntimeError):
        session.shared_dir(SimpleNamespace(conf=Conf({"spark.master": "spark://host:7077"})))
    assert session.shared_dir(SimpleNamespace(conf=Conf({"spark.master": "local[2]"}))).startswith("file://")


def test_release(spark):
    df = session.materialize(spark.range(5))
    path = session._written[-1][1]
    assert df.count() == 5 and session.names_in(spark, path)
    session.write_marker(spark, f"{path}/marker")
    assert "marker" in session.names_in(spark, path)
    session.release(spark)
    assert session.names_in(spark, path) == [] and all(p.endswith("/package") or s is not spark for s, p in session._written)
