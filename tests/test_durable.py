"""Stored tables: where they lie, when they go, and when kept stages are made anew."""

import os
import types

import pytest

from newsweir.operators import durable
from newsweir.plans import views


def session(master, folder=None):
    return types.SimpleNamespace(
        conf=types.SimpleNamespace(get=lambda name, default: folder), sparkContext=types.SimpleNamespace(master=master, applicationId="none", getCheckpointDir=lambda: None)
    )


def test_a_cluster_must_name_its_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[3,4,6144]"):
        with pytest.raises(RuntimeError):
            durable.shared_path(session(master), "x")
        assert durable.shared_path(session(master, "s3://some/"), "x").startswith("s3://some/x-")
    assert os.path.isdir(os.path.dirname(durable.shared_path(session("local[4]"), "x")))


def test_other_tables_at_one_path(spark, tmp_path):
    columns = "dataset string, impression_id string, user_id string, timestamp timestamp_ntz, candidates array<string>, clicked array<string>"
    for ids in ("ab", "xyz"):
        rows = [("d", i, "u", None, ["n"], ["n"]) for i in ids]
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/impressions.parquet")
        for _ in range(2):
            kept = views.impressions(spark, str(tmp_path))
            assert {r["impression_id"] for r in kept.collect()} == set(ids)
    path = kept.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    views.forget(spark)
    assert not os.path.exists(path)
