"""Scratch tables, their scopes, and joins by checked size."""

import os

import pytest
from pyspark.sql import functions as F

from meshwork import runtime as R


def there(df):
    return os.path.isdir(df._meshwork_path) if df._meshwork_path else False


def test_scope_deletes_all_but_what_is_kept(spark):
    with R.scratch_scope(spark, []) as keep:
        a = R.materialise(spark.range(5), "a")
        with R.scratch_scope(spark, []) as inner:
            b, c = R.materialise(a, "b"), R.bucketed(a, "id")
            inner.append(b)
        assert there(a) and there(b) and not there(c)
        keep.append(a)
    assert there(a) and not there(b) and a.count() == 5
    R.discard(a, spark.range(2), None)
    assert a._meshwork_path is None


def test_small_is_counted_in_rows_and_bytes(spark):
    wide = spark.range(10).select("id", F.array_repeat(F.lit("x" * 1000), 100).alias("l"), F.struct(F.lit("y")).alias("s"), F.lit(None).cast("string").alias("n"))
    assert R.is_small(wide) and not R.is_small(wide, size=900_000) and not R.is_small(wide, rows=9)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    big = spark.range(100)
    assert "broadcast" in plan(R.small_join(big, wide, "id")) and "broadcast" not in plan(R.small_join(big, wide, "id", limit=3))
    assert R.small_join(big, spark.range(0), "id", "left").count() == 100


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master, applicationId = "spark://head:7077", "app"

    class Session:
        conf, sparkContext = {}, Context

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        R.scratch_root(Session)
    Session.conf = {"spark.checkpoint.dir": "hdfs://shared/x/"}
    assert R.scratch_root(Session) == "hdfs://shared/x"


def test_sized_stages_grow_in_number(spark):
    keys = ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = [spark.conf.get(k) for k in keys]
    with pytest.raises(KeyError), R.sized(spark, 40 * R.TASK_ROWS + 1):
        assert [spark.conf.get(k) for k in keys] == ["41", str(R.TASK_BYTES), str(R.TASK_BYTES)]
        raise KeyError
    assert [spark.conf.get(k) for k in keys] == before
    with R.sized(spark, 1):
        assert spark.conf.get(keys[0]) == before[0]


def test_a_graph_is_loaded_in_sized_stages(spark, sf_dir, monkeypatch):
    from meshwork import catalog

    rows, real = [], R.sized
    monkeypatch.setattr(catalog, "_graphs", {})
    monkeypatch.setattr(catalog, "sized", lambda s, n: rows.append(n) or real(s, n))
    catalog.graph(spark, sf_dir, "order_part")
    assert rows == [2 * spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()]
