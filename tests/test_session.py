from types import SimpleNamespace

import pytest

from funnelscope.session import materialize, spread, work_dir


def session(folder, master="local[2]", app="app-1"):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder),
                           sparkContext=SimpleNamespace(master=master, applicationId=app))


def test_work_dir_reads_the_setting():
    assert work_dir(session("/shared/work/", "spark://host")) == "/shared/work"


def test_scratch_folder_only_on_local_sessions():
    assert work_dir(session(None)) == work_dir(session(None))
    with pytest.raises(ValueError):
        work_dir(session(None, "spark://host"))


def test_materialize_keeps_rows_and_schema(spark):
    df = spark.range(10).selectExpr("id", "array(id) as a")
    back = materialize(df, "numbers")
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(r["id"] for r in back.collect()) == list(range(10))


def test_spread_leaves_tables_of_many_files(spark, tmp_path):
    spark.range(100).repartition(1).write.parquet(str(tmp_path / "one"))
    spark.range(100).repartition(8).write.parquet(str(tmp_path / "many"))
    few = spread(spark.read.parquet(str(tmp_path / "one")))
    many = spread(spark.read.parquet(str(tmp_path / "many")), few_files=4)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange RoundRobinPartitioning" in plan(few) and "Exchange" not in plan(many)
    assert few.count() == many.count() == 100
