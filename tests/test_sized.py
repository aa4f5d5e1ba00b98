"""Broadcasts behind a size check, written tables, and a key that a third of all rows share."""

import os

import pytest
from pyspark.sql import functions as F

from crawlquarry.plans import sized


def test_small_marks_what_fits_and_leaves_the_rest(spark):
    facts = spark.range(1000).select((F.col("id") % 10).alias("k"))
    names = spark.range(10).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 100).alias("name"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [facts.join(sized.small(names, limit), "k") for limit in (sized.BROADCAST_BYTES, 100)]
        text = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
        assert "BroadcastHashJoin" in text[0] and "SortMergeJoin" in text[1]
        assert sorted(map(tuple, plans[0].collect())) == sorted(map(tuple, plans[1].collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_size_counts_nested_values(spark):
    df = spark.createDataFrame([(1, ["a" * 1000], None), (None, None, "é" * 10)], "n int, a array<string>, s string")
    assert 1000 < sized.size_bytes(df) < 1500 and sized.size_bytes(df.limit(0)) == 0


def test_written_tables_are_released(spark):
    df = sized.written(spark.range(5).toDF("n"))
    path = df._crawlquarry_path.removeprefix("file:")
    assert df.count() == 5 and os.path.isdir(path)
    sized.released(spark.range(1))
    sized.released(df)
    assert not os.path.exists(path)


def test_no_folder_of_one_machine_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})()

    with pytest.raises(RuntimeError):
        sized.shared_dir(Session())


def test_a_hot_key_gives_the_same_issues(spark, tmp_path):
    """A third of all pages of one audit share a title."""
    from crawlquarry.operators import engine

    rows = spark.range(30_000).selectExpr("concat('a', if(id % 3 = 0, 0, id % 7)) as audit_id", "id as ord", "concat('https://x.test/', id) as url", "if(id % 3 = 0, ' Same ', concat('t', id)) as title", "'INDEXABLE' as indexability", "200 as status_code")
    rows.write.parquet(str(tmp_path / "p"))
    pages = engine.records(spark.read.parquet(str(tmp_path / "p")))
    got = {(r.audit_id, r.rule_key): r.affected for r in engine.summarized(pages).collect()}
    assert got["a0", "META_TITLE_DUPLICATE"] == 10_000 and got == {(r.audit_id, r.rule_key): r.affected for r in engine.issues(engine.matches(pages), pages).collect()}
    assert engine.links(engine.matches(pages)).where("audit_id = 'a0' and rule_key = 'META_TITLE_DUPLICATE'").count() == 2000
