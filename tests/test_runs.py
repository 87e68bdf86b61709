"""Streams with a ledger, and pipelines with ports."""

import pytest
from pyspark.sql import functions as F

from easel.plans import compose as X
from easel.streaming import ledger as L


def test_the_ledger_is_read_once_a_checkpoint(spark, tmp_path, monkeypatch):
    """Batches go by state: the ledger of what is done is read when a run starts, however many batches it has."""
    at = lambda x: f"file://{tmp_path}/{x}"
    schema = spark.createDataFrame([], "id long, good boolean").schema
    reads = []
    real = L.read_ledger
    monkeypatch.setattr(L, "read_ledger", lambda s, p: reads.append(p) or real(s, p))
    worked = []

    def work(df):
        worked.append(sorted(r["id"] for r in df.collect()))
        return df.withColumn("ok", F.col("good"))

    run = lambda c: L.ledger_stream(spark, at("in"), schema, at("ledger"), at(c), work, at("out"), batch_files=1)
    for k in range(6):
        spark.createDataFrame([(k, True), (k, True), (max(0, k - 1), True), (100 + k, False)], schema).coalesce(1).write.mode("append").parquet(at("in"))
    run("c1")
    assert len(reads) == 1 and len(worked) == 6 and sorted(sum(worked, [])) == [0, 1, 2, 3, 4, 5, *range(100, 106)]
    spark.createDataFrame([(5, True), (6, True)], schema).coalesce(1).write.mode("append").parquet(at("in"))
    worked.clear()
    run("c1")
    assert sum(worked, []) == [6]
    worked.clear()
    run("c2")  # starts over: only what failed is new
    assert sorted(sum(worked, [])) == list(range(100, 106)) and len(reads) == 3
    rows = spark.read.parquet(at("out")).where("ok")
    assert sorted(r["id"] for r in rows.collect()) == list(range(7)) == sorted(int(r["id"]) for r in real(spark, at("ledger")).collect())


def test_ports_are_checked_before_any_job(spark):
    def never(*_):
        raise AssertionError("ran")

    with pytest.raises(TypeError, match="a -> b: x bigint, not string"):
        X.Pipeline([X.Step("a", never, gives="x string"), X.Step("b", never, ["a"], ["x long"])], ["b"])
    with pytest.raises(TypeError, match="in -> a: y int is missing"):
        X.Pipeline([X.Step("a", never, ["in"], ["y int"])], ["a"], {"in": "x long"})
    with pytest.raises(ValueError, match="no step and no source"):
        X.Pipeline([X.Step("a", never, ["lost"], ["y int"])], ["a"], {"in": "x long"})
    with pytest.raises(ValueError, match="1 inputs and 2 needs"):
        X.Pipeline([X.Step("a", never, ["in"], ["y int", ""])], ["a"])
    with pytest.raises(ValueError, match="steps and sources"):
        X.Pipeline([X.Step("a", never)], ["a"], {"a": ""})
    # edges that no output needs aren't wrong
    assert X.Pipeline([X.Step("a", never, gives="x string"), X.Step("b", never, ["a"], ["x long"])], ["a"]).order == ["a"]
    df = spark.createDataFrame([(1,)], "x int")
    p = X.Pipeline([X.Step("a", never, ["in"], ["x long"])], ["a"], {"in": "x long"})
    with pytest.raises(TypeError, match="source in: x bigint, not int"):
        p.run({"in": df})
    with pytest.raises(TypeError, match="a gives x string, not int"):
        X.Pipeline([X.Step("a", lambda d: d, ["in"], gives="x string")], ["a"]).run({"in": df})
    with pytest.raises(TypeError, match="a -> b: z int is missing"):
        X.Pipeline([("a", lambda d: d, ["in"]), X.Step("b", never, ["a"], ["z int"])], ["b"]).run({"in": df})


def test_a_shared_step_runs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(50)
    steps = [("slow", lambda d: d.mapInArrow(count, "id long"), ["in"]), ("even", lambda d: d.where("id % 2 = 0"), ["slow"]), ("odd", lambda d: d.where("id % 2 = 1"), ["slow"]), ("both", lambda a, b: a.unionByName(b), ["even", "odd"])]
    out = X.Pipeline(steps, ["both", "slow"]).run({"in": df})
    assert out["both"].count() == 50 == out["slow"].count() and out["both"].agg(F.sum("id")).first()[0] == 1225
    assert seen.value == 50
