"""Shuffles of the queries on context in levels, and names of odd skeletons."""

from pyspark.sql import functions as F

from siftwork.operators import levels
from siftwork.plans import QUERIES


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_files_are_shuffled_once(spark, sf):
    """The first level is one shuffle; what is around relevant files, and the texts of all levels, are joined where the files are."""
    assert shuffles(QUERIES["sel13_level1"](spark, sf)) == 1
    assert shuffles(QUERIES["sel14_level2"](spark, sf)) == 0
    assert shuffles(QUERIES["sel26_hierarchical"](spark, sf)) == 0


def test_settings_come_back(spark, sf):
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    spark.conf.set(name, "true")
    QUERIES["sel14_level2"](spark, sf)
    assert spark.conf.get(name) == "true"
    spark.conf.unset(name)


def test_names_are_made_by_one_pattern(spark):
    """No function is called for each line; very long lines take no stack, and white space behind a keyword is no name."""
    rows = {"def def \nasync def \nclass ": "def", "function " + "w " * 50_000 + "\n" + "x " * 50_000 + "function y(": "w, y", "async def  run (a)\n\tclass  A B : x": "run, A B", "def _p\nfn \nstruct a{b{<:": "a{b"}
    df = spark.createDataFrame([(k,) for k in rows], "s string").select("s", levels.one_liner(F.col("s")).alias("line"))
    assert {r.s: r.line for r in df.collect()} == rows
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan and plan.count("regexp_replace(") == 1
