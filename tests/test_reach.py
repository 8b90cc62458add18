"""Reach over edges that are repeated and many, from few seeds."""

from siftwork.operators import graph
from siftwork.plans import QUERIES
from siftwork.sources import shared


def test_reach_of_repeated_edges(spark):
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 1), (5, 3), (3, 3), (None, 1), (7, 8)], "src long, dst long")
    seeds = spark.createDataFrame([(1,), (1,), (9,)], "id long")
    assert {tuple(r) for r in graph.reach(edges, seeds, 2).collect()} == {(1, 0), (9, 0), (2, 1), (3, 2)}
    both = {tuple(r) for r in graph.reach(edges, seeds, 2, both_ways=True).collect()}
    assert both == {(1, 0), (9, 0), (2, 1), (3, 1), (None, 1), (5, 2)}


def test_edges_are_not_shuffled_whole(spark, sf, monkeypatch):
    """The plan of each layer has an exchange of what was found, none of all edges."""
    plans, real = [], shared.written

    def seen(df, label):
        if label == "reach-layer":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, label)

    monkeypatch.setattr(graph, "written", seen, raising=False)
    for name in ("ret18_identify_cluster", "ret19_transitive_deps"):
        plans.clear()
        QUERIES[name](spark, sf).collect()
        assert len(plans) == 3 and all(p.count("Aggregate") <= 1 for p in plans)
