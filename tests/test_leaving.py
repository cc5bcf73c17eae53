from quillgraph.operators import traverse as T


def test_few_nodes_are_a_filter_below_what_is_aggregated(spark):
    pairs = spark.range(100).selectExpr("id % 10 as a", "id % 7 as b").distinct()
    edges = pairs.selectExpr("concat('s', a) as node", "concat('p', b) as neighbour")
    nodes = spark.createDataFrame([("s1",), ("s1",), ("s2",)], "node string")
    few = T.leaving(edges, nodes)
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Filter")
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, edges.where("node in ('s1', 's2')").collect()))
    assert T.leaving(edges, nodes, most=1).count() == edges.count()
    assert T.leaving(edges, nodes.limit(0)).count() == 0
