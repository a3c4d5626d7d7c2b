"""The line's spanning tree, which every linkage query starts from, joins all points by shuffles."""

import re

from quartermark.workload import graphs as G


def test_neighbours_on_the_line_meet_by_shuffles(spark):
    tree = G.line_tree(spark, "/root/testdata/sf0.001")
    plan = tree._jdf.queryExecution().executedPlan().toString()
    joins = re.findall(r"(\w+Join) \[[^\]]*pos#", plan)
    assert joins and all(j == "SortMergeJoin" for j in joins)
    assert tree.count() == G.line_points(spark, "/root/testdata/sf0.001").count() - 1
