"""The registered lookups ask for every call and every function."""

import os

import pytest

from checks.queries import QUERIES, nodes_and_edges
from srcatlas.operators import graph

FOLDER = os.environ.get("LOOKUP_SF_DIR", "/root/testdata/sf0.01")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not there")


@pytest.mark.parametrize("name, kind", [("calls_from", "call"), ("callers_of", "function")])
def test_late_rows_are_asked_for(spark, name, kind):
    nodes, _ = nodes_and_edges(spark, FOLDER)
    late = graph.nodes_of_kind(nodes, kind).filter("start_row >= 20").selectExpr("repo", "node_id as of")
    assert QUERIES[name](spark, FOLDER).join(late, ["repo", "of"], "left_semi").count() > 0
