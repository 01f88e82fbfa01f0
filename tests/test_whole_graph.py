"""Queries over all references, by brute force on a small table of orders."""

import pytest

from symsearch import queries

# Parts by order, in the order of their lines: cycles, a long chain, a loop, and parts that reach no goal.
ORDERS = [[17, 21, 17], [30, 31, 32, 33, 34, 35, 36, 37, 38, 5], [7, 7], [40, 7], [21, 30], [5, 50], [60], [61, 62]]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("small"))
    parts = [(k, "red apple" if k % 2 else "green pear", "Brand#1", "PROMO", 50 if k % 20 == 1 else k % 49 + 1) for k in range(1, 70)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{out}/part.parquet")
    lines = [(o, k, 1, n) for o, keys in enumerate(ORDERS) for n, k in enumerate(keys)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{out}/lineitem.parquet")
    states = [(o, ("1-URGENT", "5-LOW")[o % 2], ("P", "F", "O")[o % 3]) for o in range(len(ORDERS))]
    spark.createDataFrame(states, "o_orderkey long, o_orderpriority string, o_orderstatus string").write.parquet(f"{out}/orders.parquet")
    return out


def edges():
    return {e for keys in ORDERS for e in zip(keys, keys[1:], strict=False)}


def test_references_of_all_orders(spark, small):
    ids = lambda name: {r.id for r in queries.QUERIES[name](spark, small).collect()}
    assert {tuple(r) for r in queries.edges_of(spark, small).collect()} == edges()
    assert ids("relocations_present") == {a for a, _ in edges()}
    assert ids("relocations_contains") == {a for a, b in edges() if b % 2}
    assert ids("neighbours") == {a for a, b in edges() if b == 7}


def plain_hops(goal):
    """Breadth first, backward from a goal."""
    hops, frontier = {goal: 0}, {goal}
    while frontier:
        frontier = {a for a, b in edges() if b in frontier} - set(hops)
        hops |= dict.fromkeys(frontier, 1 + max(hops.values()))
    return hops


def test_search_of_any_depth(spark, small):
    want = {(g, node, n) for g in (5, 17) for node, n in plain_hops(g).items()}
    assert max(n for _, _, n in want) > 6
    assert {tuple(r) for r in queries.bfs_hops(spark, small).collect()} == want


def test_routes_of_any_length(spark, small):
    want = {(g, min(n for node, n in plain_hops(g).items() if n and node % 20 == 1)) for g in (5, 17)}
    assert {tuple(r) for r in queries.routes(spark, small).collect()} == want == {(5, 10), (17, 1)}
