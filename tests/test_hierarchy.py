import random

from hypothesis import HealthCheck, given, settings, strategies as st

from papyra.operators.hierarchy import cycle_nodes, descendants, hierarchy, parent_table, prefix_sums
from papyra.session import Cut


def brute(links):
    """id -> (root, path, cycle_id, on_cycle) by walking up."""
    parent = {}
    for c, p in links:
        if c is None:
            continue
        parent.setdefault(c, None)
        if p is not None:
            parent.setdefault(p, None)
            parent[c] = p if parent[c] is None else min(parent[c], p)
    out = {}
    for n in parent:
        path, at = [n], n
        while parent[at] is not None and parent[at] not in path:
            at = parent[at]
            path.append(at)
        if parent[at] is None:
            out[n] = (at, path[::-1], None, False)
            continue
        ring = path[path.index(parent[at]) :]
        if n in ring:
            out[n] = (n, [n], min(ring), True)
        else:
            up = path[: path.index(parent[at]) + 1]
            out[n] = (up[-1], up[::-1], min(ring), False)
    return out


def run(spark, links):
    df = spark.createDataFrame(links, "child_id string, parent_id string")
    tree = hierarchy(spark, df)
    return tree, tree.collect()


def check(spark, links):
    want = brute(links)
    tree, rows = run(spark, links)
    assert {r.id: (r.root, list(r.path), r.cycle_id, r.on_cycle) for r in rows} == want
    assert all(r.depth == len(r.path) - 1 for r in rows)
    under = {n: {m for m, w in want.items() if n in w[1] and m != n} for n in want}
    by = {r.id: r for r in rows}
    for r in rows:
        assert r.n_descendants == len(under[r.id])
        assert {x.id for x in rows if x.root == r.root and r.enter < x.enter < r.leave} == under[r.id]
    assert all(by[r.chain].chain_pos == 0 for r in rows)
    pairs = {(r.ancestor_id, r.descendant_id) for r in descendants(tree).collect()}
    assert pairs == {(n, m) for n, ms in under.items() for m in ms}


def test_chain_star_cycles_and_what_hangs_below(spark):
    links = [("b", "a"), ("c", "b"), ("d", "c"), ("e", "b"), ("a", None), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("v", "w"), ("s", "s"), ("lone", None), ("b", "a"), (None, "q"), ("two", "n"), ("two", "m")]
    check(spark, links)


def test_long_chain_and_wide_parent(spark):
    links = [(f"n{i:04d}", f"n{i - 1:04d}") for i in range(1, 140)] + [(f"c{i:03d}", "n0005") for i in range(150)]
    check(spark, links)


def test_empty_table(spark):
    assert run(spark, [])[1] == []


def test_only_cycles(spark):
    rows = [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)]
    got = cycle_nodes(parent_table(spark.createDataFrame(rows, "c string, p string"), "c", "p"), Cut(spark, "t")).collect()
    assert {(r.id, r.cycle_id) for r in got} == {(f"r{i}", "r0") for i in range(7)}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdefghij"), st.one_of(st.none(), st.sampled_from("abcdefghij"))), min_size=1, max_size=14))
def test_random_forests(spark, links):
    check(spark, links)


def test_prefix_sums_over_a_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 5}", i, rng.randrange(9)) for i in range(400)]
    got = prefix_sums(spark.createDataFrame(rows, "g string, o int, v long"), "g", "o", "v", "s", Cut(spark, "t")).collect()
    assert {(r.g, r.o): r.s for r in got} == {(g, o): sum(v for h, p, v in rows if h == g and p < o) for g, o, _ in rows}
