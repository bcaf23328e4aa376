import random

import pytest

from tessella.operators import graph
from tessella.operators.components import connected_components


@pytest.fixture(scope="module", autouse=True)
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(pairs)], "src string, dst string, seq bigint")


def nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def plain_rank(names, pairs):
    names = sorted({*names, *(x for p in pairs for x in p)})
    pairs = [(a, b) for a, b in pairs if a != b]
    r = dict.fromkeys(names, 1 / len(names))
    for _ in range(300):
        out = {n: sum(a == n for a, _ in pairs) for n in names}
        lost = sum(r[n] for n in names if not out[n])
        r = {n: 0.15 / len(names) + 0.85 * (sum(r[a] / out[a] for a, b in pairs if b == n) + lost / len(names)) for n in names}
    return r


def test_page_rank(spark):
    pairs = [("a", "b"), ("b", "a"), ("a", "c"), ("a", "c"), ("c", "c"), ("c", "a"), ("d", "a"), ("b", "e")]
    got = {r.node: r.score for r in graph.page_rank(nodes(spark, ["z", "a"]), edges(spark, pairs)).collect()}
    want = plain_rank(["z", "a"], pairs)
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-8 for n in want) and abs(sum(got.values()) - 1) < 1e-9


def plain_discovery(pairs, seeds):
    hops, parent, queue = {s: 0 for s in seeds}, dict.fromkeys(seeds), list(seeds)
    for n in queue:
        for a, b in pairs:
            if a == n and b not in hops:
                hops[b], parent[b] = hops[n] + 1, n
                queue.append(b)
    return hops, parent


def test_discovery_and_paths_break_ties_by_order(spark):
    random.seed(3)
    pairs = [(f"n{random.randrange(25)}", f"n{random.randrange(25)}") for _ in range(60)]
    hops, parent = plain_discovery(pairs, ["n1", "n2"])
    seeds = spark.createDataFrame([("n1", 0), ("n2", 1)], "node string, place bigint")
    found = graph.discovery(edges(spark, pairs), seeds)
    got = {r.node: (r.hops, r.parent) for r in found.collect()}
    assert got == {n: (hops[n], parent[n]) for n in hops}
    far = max(hops, key=hops.get)
    path = graph.paths(found, nodes(spark, [far])).first().path
    assert len(path) == hops[far] + 1 and path[-1] == far and all(parent[b] == a for a, b in zip(path, path[1:]))


@pytest.mark.parametrize(("seed", "target", "cap", "state"), [("a", "c", 9, "found"), ("a", "c", 1, "limit_reached"), ("c", "a", 9, "unreachable_in_observed_graph"), ("q", "a", 9, "seed_unobserved"), (None, "a", 9, "unavailable")])
def test_path_state(spark, seed, target, cap, state):
    pairs = [("a", "b"), ("b", "c"), ("d", "a")]
    assert graph.path_state(edges(spark, pairs), nodes(spark, "abcd"), seed, target, cap).first().state == state


def test_chains(spark):
    pairs = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("s", "s"), ("l1", "l2"), ("l2", "l3"), ("l3", "l2")] + [(f"k{i}", f"k{i + 1}") for i in range(8)]
    got = {r.src: (r.path, r.state) for r in graph.chains(edges(spark, pairs).select("src", "dst"), 6).collect()}
    assert got["a"] == (["a", "b", "c"], "end") and got["x"] == (["x", "y", "x"], "loop") and got["s"] == (["s", "s"], "loop")
    assert got["l1"] == (["l1", "l2", "l3", "l2"], "loop") and got["k0"][1] == "capped" and got["k2"] == ([f"k{i}" for i in range(2, 9)], "end")


def test_loops_and_series(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("t", "a"), ("p1", "p2"), ("p2", "p3"), ("s", "s")]
    df = edges(spark, pairs).select("src", "dst")
    assert {(r.node, r.loop) for r in graph.loops(df).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("s", "s")}
    got = {r["head"]: (r.path, r.state) for r in graph.series(df).collect()}
    assert got["p1"] == (["p1", "p2", "p3"], "end") and got["t"] == (["t", "a", "b", "c"], "loop") and got.keys() == {"p1", "t"}


def test_components(spark):
    random.seed(1)
    pairs = [(random.randrange(300), random.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(1000, 1100)] + [(7, 7)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {x: root(x) for a, b in pairs if a != b for x in (a, b)}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == want


def test_components_of_large_and_negative_ids(spark):
    ids = [(2**62 + k * 2**36, 2**62 + (k + 1) * 2**36) for k in range(400)] + [(-(2**62) - k, -(2**62) - k - 1) for k in range(50)] + [(2**63 - 1, -(2**63))]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(ids, "a bigint, b bigint")).collect()}
    assert len(got) == 401 + 51 + 2 and got[2**62 + 400 * 2**36] == 2**62 and got[-(2**62)] == -(2**62) - 50 and got[2**63 - 1] == -(2**63)


def test_link_measures(spark):
    rows = [("a", "x", "t", "nav", 1), ("a", "x", "t", "nav", 2), ("b", "x", "t", "footer", 3), ("b", "y", "u", None, 4), ("c", "y", "u", "nav", 5), ("a", "z", "t", "content", 6)]
    links = spark.createDataFrame(rows, "source string, destination string, anchor string, position string, seq bigint")
    assert {r.destination: (r.inlinks, r.unique_inlinks) for r in graph.link_totals(links).collect()} == {"x": (3, 2), "y": (2, 2), "z": (1, 1)}
    got = {r.destination: (r.by_position, r.unclassified, r.boilerplate_only) for r in graph.composition(links).collect()}
    assert got == {"x": ({"footer": 1, "nav": 1}, 0, True), "y": ({"nav": 1}, 1, False), "z": ({"content": 1}, 0, False)}
    assert [(r.source, r.extra) for r in graph.duplicate_links(links).collect()] == [("a", 1)]
    rendered = spark.createDataFrame([("a", "x", 9), ("q", "x", 7), ("q", "x", 8)], "source string, destination string, seq bigint")
    united = graph.united_links(links.select("source", "destination", "seq"), rendered).where("representation = 'rendered'").collect()
    assert [(r.source, r.seq) for r in united] == [("q", 8)]


def test_order_chains_of_over_twenty_steps_match_their_sql(spark, tmp_path):
    import duckdb

    from tessella.catalog import graphs

    keys = {k >> n for k in ((5 << 19) + 1, 5 << 18, 5 << 17, 7 << 18, (7 << 19) + 9, 3 << 22, 1 << 30) for n in range(31)} - {0}
    path = f"{tmp_path}/orders.parquet"
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").coalesce(1).write.parquet(path)
    got = sorted(map(tuple, graphs.order_chains(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = sorted(con.execute(graphs.ORDER_CHAINS).fetchall())
    assert got == want and {s for _, s, _ in got} == {"loop", "end"} and max(n for *_, n in got) == 20
