"""Graph operators against exact small graphs, brute force and invariants."""

import itertools
import random
from collections import deque

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netmetrics.graph import Graph
from netmetrics.operators import keyplayer as kp
from netmetrics.operators.betweenness import betweenness
from netmetrics.operators.bridging import bridging, edge_losses
from netmetrics.functions.ordered import cuts, exclusive_sums, prefix_ranked
from netmetrics.operators.local import constraint, ens, shared_neighbors, triangles
from netmetrics.operators.paths import cohesion, shortest_paths
from netmetrics.plans.queries import queries
from netmetrics.sources.files import read_csv_graph

SMALL = {
    "path4": (4, "1-2 2-3 3-4", [0, 4, 4, 0], [1, 2, 2, 1], [1, 1 / 2, 1 / 2, 1], [11 / 72, 25 / 144, 25 / 144, 11 / 72]),
    "star5": (5, "1-2 1-3 1-4 1-5", [12, 0, 0, 0, 0], [4, 1, 1, 1, 1], [1 / 4, 1, 1, 1, 1], [1 / 8] * 5),
    "K4": (4, "1-2 1-3 1-4 2-3 2-4 3-4", [0] * 4, [1] * 4, [25 / 27] * 4, [1 / 24] * 4),
    "cycle5": (5, "1-2 2-3 3-4 4-5 5-1", [2] * 5, [2] * 5, [1 / 2] * 5, [13 / 240] * 5),
    "kite": (4, "1-2 1-3 2-3 3-4", [0, 0, 4, 0], [1, 1, 7 / 3, 1], [145 / 144, 145 / 144, 11 / 18, 1], [7 / 144, 7 / 144, 5 / 54, 1 / 6]),
    "parts": (6, "1-2 2-3 1-3 4-5", [0] * 6, [1, 1, 1, 1, 1, 0], [9 / 8, 9 / 8, 9 / 8, 1, 1, 0], [1 / 60, 1 / 60, 1 / 60, 1 / 30, 1 / 30, 0]),
    "double": (4, "1-2 1-2 2-3 3-4 4-1", [4 / 3, 4 / 3, 2 / 3, 2 / 3], [3, 3, 2, 2], [2 / 9, 2 / 9, 1 / 2, 1 / 2], [1 / 54, 1 / 54, 1 / 18, 1 / 18]),
}
FAMILIES = "Acciaiuoli-Medici Castellani-Peruzzi Castellani-Strozzi Castellani-Barbadori Medici-Barbadori Medici-Ridolfi Medici-Tornabuoni Medici-Albizzi Medici-Salviati Salviati-Pazzi Peruzzi-Strozzi Peruzzi-Bischeri Strozzi-Ridolfi Strozzi-Bischeri Ridolfi-Tornabuoni Tornabuoni-Guadagni Albizzi-Ginori Albizzi-Guadagni Bischeri-Guadagni Guadagni-Lamberteschi"

#: Degree, betweenness, effective size, constraint and bridging of each family.
GOLDEN = {
    "Acciaiuoli": (1, 0, 1, 1, 0.02817460), "Albizzi": (3, 38.666667, 3, 0.333333, 0.01558201), "Barbadori": (2, 17, 2, 0.5, 0.01146825),
    "Bischeri": (3, 19, 2.333333, 0.482253, 0.00682540), "Castellani": (3, 10, 2.333333, 0.482253, 0.00518519), "Ginori": (1, 0, 1, 1, 0.02539683),
    "Guadagni": (4, 46.333333, 4, 0.25, 0.01311508), "Lamberteschi": (1, 0, 1, 1, 0.02555556), "Medici": (6, 95, 5.666667, 0.209877, 0.01887566),
    "Pazzi": (1, 0, 1, 1, 0.02269841), "Peruzzi": (3, 4, 1.666667, 0.655864, 0.00351852), "Ridolfi": (3, 20.666667, 2.333333, 0.459877, 0.00716931),
    "Salviati": (2, 26, 2, 0.5, 0.03361111), "Strozzi": (4, 18.666667, 3, 0.458333, 0.00511905), "Tornabuoni": (3, 16.666667, 2.333333, 0.459877, 0.00529101),
}


def graph(spark, n, edges, simplify=True):
    v = spark.createDataFrame([(k, str(k)) for k in range(1, n + 1)], "id long, name string")
    return Graph(v, spark.createDataFrame(edges, "src long, dst long"), simplify)


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


@pytest.mark.parametrize("name", SMALL)
def test_small(spark, name):
    n, text, bet, size, con, bri = SMALL[name]
    g = graph(spark, n, [tuple(map(int, e.split("-"))) for e in text.split()], name != "double")
    assert column(betweenness(g), "betweenness") == pytest.approx(bet)
    assert column(ens(g), "ens") == pytest.approx(size)
    assert column(constraint(g), "constraint") == pytest.approx(con)
    assert column(bridging(g), "bridging") == pytest.approx(bri)


@pytest.mark.parametrize("name", ["parts", "double"])
def test_joins_agree_with_arrays(spark, name):
    n, text, bet, _, _, bri = SMALL[name]
    g = graph(spark, n, [tuple(map(int, e.split("-"))) for e in text.split()], name != "double")
    assert column(betweenness(g, limit=0), "betweenness") == pytest.approx(bet)
    assert column(bridging(g, limit=0), "bridging") == pytest.approx(bri)
    assert sorted(map(tuple, shortest_paths(g, limit=0).collect())) == sorted(map(tuple, shortest_paths(g).collect()))


def test_families(spark, tmp_path):
    (tmp_path / "e.csv").write_text("from,to,more\n" + "".join(e.replace("-", ",") + ",x\n" for e in FAMILIES.split()))
    g = read_csv_graph(spark, f"file://{tmp_path}/e.csv")
    for k, f in enumerate((betweenness, ens, constraint, bridging)):
        name = ("betweenness", "ens", "constraint", "bridging")[k]
        assert {r["name"]: r[name] for r in f(g).collect()} == pytest.approx({x: v[k + 1] for x, v in GOLDEN.items()}, abs=1e-6 if k < 3 else 1e-8)
    assert {r["name"]: r["degree"] for r in g.vertices.join(g.degree(), "id").collect()} == {x: v[0] for x, v in GOLDEN.items()}
    assert cohesion(shortest_paths(g), 15).first()[0] == pytest.approx(0.25007937)
    ids = {r["name"]: r["id"] for r in g.vertices.collect()}
    assert [r["name"] for r in kp.greedy(g, 1).collect()] == ["Medici"]
    assert kp.fit(g, [ids["Medici"]]).first()["fit"] == pytest.approx(0.633333, abs=1e-6)
    pair = kp.pair_fits(g).orderBy("fit", ascending=False).first()
    assert {pair["a"], pair["b"]} == {ids["Bischeri"], ids["Medici"]} and pair["fit"] == pytest.approx(0.733333, abs=1e-6)
    swaps = {(r["u"], r["v"]): r["fit"] for r in kp.swap_fits(g, [ids["Pazzi"], ids["Medici"]]).collect()}
    for (u, v), f in list(swaps.items())[::5]:
        assert f == pytest.approx(kp.fit(g, list({ids["Pazzi"], ids["Medici"], v} - {u})).first()["fit"])
    got = [r["id"] for r in kp.keyplayer(g, 2, maxsec=8, roundsec=2, seed=3, workers=2).collect()]
    assert len(got) == 2 and kp.fit(g, got).first()["fit"] > 0.6


def test_csv_cases(spark, tmp_path):
    (tmp_path / "e.csv").write_text('weird head,x y,z\n"a, b",01,q\n01,"a, b",q\n01,01,q\n')
    g = read_csv_graph(spark, f"file://{tmp_path}/e.csv")
    assert {r["name"] for r in g.vertices.collect()} == {"a, b", "01"} and g.edges.count() == 3
    assert column(g.degree(), "degree") == [4, 2]


def test_errors(spark):
    with pytest.raises(TypeError, match="Not a graph object"):
        betweenness("x")
    with pytest.raises(ValueError):
        Graph.from_edges(spark.createDataFrame([(1, None)], "src long, dst long"))
    with pytest.raises(ValueError):
        kp.keyplayer(graph(spark, 2, [(1, 2)]), 2)


def test_empty(spark):
    g = graph(spark, 2, [])
    for f, x in ((betweenness, "betweenness"), (ens, "ens"), (constraint, "constraint"), (bridging, "bridging")):
        assert column(f(g), x) == [0, 0]


def distances(n, edges):
    near = {k: set() for k in range(1, n + 1)}
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    out = {}
    for s in near:
        d, todo = {s: 0}, deque([s])
        while todo:
            x = todo.popleft()
            for y in near[x] - d.keys():
                d[y] = d[x] + 1
                todo.append(y)
        out[s] = d
    return near, out


@settings(max_examples=6, deadline=None)
@given(st.sets(st.tuples(st.integers(1, 7), st.integers(1, 7)), max_size=14))
def test_random(spark, edges):
    g = graph(spark, 7, sorted(edges))
    near, d = distances(7, edges)
    assert {(r["s"], r["v"]): r["d"] for r in shortest_paths(g).collect()} == {(s, v): x for s in d for v, x in d[s].items()}
    total = sum(x - 1 for s in d for v, x in d[s].items() if v != s)
    assert sum(column(betweenness(g), "betweenness")) == pytest.approx(total)
    tri = sum(1 for a, b, c in itertools.combinations(range(1, 8), 3) if b in near[a] and c in near[a] and c in near[b])
    assert triangles(g).count() == tri

    def c(e):
        return sum(1 / x for s, own in distances(7, e)[1].items() for v, x in own.items() if s < v) / 42

    whole, simple = c(edges), {tuple(sorted(e)) for e in edges if e[0] != e[1]}
    want = [sum(whole - c(simple - {e}) for e in simple if v in e) / len(near[v]) if near[v] else 0 for v in range(1, 8)]
    assert column(bridging(g), "bridging") == pytest.approx(want, abs=1e-9)
    n = {v: len(near[v]) for v in near}
    assert column(ens(g), "ens") == pytest.approx([n[v] - sum(len(near[v] & near[w]) for w in near[v]) / n[v] if n[v] else 0 for v in near])
    want = [sum((1 / n[v] + sum(1 / (n[v] * n[q]) for q in near[v] & near[w])) ** 2 for w in near[v]) for v in near]
    assert column(constraint(g), "constraint") == pytest.approx(want)
    pairs = {(v, w): len(near[v] & near[w]) for v in near for w in near}
    assert {(r["src"], r["dst"]): r["shared"] for r in shared_neighbors(g).collect()} == {p: x for p, x in pairs.items() if p[1] in near[p[0]]}
    assert {(r["src"], r["dst"]): r["shared"] for r in shared_neighbors(g, all_pairs=True).collect()} == {p: x for p, x in pairs.items() if x}


TWO_PARTS = {
    "stars": [(1, k) for k in range(2, 6)] + [(6, k) for k in range(7, 11)],
    "star_and_pairs": [(9, k) for k in range(1, 6)] + [(6, 7), (8, 10)],
    "paths": [(1, 3), (3, 5), (2, 4), (4, 6), (6, 8), (7, 9)],
}


@pytest.mark.parametrize("name", TWO_PARTS)
def test_best_pair_of_two_components(spark, tmp_path, name):
    edges = TWO_PARTS[name]
    rows = [(f"2024-01-01 00:{k:02d}:05", u) for k, e in enumerate(edges) for u in e]
    spark.createDataFrame(rows, "ts string, user_id long").selectExpr("ts::timestamp AS ts", "user_id").write.parquet(f"{tmp_path}/events.parquet")
    ids = sorted({u for e in edges for u in e})
    _, d = distances(max(ids), edges)

    def value(a, b):
        return round(sum(1 / min(d[s][v] for s in (a, b) if v in d[s]) for v in ids if v not in (a, b) and (v in d[a] or v in d[b])) / len(ids), 6)

    want = min((-value(a, b), a, b) for a, b in itertools.combinations(ids, 2))
    got = queries()["kpp_best_pair"](spark, str(tmp_path)).collect()
    assert [(r["a"], r["b"]) for r in got] == [want[1:]] and got[0]["fit"] == pytest.approx(-want[0])


@pytest.mark.parametrize("copies,limit", [(51, 1_000_000), (2, 1_000_000), (51, 0)])
def test_losses_with_many_paths(spark, copies, limit):
    # repeated edges 1-..-7 and 8-..-14, path counts of up to copies ** 12; then a bridge, a detour and two equal ways
    ends = [(k, k + 1) for k in (*range(1, 7), *range(8, 14))]
    for middle in ([(7, 8), (7, 15), (15, 16), (16, 8)], [(7, 8)], [(7, 15), (15, 8), (7, 16), (16, 8)])[: 3 if limit else 1]:
        got = {(r["src"], r["dst"]): r["loss"] for r in edge_losses(graph(spark, 16, ends * copies + middle, False), limit).collect()}
        total = lambda edges: sum(1 / x for s, own in distances(16, edges)[1].items() for v, x in own.items() if s < v)
        want = {tuple(sorted(e)): total(ends + middle) - total(ends + [x for x in middle if x != e]) for e in middle}
        assert got == pytest.approx(want)


def test_one_scan_of_the_source(spark):
    g = graph(spark, 4, [(1, 2), (2, 3), (1, 3), (3, 4)])
    for df in (triangles(g), shared_neighbors(g), constraint(g)):
        assert "ExistingRDD[src" not in df._jdf.queryExecution().executedPlan().toString()


def test_constraint_in_the_order_given(spark):
    g = graph(spark, 4, [(1, 2), (2, 3), (1, 3), (3, 4)])
    got = constraint(g, spark.createDataFrame([(3, 0), (1, 1), (4, 2)], "id long, position int")).orderBy("position").collect()
    assert [r["id"] for r in got] == [3, 1, 4] and [r["constraint"] for r in got] == pytest.approx([11 / 18, 145 / 144, 1])


def test_numeric_names(spark, tmp_path):
    (tmp_path / "e.csv").write_text("a,b\n01,1\n1,x\n2,01\n")
    names = lambda **more: {r["name"] for r in read_csv_graph(spark, f"file://{tmp_path}/e.csv", **more).vertices.collect()}
    assert names() == {"01", "1", "2", "x"} and names(normalize_numeric=True) == {"1", "2", "x"}


def test_ranks_of_names_that_begin_alike(spark):
    df = spark.range(5000).selectExpr("concat('user ', lpad(id * 7919 % 100003, 6, '0')) AS name", "id % 3 AS n")
    found = cuts(df, "name", 8)
    rows = sorted((r["name"], r["n"]) for r in df.collect())
    each = [sum(a <= x < b for x, _ in rows) for a, b in zip(["", *found], [*found, "~"], strict=True)]
    assert len(found) == 7 and max(each) < 2 * 5000 / 8
    got = {r["name"]: (r["rank"], r["before"]) for r in exclusive_sums(prefix_ranked(df, "name"), "name", "n", "before", 8).collect()}
    assert got == {x: (k + 1, sum(n for _, n in rows[:k])) for k, (x, _) in enumerate(rows)}


def test_key_player_search(spark):
    edges = [(1, k) for k in range(2, 8)] + [(8, k) for k in range(9, 14)] + [(14, k) for k in range(15, 19)] + [(7, 9), (13, 15)]
    g = graph(spark, 18, edges)
    _, d = distances(18, edges)
    value = lambda s: sum(1 / min(d[x][v] for x in s) for v in range(1, 19) if v not in s) / 18
    best = max(map(value, itertools.combinations(range(1, 19), 3)))
    for members in ([r["id"] for r in kp.greedy(g, 3).collect()], [r["id"] for r in kp.keyplayer(g, 3, maxsec=30, roundsec=10, seed=2, workers=2).collect()]):
        assert len(members) == 3 and value(members) == pytest.approx(best)
    again = [r["id"] for r in kp.keyplayer(g, 3, maxsec=30, roundsec=10, seed=2, workers=2).collect()]
    assert again == members
    with pytest.warns(UserWarning, match="maxsec"):
        assert kp.keyplayer(g, 2, maxsec=0, seed=1, workers=2).count() == 2
    with pytest.warns(UserWarning, match="rounds"):
        # two hubs of the same leaves, and a path that the swaps would turn to
        assert kp.greedy(graph(spark, 11, [(h, k) for h in (1, 7) for k in range(2, 7)] + [(8, 9), (9, 10), (10, 11)]), 2, tol=0, rounds=0).count() == 2


def test_swaps_are_valued_as_sets(spark):
    import random

    from netmetrics.operators.keyplayer import _Set
    from netmetrics.operators.paths import arrays

    rng = random.Random(5)
    edges = [(rng.randint(1, 30), rng.randint(1, 30)) for _ in range(40)]
    x = arrays(graph(spark, 30, edges))
    s = _Set(x, [1, 5, 9])
    for _ in range(60):
        u, v = rng.randrange(3), rng.randrange(30)
        if v not in s.members:
            fit, row = s.swapped(u, v)
            assert fit == pytest.approx(_Set(x, [*s.members[:u], v, *s.members[u + 1 :]]).fit)
            if rng.random() < 0.5:
                s.take(u, v, fit, row)


def test_loops_and_copies_count_in_degrees(spark):
    g = graph(spark, 3, [(1, 1), (1, 2), (2, 3)], simplify=False)
    assert column(g.degree(), "degree") == [3, 2, 1] and column(bridging(g), "bridging") == pytest.approx([1.5 / 3 / 6, 3 / 2 / 6, 1.5 / 6])


def test_meetings_are_counted_in_tiles(spark):
    import collections

    from netmetrics.functions import meetings
    from netmetrics.graph import Graph

    rng = random.Random(5)
    rows = sorted({(rng.randint(-30, 30), rng.randint(1, 40)) for _ in range(300)} | {(99, u) for u in range(1, 60)} | {(100, 77)})
    want = collections.Counter((u, w) for at, u in rows for bt, w in rows if at == bt and u < w)
    groups, users = spark.createDataFrame(rows, "at long, u long"), spark.createDataFrame([(u, str(u)) for u in sorted({u for _, u in rows})], "id long, name string")
    for blocks in (1, 2, 5):
        assert {(r["src"], r["dst"]): r["mult"] for r in meetings.pairs(groups, blocks).collect()} == want
    for simplify in (True, False):
        g = Graph.of_meetings(groups, users, simplify)
        plain = Graph(users, g.edges, simplify)
        assert sorted(map(tuple, g.degree().collect())) == sorted(map(tuple, plain.degree().collect()))
        assert sorted(map(tuple, g.adjacency().collect())) == sorted(map(tuple, plain.adjacency().collect()))
        # members are dealt out, pairs are not: no exchange but of the members, and no join
        plan = g.canonical()._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "FlatMapGroupsInArrow" in plan
    # a piece smaller than one vertex's pairs, and the sorted and the counted form
    import numpy as np

    at, u = (np.array(x) for x in zip(*rows, strict=True))
    for piece in (3, 50, 10**6):
        assert {(int(x), int(y)): int(m) for part in meetings.tile_pairs((at, u), (at, u), True, piece) for x, y, m in zip(*part, strict=True)} == want


def test_names_of_a_csv_are_sent_to_its_edges(spark, tmp_path):
    (tmp_path / "e.csv").write_text("a,b\nx,y\ny,z\nx,x\n")
    g = read_csv_graph(spark, str(tmp_path / "e.csv"))
    assert "SortMergeJoin" not in g.edges._jdf.queryExecution().executedPlan().toString() and g.edges.count() == 3
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in read_csv_graph(spark, str(tmp_path / "e.csv")).edges._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_graphs_of_many_edges_and_few_vertices_are_searched_as_bits(spark):
    from netmetrics.operators import levels, paths
    from netmetrics.operators.betweenness import betweenness_estimate

    rng = random.Random(3)
    edges = [(rng.randint(1, 22), rng.randint(1, 22)) for _ in range(90)] + [(k, k + 1) for k in range(22, 30)] + [(40, 41)]
    users = spark.createDataFrame([(k, str(k)) for k in [*range(1, 32), 40, 41]], "id long, name string")
    e, some = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(1,), (22,), (40,), (99,)], "id long")
    rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    for simplify in (True, False):
        g, plain = Graph(users, e, simplify), Graph(users, e, simplify)
        assert paths.arrays(g, 40) is None and isinstance(paths.held(g, 40), paths.Bits)
        assert rows(shortest_paths(g, limit=40)) == rows(shortest_paths(plain))
        assert rows(paths.distances(g, some, 40)) == rows(paths.distances(plain, some))
        assert rows(paths.distance_histograms(g, 40)) == rows(paths.distance_histograms(plain))
        assert rows(betweenness(g, limit=40)) == rows(betweenness(plain))
        assert rows(betweenness(g, "undirected", some, 40)) == rows(betweenness(plain, "undirected", some))
        assert rows(betweenness_estimate(g, 5, 3, 2, limit=40)) == rows(betweenness_estimate(plain, 5, 3, 2))
        assert g.bucketed is None  # no levels by joins
    assert rows(kp.greedy(g, 2, limit=40)) == rows(kp.greedy(plain, 2))
    assert paths.held(g, 4) is None and paths.held(g, 0) is None  # too many vertices
    assert isinstance(paths.held(Graph(users, e.unionByName(e), False), 40), type(None))  # too many repeated edges


def test_crossprod_of_bits(spark):
    from netmetrics.operators.local import crossprod

    rng = random.Random(8)
    e = spark.createDataFrame([(rng.randint(1, 25), rng.randint(1, 25)) for _ in range(120)] + [(30, 31)], "src long, dst long")
    for simplify in (True, False):
        want = sorted(map(tuple, crossprod(Graph.from_edges(e, simplify=simplify), limit=0).collect()))
        got = crossprod(Graph.from_edges(e, simplify=simplify), limit=100)
        assert sorted(map(tuple, got.collect())) == want
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
