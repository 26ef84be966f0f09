"""The forms for graphs that are too large to be arrays: against brute force on small graphs, and what their plans and rows are."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from netmetrics.graph import Graph
from netmetrics.operators import dense, forest, levels, local, paths, repair, tiles
from netmetrics.operators import keyplayer as kp
from netmetrics.operators.betweenness import betweenness, betweenness_estimate, drawn_sources
from netmetrics.operators.bridging import bridging, edge_losses
from netmetrics.operators.paths import cohesion, cohesion_of, distance_histograms, distances, shortest_paths
from netmetrics.sources.shared import stored
from test_graph import distances as plain_distances
from test_graph import graph


def hubs(n=80, seed=4):
    """Two hubs, most vertices next to one of them, some ties between those, pairs apart from all."""
    rng = random.Random(seed)
    edges = [(1 + v % 2, v) for v in range(3, n - 5)] + [(1, 2)] + [(rng.randint(3, n - 6), rng.randint(3, n - 6)) for _ in range(25)]
    return n, [*edges, (n - 6, n - 5), (n - 4, n - 3), (n - 1, n - 2)]


def test_bits_and_batches(spark):
    n, edges = hubs()
    g = graph(spark, n, edges)
    _, want = plain_distances(n, edges)
    rows = {(s, v): x for s in want for v, x in want[s].items()}
    # words of 64 sources, a second batch
    assert {(r["s"], r["v"]): r["d"] for r in levels.distances(g, batch=66).collect()} == rows
    some = spark.createDataFrame([(1,), (n,), (1,), (n + 5,)], "id long")
    assert {(r["s"], r["v"]): r["d"] for r in distances(g, some, limit=0).collect()} == {k: x for k, x in rows.items() if k[0] in (1, n)}
    count = {}
    for (_, v), x in rows.items():
        count[v, x] = count.get((v, x), 0) + 1
    assert {(r["v"], r["d"]): r["n"] for r in levels.distance_histograms(g, batch=66).collect()} == count
    assert cohesion_of(g, 0).first()[0] == pytest.approx(cohesion(shortest_paths(g), n).first()[0])


def test_path_counts_by_batches(spark):
    n, edges = 9, [(1, 2), (1, 2), (2, 3), (3, 4), (4, 1), (3, 5), (5, 6), (6, 7), (7, 3), (8, 9)]
    g = graph(spark, n, edges, simplify=False)
    want = sorted(map(tuple, shortest_paths(g).collect()))
    assert sorted(map(tuple, levels.path_counts(g, batch=4).collect())) == want
    got = {}
    for r in levels.dependencies(g, batch=4).collect():
        got[r["id"]] = got.get(r["id"], 0) + r["betweenness"]
    assert got == pytest.approx({r["id"]: r["betweenness"] for r in betweenness(g).collect() if r["betweenness"]})
    empty = graph(spark, 2, [])
    assert levels.dependencies(empty).count() == 0 and levels.path_counts(empty).count() == 2


def test_one_exchange_a_level(spark):
    g = graph(spark, 6, [(k, k + 1) for k in range(1, 6)])
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        bits = [t for _, t in levels.distance_levels(g, [1, 6])]
        counts = [t for _, t in levels.count_levels(g, [1, 6])]
        for df in (levels.next_level(bits[2], bits[1], levels.adjacency(g), ["m0"]), levels.next_counts(counts[2], counts[1], levels.adjacency(g), ["g0", "g1"])):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert len(re.findall(r"Exchange hashpartitioning\((\w+)", plan)) == 1 and "Exchange hashpartitioning(dst" in plan
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def grids(side=4):
    """Two grids, joined by one edge and by a way around it."""
    at = lambda k, x, y: 1 + k * side * side + x * side + y
    edges = [(at(k, x, y), at(k, x + a, y + b)) for k in (0, 1) for x in range(side) for y in range(side) for a, b in ((0, 1), (1, 0)) if x + a < side and y + b < side]
    n = 2 * side * side + 2
    return n, [*edges, (at(0, side - 1, side - 1), at(1, 0, 0)), (at(0, 0, 0), n - 1), (n - 1, n), (n, at(1, side - 1, side - 1))]


def test_repair(spark):
    n, edges = grids()
    g = graph(spark, n, edges)
    near, e = stored(levels.distances(g), "near"), stored(g.canonical().select("src", "dst"), "edges")
    got = {(r["src"], r["dst"], r["s"], r["v"]): (r["d"], r["t"]) for r in repair.repaired(g, e, near).collect()}
    simple = {tuple(sorted(x)) for x in edges}
    _, whole = plain_distances(n, edges)
    want = {}
    for x in simple:
        _, without = plain_distances(n, simple - {x})
        want |= {(*x, s, v): (d, without[s].get(v)) for s in whole for v, d in whole[s].items() if without[s].get(v) != d}
    assert got == want
    # only what is affected, and their neighbours, is touched: far less than all vertices for each edge and source
    hurt = repair.affected(g, e, near)
    assert hurt.count() == len(want) < 0.1 * len(simple) * n * n


def test_bridges(spark):
    rng = random.Random(6)
    for k in range(2):
        n, edges = 14, [(rng.randint(1, 14), rng.randint(1, 14)) for _ in range(12 + 3 * k)]
        g = graph(spark, n, edges, simplify=False)
        one = {tuple(sorted(e)) for e in edges if e[0] != e[1]}
        copies = {e: sum(tuple(sorted(x)) == e for x in edges) for e in one}
        want = {e for e in one if copies[e] == 1 and e[1] not in plain_distances(n, one - {e})[1][e[0]]}
        assert {tuple(r) for r in forest.bridges(g).collect()} == want
        if k == 0:
            loss = {(r["src"], r["dst"]): r["loss"] for r in forest.bridge_losses(g).collect()}
            total = lambda es: sum(1 / d for s, own in plain_distances(n, es)[1].items() for v, d in own.items() if s < v)
            assert loss == pytest.approx({e: total(one) - total(one - {e}) for e in want})


def test_losses_by_joins(spark):
    n, edges = grids(3)
    edges = [*edges, (1, n + 1), (n + 1, n + 2)]  # bridges too
    want = {tuple(r)[:2]: r["loss"] for r in edge_losses(graph(spark, n + 2, edges)).collect()}
    assert {tuple(r)[:2]: r["loss"] for r in edge_losses(graph(spark, n + 2, edges), limit=0).collect()} == pytest.approx(want)


def test_key_players_by_joins(spark):
    edges = [(1, k) for k in range(2, 7)] + [(7, k) for k in range(8, 12)] + [(2, 3), (3, 4), (8, 6)]
    g = graph(spark, 11, edges)
    _, d = plain_distances(11, edges)
    value = lambda s: sum(1 / min(d[x][v] for x in s) for v in range(1, 12) if v not in s) / 11
    best = max(map(value, itertools.combinations(range(1, 12), 2)))
    assert value([r["id"] for r in kp.greedy(g, 2, limit=0).collect()]) == pytest.approx(best)
    got = [r["id"] for r in kp.keyplayer(g, 2, seed=2, workers=2, limit=0, maxsec=200).collect()]
    assert len(got) == 2 and value(got) == pytest.approx(best)
    with pytest.warns(UserWarning, match="maxsec"):
        assert kp.keyplayer(g, 2, maxsec=0, seed=1, workers=2, limit=0).count() == 2


def test_swaps_by_joins(spark):
    from netmetrics.operators import swaps

    rng = random.Random(9)
    edges = [(rng.randint(1, 16), rng.randint(1, 16)) for _ in range(16)]
    g = graph(spark, 16, edges)
    _, d = plain_distances(16, edges)
    sets = [[1, 5, 9], [2, 5, 16]]
    s = swaps.Sets(g, sets)

    def value(members):
        return sum(1 / min(d[x][v] for x in members if v in d[x]) for v in range(1, 17) if v not in members and any(v in d[x] for x in members)) / 16

    pairs = [(k, v) for k in (0, 1) for v in range(1, 17) if v not in sets[k]]
    got = {(r["number"], r["u"], r["v"]): r["fit"] for r in s.valued(pairs).collect()}
    assert got == pytest.approx({(k, u, v): value({*sets[k], v} - {u}) for k, v in pairs for u in sets[k]})
    assert s.value == pytest.approx([value(x) for x in sets])
    most = {r["v"]: r["most"] for r in s.bounds(0, swaps.totals(g)).collect()}
    assert all(most[v] >= 16 * got[k, u, v] - 1e-9 for k, u, v in got if k == 0) and len(most) == 13


def test_best_pair_values_few(spark, monkeypatch):
    n, edges = hubs(120)
    g = graph(spark, n, edges)
    _, d = plain_distances(n, edges)
    value = lambda a, b: sum(1 / min(d[s][v] for s in (a, b) if v in d[s]) for v in range(1, n + 1) if v not in (a, b) and (v in d[a] or v in d[b])) / n
    want = min((-round(value(a, b), 6), a, b) for a, b in itertools.combinations(range(1, n + 1), 2))
    valued, real = [], kp.pair_values
    monkeypatch.setattr(kp, "pair_values", lambda pairs, *more: valued.append(pairs.count()) or real(pairs, *more))
    got = kp.best_pair(g, start=8).first()
    assert (got["a"], got["b"]) == want[1:] and got["fit"] == pytest.approx(-want[0], abs=1e-6)
    assert sum(valued) < n * (n - 1) / 2 / 10


def test_cross_product_of_a_hub(spark):
    n, edges = 400, [(1, v) for v in range(2, 401)] + [(2, 3), (2, 3), (5, 9)]
    g = graph(spark, n, edges, simplify=False)
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    want = {}
    for own in near.values():
        for x, y in itertools.product(own, own):
            want[x, y] = want.get((x, y), 0) + 1
    assert {(r["src"], r["dst"]): r["shared"] for r in local.crossprod(g, block=50).collect()} == want
    # the hub's 399 neighbours lie in 8 blocks: 64 keys of some 50 * 50 pairs, none of more than twice that
    seen = []
    real = Graph.adjacency
    plan = local.crossprod(g, block=50)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and real(g).count() == 2 * len({tuple(sorted(e)) for e in edges})
    own = real(g).where("src = 1").selectExpr("pmod(xxhash64(dst), 8) AS b").groupBy("b").count().collect()
    seen = [r["count"] for r in own]
    assert len(seen) == 8 and max(seen) < 2 * 50


def test_random_sources(spark):
    n, edges = hubs(40)
    g = graph(spark, n, edges)
    exact = {r["id"]: r["betweenness"] for r in betweenness(g).collect()}
    whole = betweenness_estimate(g, n + 3, seed=1).collect()
    assert {r["id"]: r["betweenness"] for r in whole} == pytest.approx(exact) and all(r["error"] == 0 for r in whole)
    few, more = ([r["id"] for r in drawn_sources(g, k, 5).orderBy("rank").collect()] for k in (6, 15))
    assert few == more[:6] and len(set(more)) == 15 and few != [r["id"] for r in drawn_sources(g, 6, 6).orderBy("rank").collect()]
    got = {r["id"]: r for r in betweenness_estimate(g, 20, seed=5, batches=5).collect()}
    assert sum(abs(got[v]["betweenness"] - exact[v]) <= 4 * got[v]["error"] + 1e-9 for v in exact) >= 0.9 * n
    with pytest.raises(ValueError):
        betweenness_estimate(g, 0)


def leafy(n=60):
    """A path of three hubs with nearly all other vertices on them, two pairs apart, and one vertex alone."""
    edges = [(1, 2), (2, 3)] + [(1 + v % 3, v) for v in range(4, n - 4)] + [(n - 1, n - 2), (n - 4, n - 3)]
    return n, edges


def test_leaves_are_not_searched_from(spark, monkeypatch):
    n, edges = leafy()
    g, asked, search = graph(spark, n, edges), [], levels.distance_levels
    monkeypatch.setattr(levels, "distance_levels", lambda g, ids: asked.extend(ids) or search(g, ids))
    monkeypatch.setattr(repair, "losses", lambda *_: pytest.fail("a forest has no edges to repair"))
    _, want = plain_distances(n, edges)
    assert {(r["s"], r["v"]): r["d"] for r in distances(g, limit=0).collect()} == {(s, v): x for s in want for v, x in want[s].items()}
    count = {}
    for s in want:
        for x in want[s].values():
            count[s, x] = count.get((s, x), 0) + 1
    assert sorted(map(tuple, levels.distance_histograms(g).collect())) == sorted((*k, x) for k, x in count.items())
    assert {r["src"]: r["loss"] for r in edge_losses(g, 0).where("dst > 3 and src > 3").collect()} == {n - 4: 1.0, n - 2: 1.0}
    assert len(asked) <= 3 * n // levels.CORE  # before: every vertex, three times
    small = graph(spark, n, edges)
    a, b = ({(r["src"], r["dst"]): r["loss"] for r in edge_losses(x, k).collect()} for x, k in ((g, 0), (small, 10**6)))
    assert a == pytest.approx(b)


def test_leaves_by_size(spark):
    n, edges = hubs()  # ties between the leaves: too few are left
    assert levels.parted(graph(spark, n, edges)) is None
    g = graph(spark, 3, [(1, 2), (1, 2), (2, 3)], simplify=False)
    assert levels.parted(g) is None and levels.parted(graph(spark, 9, [(1, v) for v in range(2, 10)]))[1].count() == 8


@pytest.mark.parametrize("simple", [True, False])
def test_neighbourhoods_without_listed_triangles(spark, monkeypatch, simple):
    rng = random.Random(8)
    met = {(at, rng.randint(1, 150)) for at in range(60) for _ in range(10)} | {(60, 151), (61, 150), (61, 152), (62, 150), (62, 152)}
    groups = spark.createDataFrame(sorted(met), "at long, u long")
    users = groups.select(F.col("u").alias("id")).distinct().withColumn("name", F.col("id").cast("string"))
    whole = lambda: [{r["id"]: r[2] for r in f(Graph.of_meetings(groups, users, simple)).collect()} for f in (local.ens, local.constraint)]
    want = whole()
    monkeypatch.setattr(dense, "LEAST", 0)
    monkeypatch.setattr(dense, "COLUMNS", 64)
    monkeypatch.setattr(dense, "ROWS", 40)
    monkeypatch.setattr(local, "_triangles", lambda _: pytest.fail("triangles are listed"))
    got = whole()
    assert got == [pytest.approx(x, rel=1e-12) for x in want] and got[0][151] == 0.0 and len(got[0]) == len({u for _, u in met})


def meeting(spark, simple, seed=8):
    """Users of random groups, a far end of several levels, a pair apart and a user alone."""
    rng = random.Random(seed)
    met = {(at, rng.randint(1, 150)) for at in range(60) for _ in range(10)} | {(60, 151), (61, 150), (61, 152), (62, 150), (62, 152), (63, 152), (63, 153), (64, 153), (64, 154), (65, 160), (65, 161)}
    groups = spark.createDataFrame(sorted(met), "at long, u long")
    users = groups.select(F.col("u").alias("id")).distinct().withColumn("name", F.col("id").cast("string"))
    return lambda: Graph.of_meetings(groups, users, simple)


@pytest.mark.parametrize("simple", [True, False])
def test_searches_by_tiles(spark, monkeypatch, simple):
    make = meeting(spark, simple)
    rows = lambda df: sorted(map(tuple, df.collect()))
    calls = {
        "histograms": lambda k: rows(distance_histograms(make(), k)),
        "distances": lambda k: rows(distances(make(), limit=k)),
        "paths": lambda k: rows(shortest_paths(make(), limit=k)),
        "betweenness": lambda k: {r["id"]: r["betweenness"] for r in betweenness(make(), limit=k).collect()},
        "some": lambda k: {r["id"]: r["betweenness"] for r in betweenness(make(), "undirected", spark.createDataFrame([(3,), (154,), (999,)], "id long"), k).collect()},
        "estimate": lambda k: {r["id"]: r[2:] for r in betweenness_estimate(make(), 12, 7, 5, limit=k).collect()},
    }
    want = {k: f(10**6) for k, f in calls.items()}
    monkeypatch.setattr(dense, "LEAST", 0)
    monkeypatch.setattr(dense, "BLOCKS", 2)
    for name in ("dependencies", "path_counts", "distances", "distance_histograms"):
        monkeypatch.setattr(levels, name, lambda *_: pytest.fail("searched by joins, a batch of sources at a time"))
    got = {k: f(0) for k, f in calls.items()}
    for k in ("histograms", "distances", "paths"):
        assert got[k] == want[k], k
    # a matrix that no task holds, rows of several pieces, batches of a few sources
    monkeypatch.setattr(tiles, "HELD", 0)
    monkeypatch.setattr(tiles, "ROWS", 40)
    monkeypatch.setattr(tiles, "VALUES", 160)
    got["tiles some"] = calls["some"](0)
    for k in ("betweenness", "some", "tiles some"):
        assert got[k] == pytest.approx(want[k.removeprefix("tiles ")]), k
    assert got["estimate"].keys() == want["estimate"].keys() and all(x == pytest.approx(want["estimate"][v], abs=1e-6) for v, x in got["estimate"].items())


def test_losses_by_sources(spark, monkeypatch):
    n, edges = grids(3)
    edges = [*edges, (1, n + 1), (n + 1, n + 2), (2, 3), (n + 4, n + 5), (n + 5, n + 6), (n + 6, n + 4)]  # bridges, a component apart, a vertex alone
    for simple, more in ((True, []), (False, [(1, 2), (n, n - 1)])):
        make = lambda: graph(spark, n + 6, edges + more, simple)  # noqa: E731, B023
        losses = lambda *k: {tuple(r)[:2]: r["loss"] for r in edge_losses(make(), *k).collect()}
        want = losses()
        monkeypatch.setattr(repair, "losses", lambda *_: pytest.fail("repaired by joins, a batch of sources at a time"))
        assert losses(10**6, 0) == pytest.approx(want)
        monkeypatch.setattr(paths, "SEARCHED", 0)
        assert losses(0, 0) == pytest.approx(want)


def test_bridging_of_bits(spark, monkeypatch):
    make = meeting(spark, True)
    score = lambda *k: {r["id"]: r["bridging"] for r in bridging(make(), *k).collect()}
    want = score()
    monkeypatch.setattr(repair, "losses", lambda *_: pytest.fail("repaired by joins, a batch of sources at a time"))
    assert score(400) == pytest.approx(want)  # too few edges for arrays, but for bits
    monkeypatch.setattr(dense, "LEAST", 0)
    monkeypatch.setattr(dense, "BLOCKS", 2)
    assert score(0) == pytest.approx(want)


def test_rows_of_paths_lie_by_vertex(spark):
    n, edges = hubs()
    g = graph(spark, n, edges)
    for df in (shortest_paths(g), distances(g)):
        rows = [[r["v"] for r in own] for own in df.rdd.glom().collect()]
        runs = sum(sum(a != b for a, b in itertools.pairwise(own)) + 1 for own in rows if own)
        assert sum(map(len, rows)) > 5 * runs  # by source no two rows in a row have one vertex


def test_triangles_by_tiles(spark, monkeypatch):
    make = meeting(spark, True)
    want = sorted(map(tuple, local.triangles(make()).collect()))
    monkeypatch.setattr(dense, "LEAST", 0)
    monkeypatch.setattr(dense, "BLOCKS", 3)
    monkeypatch.setattr(dense, "LISTED", 50)
    monkeypatch.setattr(local, "_triangles", lambda _: pytest.fail("wedges are joined"))
    assert sorted(map(tuple, local.triangles(make()).collect())) == want and len(want) > 100


def test_few_are_searched_for_key_players(spark, monkeypatch):
    from netmetrics.operators import swaps

    n, edges = leafy(90)
    edges = [*edges, *((v, v + 1) for v in range(4, 80))]
    want = sorted(r["id"] for r in kp.greedy(graph(spark, n, edges), 2).collect())
    g, asked, search = graph(spark, n, edges), set(), levels.distance_levels
    monkeypatch.setattr(levels, "distance_levels", lambda g, ids: asked.update(ids) or search(g, ids))
    real = swaps.best_singles
    monkeypatch.setattr(swaps, "best_singles", lambda g, k, most: real(g, k, most, 4))
    assert sorted(r["id"] for r in kp.greedy(g, 2, limit=0).collect()) == want
    assert len(asked) < n / 2  # before: every vertex


def test_leaves_are_no_candidates_for_first_members(spark, monkeypatch):
    from netmetrics.operators import swaps

    n, edges = leafy(90)
    want = sorted(r["id"] for r in kp.greedy(graph(spark, n, edges), 2).collect())
    monkeypatch.setattr(swaps, "best_singles", lambda *_: pytest.fail("leaves are searched from, a batch at a time"))
    assert sorted(r["id"] for r in kp.greedy(graph(spark, n, edges), 2, limit=0).collect()) == want


def test_swaps_list_no_pairs(spark, monkeypatch):
    n, edges = leafy(70)
    g, sets = graph(spark, n, edges), [1, 5, n - 2]
    rows = lambda x: {(r["u"], r["v"]): r["fit"] for r in x.collect()}
    want = rows(kp.swap_fits(g, sets, shortest_paths(g)))
    assert len(want) == 3 * (n - 3)
    asked, near = [], kp.distances
    monkeypatch.setattr(kp, "shortest_paths", lambda *_, **__: pytest.fail("all pairs are listed"))
    monkeypatch.setattr(kp, "distances", lambda g, sources, limit: asked.append(sources.count()) or near(g, sources, limit))
    assert rows(kp.swap_fits(g, sets)) == pytest.approx(want) and not asked
    monkeypatch.setattr(kp, "SEARCHED", 0)
    assert rows(kp.swap_fits(g, sets)) == pytest.approx(want) and sum(asked) <= 3 + n // levels.CORE


@pytest.mark.parametrize("simple", [True, False])
def test_common_neighbours_by_tiles(spark, monkeypatch, simple):
    make = meeting(spark, simple)
    rows = lambda f: sorted(map(tuple, f(make()).collect()))
    calls = [local.shared_neighbors, lambda g: local.crossprod(g, limit=0), *([local.sparse_triple] if simple else [])]
    want = [rows(f) for f in calls]
    monkeypatch.setattr(dense, "LEAST", 0)
    monkeypatch.setattr(dense, "BLOCKS", 3)
    monkeypatch.setattr(dense, "COLUMNS", 64)
    monkeypatch.setattr(dense, "ROWS", 40)
    monkeypatch.setattr(dense, "LISTED", 50)
    monkeypatch.setattr(dense, "WORDS", 2)
    monkeypatch.setattr(local, "_triangles", lambda _: pytest.fail("triangles are joined"))
    monkeypatch.setattr(Graph, "adjacency", lambda _: pytest.fail("pairs are joined"))
    assert [rows(f) for f in calls] == want and len(want[0]) > 100


def test_matrix_is_not_padded_by_degree(spark):
    """Of vertices of many degrees the columns took a word for each degree, and the rows too."""
    import numpy as np
    import pyarrow as pa

    at = dense.Layout(pa.table({"id": np.arange(1000), "degree": np.arange(1000) // 2 + 1}), 4)
    assert 64 * at.words * at.blocks == 1024
    words, bits, weight = at.parts()
    whole = np.zeros(16, np.uint64)
    np.bitwise_or.at(whole, words, bits)
    assert int(np.bitwise_count(whole).sum()) == 1000 == int(np.bitwise_count(bits).sum())
    assert float(np.bitwise_count(bits) @ weight) == pytest.approx(float(at.weight.sum()))
