"""Queries over the test tables and their SQL. Doubles are rounded to six digits on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netmetrics.functions.ordered import exclusive_sums
from netmetrics.graph import Graph
from netmetrics.operators import keyplayer as kp
from netmetrics.operators import local
from netmetrics.operators.betweenness import betweenness, betweenness_estimate
from netmetrics.operators.bridging import bridging, cohesion_without
from netmetrics.operators.forest import bridges
from netmetrics.operators.paths import LIMIT, cohesion, distance_histograms, distances, shortest_paths
from netmetrics.sources.files import looked_up, read_csv_graph
from netmetrics.sources.shared import shared_path, stored
from netmetrics.sources.tables import peers, places, ring, table


def _r(x: str) -> Column:
    return (F.round(F.col(x), 6) + 0.0).alias(x)


def _scores(df: DataFrame, column: str) -> DataFrame:
    return df.select("id", "name", _r(column))


def _csv(spark: SparkSession, d: str) -> DataFrame:
    """The peers as a CSV edge list, written and read back."""
    path = shared_path(spark, "edges.csv")
    peers(spark, d).canonical().select(F.col("src").alias("from"), F.col("dst").alias("to"), F.lit("x").alias("more")).write.csv(path, header=True, compression="gzip")
    g = read_csv_graph(spark, path)
    names = looked_up(g.vertices)
    e = g.edges.join(names.select(F.col("id").alias("src"), F.col("name").alias("a")), "src").join(names.select(F.col("id").alias("dst"), F.col("name").alias("b")), "dst")
    return e.select("a", "b")


def _some(g: Graph) -> DataFrame:
    """Vertices of even id: a stated subset, given to operators that take one."""
    return g.vertices.where("id % 2 = 0").select("id")


def _three(spark: SparkSession, d: str) -> list[int]:
    """The three nations of most suppliers."""
    top = table(spark, d, "supplier").groupBy("s_nationkey").count().orderBy(F.desc("count"), "s_nationkey").limit(3)
    return [-1 - r[0] for r in top.collect()]


def _prefix(spark: SparkSession, d: str) -> DataFrame:
    x = exclusive_sums(stored(peers(spark, d).degree(), "degree"), "id", "degree", "before")
    return x.select("id", "degree", F.col("before").cast("long").alias("before"))


def _paths(x: DataFrame) -> DataFrame:
    return x.select("s", "v", F.col("d").cast("long").alias("d"), _r("sigma"))


def _bridging(g: Graph, limit: int = LIMIT) -> DataFrame:
    return bridging(g, limit).select("id", "name", (F.round("bridging", 9) + 0.0).alias("bridging"))


def _estimate(spark: SparkSession, d: str) -> DataFrame:
    x = betweenness_estimate(peers(spark, d), 12, seed=7, batches=4)
    return x.select("id", "name", _r("betweenness"), _r("error"))


def _stochastic(g: Graph, limit: int = LIMIT) -> DataFrame:
    """The fit of the pair that the stochastic search finds: on these tables the best there is."""
    found = kp.keyplayer(g, 2, seed=1, workers=4, limit=limit)
    return kp.fit(g, [r["id"] for r in found.collect()]).select("n_members", _r("fit"))


def _triangles(spark: SparkSession, d: str) -> DataFrame:
    t = local.triangles(peers(spark, d))
    x = F.array_sort(F.array("a", "b", "c"))
    return t.select(x[0].alias("a"), x[1].alias("b"), x[2].alias("c"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "canonical_edges": lambda s, d: peers(s, d, False).canonical(),
        "adjacency": lambda s, d: peers(s, d, False).adjacency(),
        "degree": lambda s, d: peers(s, d).degree(),
        "degree_multi": lambda s, d: peers(s, d, False).degree(),
        "csv_roundtrip_edges": _csv,
        "prefix_sum_degree": _prefix,
        "triangles": _triangles,
        "shared_neighbors": lambda s, d: local.shared_neighbors(peers(s, d)),
        "crossprod": lambda s, d: local.crossprod(peers(s, d, False)),
        "sparse_triple": lambda s, d: local.sparse_triple(peers(s, d)),
        "ens": lambda s, d: _scores(local.ens(peers(s, d)), "ens"),
        "ens_multi": lambda s, d: _scores(local.ens(peers(s, d, False)), "ens"),
        "constraint": lambda s, d: _scores(local.constraint(peers(s, d)), "constraint"),
        "constraint_multi": lambda s, d: _scores(local.constraint(peers(s, d, False)), "constraint"),
        "constraint_subset": lambda s, d: _scores(local.constraint(peers(s, d), _some(peers(s, d))), "constraint"),
        "bfs_single": lambda s, d: _paths(shortest_paths(places(s, d), s.createDataFrame([(-1,)], "id long"))),
        "bfs_multi": lambda s, d: _paths(shortest_paths(places(s, d), places(s, d).vertices.where("id < 0").select("id"))),
        "apsp": lambda s, d: _paths(shortest_paths(places(s, d))).drop("sigma"),
        "path_counts": lambda s, d: _paths(shortest_paths(peers(s, d))),
        "path_counts_multi": lambda s, d: _paths(shortest_paths(peers(s, d, False))),
        "betweenness": lambda s, d: _scores(betweenness(peers(s, d)), "betweenness"),
        "betweenness_forest": lambda s, d: _scores(betweenness(places(s, d)), "betweenness"),
        "betweenness_undirected": lambda s, d: _scores(betweenness(peers(s, d), "undirected"), "betweenness"),
        "apsp_by_joins": lambda s, d: distances(places(s, d), limit=0).select("s", "v", F.col("d").cast("long").alias("d")),
        "path_counts_by_joins": lambda s, d: _paths(shortest_paths(peers(s, d), limit=0)),
        "distance_histograms": lambda s, d: distance_histograms(peers(s, d), 0).select("v", F.col("d").cast("long").alias("d"), "n"),
        "betweenness_by_joins": lambda s, d: _scores(betweenness(peers(s, d), limit=0), "betweenness"),
        "betweenness_estimate": _estimate,
        "betweenness_sampled": lambda s, d: _scores(betweenness(peers(s, d), sources=_some(peers(s, d))), "betweenness"),
        "cohesion": lambda s, d: cohesion(shortest_paths(places(s, d)), places(s, d).n()).select(_r("cohesion")),
        "cohesion_without_edge": lambda s, d: cohesion_without(places(s, d)).select("src", "dst", _r("cohesion")),
        "bridging": lambda s, d: _bridging(places(s, d)),
        "bridging_peers": lambda s, d: _bridging(peers(s, d)),
        "bridging_ring": lambda s, d: _bridging(ring(s, d)),
        "bridges": lambda s, d: bridges(ring(s, d)),
        "bridging_forest_by_joins": lambda s, d: _bridging(places(s, d), 0),
        "bridging_ring_by_joins": lambda s, d: _bridging(ring(s, d), 0),
        "kpp_fit_fixed_set": lambda s, d: kp.fit(places(s, d), _three(s, d)).select("n_members", _r("fit")),
        "kpp_single_fits": lambda s, d: kp.single_fits(places(s, d)).select("id", _r("fit")),
        "kpp_best_single": lambda s, d: kp.single_fits(places(s, d)).select("id", _r("fit")).orderBy(F.desc("fit"), "id").limit(1),
        "kpp_best_pair": lambda s, d: kp.best_pair(peers(s, d)).select("a", "b", _r("fit")),
        "kpp_swap_gains": lambda s, d: kp.swap_fits(places(s, d), _three(s, d)).select("u", "v", _r("fit")),
        "keyplayer_greedy": lambda s, d: kp.greedy(peers(s, d), 1).select("id", "name"),
        "keyplayer_greedy_three": lambda s, d: kp.greedy(ring(s, d), 3).select("id", "name"),
        "keyplayer_greedy_by_joins": lambda s, d: kp.greedy(places(s, d), 2, limit=0).select("id", "name"),
        "keyplayer_stochastic": lambda s, d: _stochastic(peers(s, d)),
        "keyplayer_stochastic_by_joins": lambda s, d: _stochastic(places(s, d), 0),
    }


_PEERS = """ev AS (SELECT DISTINCT date_trunc('minute', ts) AS at, user_id AS u FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
m AS (SELECT x.u AS src, y.u AS dst, count(*) AS mult FROM ev x JOIN ev y ON x.at = y.at AND x.u < y.u GROUP BY 1, 2),
vx AS (SELECT DISTINCT u AS id, 'user ' || u AS name FROM ev)"""
_PLACES = """m AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, 1::BIGINT AS mult FROM (SELECT s_suppkey::BIGINT AS a, (-1 - s_nationkey)::BIGINT AS b FROM supplier UNION SELECT -1 - n_nationkey, -1001 - n_regionkey FROM nation)),
vx AS (SELECT s_suppkey::BIGINT AS id, s_name AS name FROM supplier UNION ALL SELECT -1 - n_nationkey, n_name FROM nation UNION ALL SELECT -1001 - r_regionkey, r_name FROM region)"""


def _graph(which: str, multi: bool = False) -> str:
    mult = "mult" if multi else "1::BIGINT"
    return f"{which},\nadj AS (SELECT src, dst, {mult} AS mult FROM m UNION ALL SELECT dst, src, {mult} FROM m),\ndeg AS (SELECT id, coalesce(sum(mult), 0)::BIGINT AS degree FROM vx LEFT JOIN adj ON src = id GROUP BY 1)"


def _walks(which: str, most: int = 8, sources: str = "TRUE", multi: bool = False) -> str:
    """sp (s, v, d, sigma): walks of each length counted, and of each pair the shortest."""
    return f"""WITH RECURSIVE {_graph(which, multi)},
w AS (SELECT id AS s, id AS v, 0::BIGINT AS d, 1::DOUBLE AS c FROM vx WHERE {sources}
 UNION ALL SELECT w.s, adj.dst, w.d + 1, sum(w.c * adj.mult) FROM w JOIN adj ON w.v = adj.src WHERE w.d < {most} GROUP BY w.s, adj.dst, w.d),
sp AS (SELECT s, v, min(d) AS d, arg_min(c, d) AS sigma FROM w GROUP BY s, v)"""


def _between(which: str, half: bool = False, sources: str = "TRUE") -> str:
    pick = sources.replace("id", "st.s")
    return f"""{_walks(which)}, bc AS (SELECT a.v AS id, sum(a.sigma * b.sigma / st.sigma) AS x FROM sp st JOIN sp a ON a.s = st.s JOIN sp b ON b.v = st.v AND b.s = a.v AND a.d + b.d = st.d WHERE a.v <> st.s AND a.v <> st.v AND {pick} GROUP BY 1)
SELECT id, name, round(coalesce(x, 0){" / 2" if half else ""}, 6) + 0.0 AS betweenness FROM vx LEFT JOIN bc USING (id)"""


_CORNERS = """co AS (SELECT a.src AS i, a.dst AS j, b.dst AS q, a.mult AS ij, b.mult AS iq, c.mult AS jq FROM adj a JOIN adj b ON a.src = b.src AND a.dst <> b.dst JOIN adj c ON c.src = a.dst AND c.dst = b.dst)"""
_THREE = "three AS (SELECT -1 - s_nationkey::BIGINT AS id FROM supplier GROUP BY s_nationkey ORDER BY count(*) DESC, s_nationkey LIMIT 3)"
_RING = _PLACES.replace("FROM nation)", "FROM nation UNION SELECT a.s_suppkey, b.s_suppkey FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1)")
_CLOSE = "n AS (SELECT count(*) AS n FROM vx)"


def _ens(multi: bool) -> str:
    return f"WITH {_graph(_PEERS, multi)}, {_CORNERS}, t AS (SELECT i AS id, sum(ij * iq * jq) AS ties FROM co GROUP BY 1) SELECT id, name, round(CASE WHEN degree > 0 THEN degree - coalesce(ties, 0)::DOUBLE / degree ELSE 0 END, 6) + 0.0 AS ens FROM vx JOIN deg USING (id) LEFT JOIN t USING (id)"


def _constraint(where: str, multi: bool = False) -> str:
    return f"""WITH {_graph(_PEERS, multi)}, {_CORNERS},
th AS (SELECT i, j, sum(1.0::DOUBLE / (degree * ij * iq * jq)) AS x FROM co JOIN deg ON deg.id = q GROUP BY 1, 2),
p AS (SELECT adj.src AS id, (1.0::DOUBLE + coalesce(x, 0)) / degree AS p FROM adj JOIN deg ON deg.id = adj.src LEFT JOIN th ON th.i = adj.src AND th.j = adj.dst),
k AS (SELECT id, sum(p * p) AS c FROM p GROUP BY 1)
SELECT id, name, round(coalesce(c, 0), 6) + 0.0 AS constraint FROM vx LEFT JOIN k USING (id) WHERE {where}"""


def _masked(which: str, most: int) -> str:
    """Distances without each edge, by brute force: walks by (edge, source), at most so many steps long."""
    return f"""WITH RECURSIVE {_graph(which)}, {_CLOSE},
w AS (SELECT e.src AS e0, e.dst AS e1, vx.id AS s, vx.id AS v, 0::BIGINT AS d FROM m e, vx
 UNION ALL SELECT DISTINCT w.e0, w.e1, w.s, adj.dst, w.d + 1 FROM w JOIN adj ON w.v = adj.src WHERE w.d < {most} AND NOT (adj.src = w.e0 AND adj.dst = w.e1) AND NOT (adj.src = w.e1 AND adj.dst = w.e0)),
sp AS (SELECT e0, e1, s, v, min(d) AS d FROM w GROUP BY ALL),
w0 AS (SELECT s, v, d FROM sp UNION ALL SELECT e0, e1, 1 FROM sp UNION ALL SELECT e1, e0, 1 FROM sp),
ce AS (SELECT e0, e1, coalesce(sum(1.0::DOUBLE / d) FILTER (WHERE s < v), 0) / (n * (n - 1)) AS c FROM sp, n GROUP BY e0, e1, n)"""


def _bridging_sql(which: str, most: int) -> str:
    return f"""{_masked(which, most)}, whole AS (SELECT s, v, min(d) AS d FROM w0 GROUP BY 1, 2),
c0 AS (SELECT sum(1.0::DOUBLE / d) FILTER (WHERE s < v) / (any_value(n) * (any_value(n) - 1)) AS c FROM whole, n),
x AS (SELECT id, sum(c0.c - ce.c) / count(*) AS b FROM ce CROSS JOIN c0 JOIN vx ON vx.id = e0 OR vx.id = e1 GROUP BY 1)
SELECT id, name, round(coalesce(b, 0), 9) + 0.0 AS bridging FROM vx LEFT JOIN x USING (id)"""


def _bridging_of_affected(which: str, most: int) -> str:
    """Brute force as _masked, but only from sources that an edge is the only way to one of its ends for."""
    return f"""{_walks(which, most)}, {_CLOSE},
ex AS (SELECT src AS e0, dst AS e1, src AS x, dst AS y FROM m UNION ALL SELECT src, dst, dst, src FROM m),
hit AS (SELECT e0, e1, a.s FROM ex JOIN sp a ON a.v = x JOIN sp b ON b.s = a.s AND b.v = y WHERE b.d = a.d + 1 AND b.sigma = a.sigma),
mw AS (SELECT e0, e1, s, s AS v, 0::BIGINT AS d FROM hit
 UNION ALL SELECT DISTINCT mw.e0, mw.e1, mw.s, adj.dst, mw.d + 1 FROM mw JOIN adj ON mw.v = adj.src WHERE mw.d < {most} AND NOT (adj.src = mw.e0 AND adj.dst = mw.e1) AND NOT (adj.src = mw.e1 AND adj.dst = mw.e0)),
md AS (SELECT e0, e1, s, v, min(d) AS d FROM mw GROUP BY ALL),
lost AS (SELECT hit.e0, hit.e1, sum(1.0::DOUBLE / sp.d - coalesce(1.0::DOUBLE / md.d, 0)) / 2 AS x FROM hit JOIN sp ON sp.s = hit.s AND sp.d > 0 LEFT JOIN md ON md.e0 = hit.e0 AND md.e1 = hit.e1 AND md.s = hit.s AND md.v = sp.v GROUP BY ALL),
b AS (SELECT id, sum(x) AS x FROM (SELECT e0 AS id, x FROM lost UNION ALL SELECT e1, x FROM lost) GROUP BY 1)
SELECT id, name, round(coalesce(b.x, 0) / greatest(degree, 1) / (SELECT n * (n - 1) FROM n), 9) + 0.0 AS bridging FROM vx JOIN deg USING (id) LEFT JOIN b USING (id)"""


def _estimated(which: str, k: int, seed: int, batches: int) -> str:
    """The draw played back: the k vertices of least hash, dealt by rank, and the spread of what their batches say."""
    return f"""{_walks(which)}, {_CLOSE}, r AS (SELECT id, row_number() OVER (ORDER BY sha256('{seed}:' || id)) AS rank FROM vx),
q AS (SELECT id AS s, rank % least({batches}, {k}, n) AS part, least({k}, n) AS k, n, least({batches}, {k}, n) AS parts FROM r, n WHERE rank <= {k}),
size AS (SELECT part, count(*) AS size FROM q GROUP BY 1),
bc AS (SELECT a.v AS id, q.part, sum(a.sigma * b.sigma / st.sigma) AS x FROM q JOIN sp st ON st.s = q.s JOIN sp a ON a.s = st.s JOIN sp b ON b.v = st.v AND b.s = a.v AND a.d + b.d = st.d WHERE a.v <> st.s AND a.v <> st.v GROUP BY 1, 2),
t AS (SELECT vx.id, sum(coalesce(x, 0)) AS t, sum(coalesce(x, 0) * coalesce(x, 0) / size) AS q FROM vx CROSS JOIN size LEFT JOIN bc ON bc.id = vx.id AND bc.part = size.part GROUP BY 1),
o AS (SELECT DISTINCT k, n, parts FROM q)
SELECT vx.id, name, round(t * n / k, 6) + 0.0 AS betweenness, round(sqrt(greatest(q - t * t / k, 0) / (parts - 1) / k * (1 - k / n)) * n, 6) + 0.0 AS error FROM vx JOIN t USING (id), o"""


#: The greedy search played back: the k best single vertices, then in each round the best of all swaps.
def _greedy(which: str, most: int, k: int) -> str:
    return f"""{_walks(which, most)}, {_CLOSE}, one AS (SELECT s AS id, sum(1.0::DOUBLE / nullif(d, 0)) / any_value(n) AS fit FROM sp, n GROUP BY 1),
top AS (SELECT list_sort(list(id)) AS m FROM (SELECT id FROM one ORDER BY round(fit, 9) DESC, id LIMIT {k})),
pr AS (SELECT s, v, d FROM sp WHERE s <> v),
st AS (SELECT m, (SELECT sum(1.0::DOUBLE / d) / any_value(n) FROM (SELECT v, min(d) AS d FROM pr, top WHERE list_contains(m, s) AND NOT list_contains(m, v) GROUP BY 1), n) AS fit, 0 AS k FROM top
 UNION ALL SELECT b.m, b.fit, k + 1 FROM (
  SELECT arg_min({{'m': m, 'fit': fit}}, {{'a': -round(fit, 9), 'u': u, 'w': w}}) AS b, any_value(k) AS k, any_value(old) AS old FROM (
   SELECT u, w, m, any_value(k) AS k, any_value(old) AS old, sum(1.0::DOUBLE / d) / any_value(n) AS fit FROM (
    SELECT u, w, m, v, min(d) AS d, any_value(k) AS k, any_value(old) AS old FROM (
     SELECT u, vx.id AS w, list_sort(list_append(list_filter(m0, lambda x: x <> u), vx.id)) AS m, k, old FROM (SELECT m AS m0, unnest(m) AS u, k, fit AS old FROM st WHERE k < 50), vx WHERE NOT list_contains(m0, vx.id)) c
    JOIN pr ON list_contains(m, pr.s) AND NOT list_contains(m, pr.v) GROUP BY u, w, m, v), n GROUP BY u, w, m))
 WHERE b.fit >= old + 1e-4)
SELECT id, name FROM (SELECT unnest(arg_max(m, k)) AS id FROM st) JOIN vx USING (id)"""


def _best_pair(walks: str) -> str:
    return f"{walks}, {_CLOSE}, pr AS (SELECT x.id AS a, y.id AS b FROM vx x JOIN vx y ON x.id < y.id), near AS (SELECT a, b, v, min(d) AS d FROM pr JOIN sp ON sp.s = a OR sp.s = b WHERE v <> a AND v <> b GROUP BY 1, 2, 3), best AS (SELECT a, b, round(sum(1.0::DOUBLE / d) / any_value(n), 6) + 0.0 AS fit FROM near, n GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 1)"


def oracle_sql() -> dict[str, str]:
    forest, forest_n = _walks(_PLACES, 4), _walks(_PLACES, 4) + f", {_CLOSE}"
    one = "one AS (SELECT vx.id, coalesce(sum(1.0::DOUBLE / nullif(sp.d, 0)), 0) / any_value(n) AS fit FROM vx CROSS JOIN n LEFT JOIN sp ON sp.s = vx.id GROUP BY 1)"
    pair, pair_places = _best_pair(_walks(_PEERS)), _best_pair(forest)
    return {
        "canonical_edges": f"WITH {_PEERS} SELECT src, dst, mult FROM m",
        "adjacency": f"WITH {_graph(_PEERS, True)} SELECT src, dst, mult FROM adj",
        "degree": f"WITH {_graph(_PEERS)} SELECT id, degree FROM deg",
        "degree_multi": f"WITH {_graph(_PEERS, True)} SELECT id, degree FROM deg",
        "csv_roundtrip_edges": f"WITH {_PEERS} SELECT src::VARCHAR AS a, dst::VARCHAR AS b FROM m",
        "prefix_sum_degree": f"WITH {_graph(_PEERS)} SELECT id, degree, coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM deg",
        "triangles": f"WITH {_PEERS} SELECT x.src AS a, x.dst AS b, y.dst AS c FROM m x JOIN m y ON x.dst = y.src JOIN m z ON z.src = x.src AND z.dst = y.dst",
        "shared_neighbors": f"WITH {_graph(_PEERS)}, {_CORNERS} SELECT adj.src, adj.dst, count(q) AS shared FROM adj LEFT JOIN co ON i = src AND j = dst GROUP BY 1, 2",
        "crossprod": f"WITH {_graph(_PEERS, True)} SELECT a.src, b.dst, sum(a.mult * b.mult)::BIGINT AS shared FROM adj a JOIN adj b ON a.dst = b.src GROUP BY 1, 2",
        "sparse_triple": f"WITH {_graph(_PEERS)}, {_CORNERS} SELECT i, j, q, jq * iq * ij * degree AS weight FROM co JOIN deg ON id = q",
        "ens": _ens(False),
        "ens_multi": _ens(True),
        "constraint": _constraint("TRUE"),
        "constraint_multi": _constraint("TRUE", True),
        "constraint_subset": _constraint("id % 2 = 0"),
        "bfs_single": f"{_walks(_PLACES, 4, 'id = -1')} SELECT s, v, d, round(sigma, 6) + 0.0 AS sigma FROM sp",
        "bfs_multi": f"{_walks(_PLACES, 4, 'id < 0')} SELECT s, v, d, round(sigma, 6) + 0.0 AS sigma FROM sp",
        "apsp": f"{forest} SELECT s, v, d FROM sp",
        "path_counts": f"{_walks(_PEERS)} SELECT s, v, d, round(sigma, 6) + 0.0 AS sigma FROM sp",
        "path_counts_multi": f"{_walks(_PEERS, multi=True)} SELECT s, v, d, round(sigma, 6) + 0.0 AS sigma FROM sp",
        "apsp_by_joins": f"{forest} SELECT s, v, d FROM sp",
        "path_counts_by_joins": f"{_walks(_PEERS)} SELECT s, v, d, round(sigma, 6) + 0.0 AS sigma FROM sp",
        "distance_histograms": f"{_walks(_PEERS)} SELECT v, d, count(*) AS n FROM sp GROUP BY 1, 2",
        "betweenness": _between(_PEERS),
        "betweenness_by_joins": _between(_PEERS),
        "betweenness_estimate": _estimated(_PEERS, 12, 7, 4),
        "betweenness_forest": _between(_PLACES),
        "betweenness_undirected": _between(_PEERS, True),
        "betweenness_sampled": _between(_PEERS, sources="id % 2 = 0"),
        "cohesion": f"{forest_n} SELECT round(sum(1.0::DOUBLE / d) FILTER (WHERE s < v) / (any_value(n) * (any_value(n) - 1)), 6) + 0.0 AS cohesion FROM sp, n",
        "cohesion_without_edge": f"{_masked(_PLACES, 4)} SELECT e0 AS src, e1 AS dst, round(c, 6) + 0.0 AS cohesion FROM ce",
        "bridging": _bridging_sql(_PLACES, 4),
        "bridging_peers": _bridging_of_affected(_PEERS, 8),
        "bridging_ring": _bridging_sql(_RING, 20),
        "bridges": f"{_masked(_RING, 20)} SELECT e0 AS src, e1 AS dst FROM m JOIN ce ON e0 = src AND e1 = dst WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.e0 = src AND sp.e1 = dst AND sp.s = src AND sp.v = dst)",
        "bridging_forest_by_joins": _bridging_sql(_PLACES, 4),
        "bridging_ring_by_joins": _bridging_sql(_RING, 20),
        "kpp_fit_fixed_set": f"{forest_n}, {_THREE}, near AS (SELECT v, min(d) AS d FROM sp WHERE s IN (SELECT id FROM three) AND v NOT IN (SELECT id FROM three) GROUP BY 1) SELECT 3::BIGINT AS n_members, round(sum(1.0::DOUBLE / d) / any_value(n), 6) + 0.0 AS fit FROM near, n",
        "kpp_single_fits": f"{forest_n}, {one} SELECT id, round(fit, 6) + 0.0 AS fit FROM one",
        "kpp_best_single": f"{forest_n}, {one} SELECT id, round(fit, 6) + 0.0 AS fit FROM one ORDER BY 2 DESC, 1 LIMIT 1",
        "kpp_best_pair": f"{pair} SELECT a, b, fit FROM best",
        "kpp_swap_gains": f"{forest_n}, {_THREE}, sw AS (SELECT t.id AS u, vx.id AS v FROM three t, vx WHERE vx.id NOT IN (SELECT id FROM three)), mem AS (SELECT u, v, three.id AS x FROM sw JOIN three ON three.id <> u UNION ALL SELECT u, v, v FROM sw), near AS (SELECT mem.u, mem.v, sp.v AS t, min(sp.d) AS d FROM mem JOIN sp ON sp.s = mem.x GROUP BY 1, 2, 3) SELECT u, v, round(sum(1.0::DOUBLE / nullif(d, 0)) / any_value(n), 6) + 0.0 AS fit FROM near, n GROUP BY 1, 2",
        "keyplayer_greedy": f"{_walks(_PEERS)}, {_CLOSE}, {one} SELECT id, name FROM one JOIN vx USING (id) ORDER BY round(fit, 9) DESC, id LIMIT 1",
        "keyplayer_greedy_three": _greedy(_RING, 12, 3),
        "keyplayer_greedy_by_joins": _greedy(_PLACES, 4, 2),
        "keyplayer_stochastic_by_joins": f"{pair_places} SELECT 2::BIGINT AS n_members, fit FROM best",
        "keyplayer_stochastic": f"{pair} SELECT 2::BIGINT AS n_members, fit FROM best",
    }
