"""SQL for the registered queries, from the definitions on paths.

Where the operators use closed forms, the SQL enumerates paths and tests each,
so that the two share nothing but the question.
"""

from __future__ import annotations

from itertools import combinations

from .fixtures import CYCLE, GRAPHS

NAMES = {1: "Z1", 2: "X", 3: "Z2", 4: "Y"}
_SMALL = [g for g, (n, _) in GRAPHS.items() if n <= 5]

#: Questions (graph, x, y, z): every pair, given nothing, one node, or all others.
DSEP = [(g, x, y, z) for g in GRAPHS for n in [GRAPHS[g][0]] for x, y in combinations(range(1, n + 1), 2) for z in sorted({(), *[(v,) for v in range(1, n + 1)], tuple(v for v in range(1, n + 1) if v not in (x, y))})]
#: Questions (graph, x, y, z) for adjustment: nothing, one node, two nodes.
VALID = [(g, x, y, z) for g in ("triangle", "two_conf", "chain3", "frontdoor", "iv", "mbias", "reversed", "sprinkler") for n in [GRAPHS[g][0]] for x in range(1, n + 1) for y in range(1, n + 1) if x != y for k in (0, 1, 2) for z in combinations(range(1, n + 1), k)]
#: Questions (graph, x, y, m) and (graph, z, x, y) over all different nodes.
FRONTDOORS = [(g, x, y, m) for g in _SMALL for n in [GRAPHS[g][0]] for x in range(1, n + 1) for y in range(1, n + 1) for m in range(1, n + 1) if len({x, y, m}) == 3]
INSTRUMENTS = FRONTDOORS


def _values(name: str, columns: str, rows: list[str]) -> str:
    return f"{name}({columns}) AS (SELECT * FROM (VALUES {', '.join(rows)}) v({columns}))"


def _graphs(extra: dict | None = None) -> str:
    every = {**GRAPHS, **(extra or {})}
    e = [f"('{g}', {a}::BIGINT, {b}::BIGINT)" for g, (_, edges) in every.items() for a, b in edges]
    n = [f"('{g}', {i}::BIGINT)" for g, (k, _) in every.items() for i in range(1, k + 1)]
    return "WITH RECURSIVE " + _values("e", "graph_id, src, dst", e) + ", " + _values("n", "graph_id, node", n)


_REACH = """,
r(graph_id, a, b) AS (
  SELECT graph_id, src, dst FROM e
  UNION
  SELECT r.graph_id, r.a, e.dst FROM r JOIN e ON e.graph_id = r.graph_id AND e.src = r.b
)"""

# All simple paths in the skeleton, and along the arrows.
_PATHS = _REACH + """,
sk AS (SELECT graph_id, src AS a, dst AS b FROM e UNION SELECT graph_id, dst, src FROM e),
p(graph_id, s, t, path) AS (
  SELECT graph_id, node, node, [node] FROM n
  UNION ALL
  SELECT p.graph_id, p.s, sk.b, list_append(p.path, sk.b) FROM p JOIN sk ON sk.graph_id = p.graph_id AND sk.a = p.t
  WHERE NOT list_contains(p.path, sk.b)
),
dp(graph_id, s, t, path) AS (
  SELECT graph_id, node, node, [node] FROM n
  UNION ALL
  SELECT dp.graph_id, dp.s, e.dst, list_append(dp.path, e.dst) FROM dp JOIN e ON e.graph_id = dp.graph_id AND e.src = dp.t
  WHERE NOT list_contains(dp.path, e.dst)
),
bp AS (
  SELECT p.graph_id, e.dst AS s, p.t, list_prepend(e.dst, p.path) AS path, list_contains(p.path, e.dst) AS again
  FROM e JOIN p ON p.graph_id = e.graph_id AND p.s = e.src
),
every AS (SELECT graph_id, path FROM p UNION SELECT graph_id, path FROM bp),
inner_nodes AS (
  SELECT graph_id, path, path[i] AS a, path[i + 1] AS b, path[i + 2] AS c
  FROM (SELECT graph_id, path, unnest(range(1, len(path) - 1)) AS i FROM every WHERE len(path) > 2)
),
seen AS (
  SELECT t.graph_id, t.path, t.b, (l.src IS NOT NULL AND k.src IS NOT NULL) AS collider
  FROM inner_nodes t
  LEFT JOIN e l ON l.graph_id = t.graph_id AND l.src = t.a AND l.dst = t.b
  LEFT JOIN e k ON k.graph_id = t.graph_id AND k.src = t.c AND k.dst = t.b
),
below AS (SELECT graph_id, a, list(b) AS bs FROM (SELECT graph_id, a, b FROM r UNION SELECT graph_id, node, node FROM n) GROUP BY graph_id, a)"""


def _blocked(paths: str) -> str:
    """``paths``: a query giving ``qid, graph_id, path, z``; gives those blocked."""
    return f"""
  SELECT DISTINCT k.qid, k.path FROM ({paths}) k JOIN seen t ON t.graph_id = k.graph_id AND t.path = k.path
  JOIN below w ON w.graph_id = t.graph_id AND w.a = t.b
  WHERE CASE WHEN t.collider THEN NOT list_has_any(w.bs, k.z) ELSE list_contains(k.z, t.b) END"""


def _z(z) -> str:
    return "[" + ", ".join(f"{v}::BIGINT" for v in z) + "]" if z else "[]::BIGINT[]"


def _questions(rows: list[tuple], columns: tuple[str, ...]) -> str:
    values = []
    for g, *rest in rows:
        qid = ":".join([g, *map(str, rest)])
        values.append(f"('{qid}', '{g}', " + ", ".join(_z(v) if isinstance(v, tuple) else f"{v}::BIGINT" for v in rest) + ")")
    return ",\n" + _values("q", "qid, graph_id, " + ", ".join(columns), values)


_PAIRS = """,
q AS (SELECT concat_ws(':', a.graph_id, a.node, b.node) AS qid, a.graph_id, a.node AS x, b.node AS y
      FROM n a JOIN n b ON a.graph_id = b.graph_id AND a.node <> b.node)"""

_NODE = "concat_ws(':', n.graph_id, n.node) AS qid"
SQL: dict[str, str] = {
    "fix_parents": _graphs() + f" SELECT DISTINCT {_NODE}, src AS node FROM n JOIN e ON e.graph_id = n.graph_id AND e.dst = n.node",
    "fix_children": _graphs() + f" SELECT DISTINCT {_NODE}, dst AS node FROM n JOIN e ON e.graph_id = n.graph_id AND e.src = n.node",
    "fix_ancestors": _graphs() + _REACH + f" SELECT {_NODE}, a AS node FROM n JOIN r ON r.graph_id = n.graph_id AND r.b = n.node",
    "fix_descendants": _graphs() + _REACH + f" SELECT {_NODE}, b AS node FROM n JOIN r ON r.graph_id = n.graph_id AND r.a = n.node",
    "fix_markov": _graphs()
    + f""" SELECT {_NODE}, m.v AS node FROM n JOIN (
      SELECT graph_id, dst AS y, src AS v FROM e UNION SELECT graph_id, src, dst FROM e
      UNION SELECT a.graph_id, a.src, b.src FROM e a JOIN e b ON a.graph_id = b.graph_id AND a.dst = b.dst
    ) m ON m.graph_id = n.graph_id AND m.y = n.node AND m.v <> n.node""",
    "fix_is_dag": _graphs({"cycle": CYCLE}) + _REACH + " SELECT graph_id, graph_id NOT IN (SELECT graph_id FROM r WHERE a = b) AS is_dag FROM (SELECT DISTINCT graph_id FROM n)",
    "fix_create_graph": "SELECT 'g' AS graph_id, src::BIGINT AS src, dst::BIGINT AS dst FROM (VALUES (1, 2), (1, 3), (2, 3)) v(src, dst)",
    "fix_weak_components": _graphs()
    + """, w(graph_id, a, b) AS (
      SELECT graph_id, node, node FROM n
      UNION SELECT w.graph_id, w.a, s.b FROM w JOIN (SELECT graph_id, src AS a, dst AS b FROM e UNION SELECT graph_id, dst, src FROM e) s ON s.graph_id = w.graph_id AND s.a = w.b
    ) SELECT graph_id, a AS node, min(b) AS label FROM w GROUP BY ALL""",
    "fix_dsep": _graphs()
    + _PATHS
    + _questions(DSEP, ("x", "y", "z"))
    + f""", k AS (SELECT q.qid, q.graph_id, p.path, q.z FROM q JOIN p ON p.graph_id = q.graph_id AND p.s = q.x AND p.t = q.y),
    stopped AS ({_blocked("SELECT * FROM k")})
    SELECT qid, qid NOT IN (SELECT qid FROM (SELECT qid, path FROM k EXCEPT SELECT qid, path FROM stopped)) AS separated FROM q""",
    "fix_powerset": _graphs()
    + """, s(graph_id, members, last) AS (
      SELECT DISTINCT graph_id, []::BIGINT[], 0::BIGINT FROM n
      UNION ALL SELECT s.graph_id, list_append(s.members, n.node), n.node FROM s JOIN n ON n.graph_id = s.graph_id AND n.node > s.last
    ) SELECT graph_id, array_to_string(members, ',') AS subset FROM s""",
}


def _modes(name: str, build) -> None:
    for mode in ("reference", "pearl"):
        SQL[f"{name}_{mode}"] = _graphs() + _PATHS + build(mode)


_DIRECTED = {"reference": "p", "pearl": "dp"}
_BACK = {"reference": "bp", "pearl": "(SELECT * FROM bp WHERE NOT again)"}

_modes("fix_directed_paths", lambda m: _PAIRS + f" SELECT qid, array_to_string(path, '>') AS path FROM q JOIN {_DIRECTED[m]} d ON d.graph_id = q.graph_id AND d.s = x AND d.t = y")
_modes("fix_backdoor_paths", lambda m: _PAIRS + f" SELECT qid, array_to_string(path, '>') AS path FROM q JOIN {_BACK[m]} d ON d.graph_id = q.graph_id AND d.s = x AND d.t = y")


def _validity(m: str, questions: str) -> str:
    """Adds ``valid(qid)`` over ``questions(qid, graph_id, x, y, z)``."""
    return f""", qz AS ({questions}),
    k AS (SELECT qz.qid, qz.graph_id, d.path, qz.z FROM qz JOIN {_BACK[m]} d ON d.graph_id = qz.graph_id AND d.s = qz.x AND d.t = qz.y),
    stopped AS ({_blocked("SELECT * FROM k")}),
    open_path AS (SELECT qid FROM (SELECT qid, path FROM k EXCEPT SELECT qid, path FROM stopped)),
    wrong AS (SELECT qz.qid FROM qz LEFT JOIN below w ON w.graph_id = qz.graph_id AND w.a = qz.x WHERE list_contains(qz.z, qz.y) OR list_has_any(w.bs, qz.z)),
    valid AS (SELECT qid FROM qz WHERE qid NOT IN (SELECT qid FROM open_path) AND qid NOT IN (SELECT qid FROM wrong))"""


_modes("fix_valid_adjustment", lambda m: _questions(VALID, ("x", "y", "z")) + _validity(m, "SELECT * FROM q") + " SELECT qid, qid IN (SELECT qid FROM valid) AS valid FROM qz")

_UP = "(SELECT graph_id, dst AS x, list(src ORDER BY src) AS z FROM e GROUP BY graph_id, dst)"


def _backdoor_set(m: str) -> str:
    some = f"(SELECT DISTINCT q.qid FROM q JOIN {_BACK[m]} d ON d.graph_id = q.graph_id AND d.s = q.x AND d.t = q.y)"
    base = _PAIRS + _validity(m, f"SELECT q.qid, q.graph_id, q.x, q.y, u.z FROM q JOIN {_UP} u ON u.graph_id = q.graph_id AND u.x = q.x WHERE q.qid IN {some}")
    members = "array_to_string(qz.z, ',')"
    if m == "pearl":
        members = f"CASE WHEN qz.qid IN (SELECT qid FROM valid) THEN {members} END"
    return base + f" SELECT q.qid, CASE WHEN qz.qid IS NULL THEN '' ELSE {members} END AS members FROM q LEFT JOIN qz ON qz.qid = q.qid"


_modes("fix_backdoor_set", _backdoor_set)
_modes("fix_adjustable", lambda m: _PAIRS + (" SELECT qid, true AS adjustable FROM q" if m == "reference" else " SELECT qid, NOT EXISTS (SELECT 1 FROM e WHERE e.graph_id = q.graph_id AND e.src = q.y AND e.dst = q.x) AS adjustable FROM q"))

_SUBSETS = """, free AS (SELECT q.qid, n.node FROM q JOIN n ON n.graph_id = q.graph_id LEFT JOIN r ON r.graph_id = q.graph_id AND r.a = q.x AND r.b = n.node
      WHERE n.node <> q.x AND n.node <> q.y AND r.a IS NULL),
    sub(qid, members, last) AS (
      SELECT qid, []::BIGINT[], 0::BIGINT FROM q
      UNION ALL SELECT sub.qid, list_append(sub.members, free.node), free.node FROM sub JOIN free ON free.qid = sub.qid AND free.node > sub.last
      WHERE len(sub.members) < 5
    )"""
_SETS = "SELECT q.qid || '/' || array_to_string(sub.members, ',') AS qid, q.graph_id, q.x, q.y, sub.members AS z FROM q JOIN sub ON sub.qid = q.qid"
_modes("fix_all_adjustment", lambda m: _PAIRS + _SUBSETS + _validity(m, _SETS) + " SELECT split_part(qid, '/', 1) AS qid, array_to_string(z, ',') AS members FROM qz WHERE qid IN (SELECT qid FROM valid)")
_modes(
    "fix_minimal",
    lambda m: _PAIRS
    + _SUBSETS
    + _validity(m, _SETS)
    + """, best AS (SELECT split_part(qid, '/', 1) AS qid, z, row_number() OVER (PARTITION BY split_part(qid, '/', 1) ORDER BY len(z), z) AS k FROM qz WHERE qid IN (SELECT qid FROM valid))
    SELECT q.qid, array_to_string(best.z, ',') AS members FROM q LEFT JOIN best ON best.qid = q.qid AND best.k = 1""",
)


def _frontdoor(m: str, questions: str) -> str:
    """Adds ``fd(qid)`` over ``questions(qid, graph_id, x, y, m)`` with one node m."""
    direct = f"SELECT f.qid || '/1' AS qid, f.graph_id, d.path, [f.m] AS z FROM f JOIN {_DIRECTED[m]} d ON d.graph_id = f.graph_id AND d.s = f.x AND d.t = f.y WHERE NOT list_contains(d.path, f.m)"
    first = f"SELECT f.qid || '/2' AS qid, f.graph_id, d.path, []::BIGINT[] AS z FROM f JOIN {_BACK[m]} d ON d.graph_id = f.graph_id AND d.s = f.x AND d.t = f.m"
    second = f"SELECT f.qid || '/3' AS qid, f.graph_id, d.path, [f.x] AS z FROM f JOIN {_BACK[m]} d ON d.graph_id = f.graph_id AND d.s = f.m AND d.t = f.y"
    spare = "WHERE qid NOT LIKE '%/2'" if m == "reference" else ""
    return f""", f AS ({questions}),
    k AS ({direct} UNION ALL {first} UNION ALL {second}),
    stopped AS (SELECT * FROM ({_blocked("SELECT * FROM k")}) {spare}),
    bad AS (SELECT DISTINCT split_part(qid, '/', 1) AS qid FROM (SELECT qid, path FROM k EXCEPT SELECT qid, path FROM stopped)),
    fd AS (SELECT qid FROM f WHERE qid NOT IN (SELECT qid FROM bad))"""


_modes("fix_frontdoor", lambda m: _questions(FRONTDOORS, ("x", "y", "m")) + _frontdoor(m, "SELECT * FROM q") + " SELECT qid, qid IN (SELECT qid FROM fd) AS frontdoor FROM f")
_modes(
    "fix_mediators",
    lambda m: _PAIRS
    + _frontdoor(m, f"SELECT DISTINCT q.qid || ':' || v.node AS qid, q.graph_id, q.x, q.y, v.node AS m FROM q JOIN {_DIRECTED[m]} d ON d.graph_id = q.graph_id AND d.s = q.x AND d.t = q.y JOIN n v ON v.graph_id = q.graph_id AND list_contains(d.path, v.node) WHERE v.node <> q.x AND v.node <> q.y")
    + " SELECT f.graph_id || ':' || f.x || ':' || f.y AS qid, f.m AS node FROM f WHERE qid IN (SELECT qid FROM fd)",
)


def _instrument(m: str, questions: str) -> str:
    """Adds ``iv(qid)`` over ``questions(qid, graph_id, z, x, y)``."""
    related = "JOIN r ON r.graph_id = c.graph_id AND r.a = c.z AND r.b = c.x" if m == "pearl" else "JOIN p d ON d.graph_id = c.graph_id AND d.s = c.z AND d.t = c.x"
    return f""", c AS ({questions}),
    related AS (SELECT DISTINCT c.qid FROM c {related}),
    beside AS (SELECT c.qid FROM c JOIN {_DIRECTED[m]} d ON d.graph_id = c.graph_id AND d.s = c.z AND d.t = c.y WHERE NOT list_contains(d.path, c.x)),
    confounded AS (SELECT c.qid FROM c JOIN {_BACK[m]} d ON d.graph_id = c.graph_id AND d.s = c.z AND d.t = c.y),
    iv AS (SELECT qid FROM related WHERE qid NOT IN (SELECT qid FROM beside) AND qid NOT IN (SELECT qid FROM confounded))"""


_modes("fix_valid_instrument", lambda m: _questions(INSTRUMENTS, ("z", "x", "y")) + _instrument(m, "SELECT * FROM q") + " SELECT qid, qid IN (SELECT qid FROM iv) AS valid FROM c")
_modes(
    "fix_instruments",
    lambda m: _PAIRS
    + _instrument(m, "SELECT q.qid || ':' || r.a AS qid, q.graph_id, r.a AS z, q.x, q.y FROM q JOIN r ON r.graph_id = q.graph_id AND r.b = q.x WHERE r.a <> q.y")
    + " SELECT c.graph_id || ':' || c.x || ':' || c.y AS qid, c.z AS node FROM c WHERE qid IN (SELECT qid FROM iv)",
)

_K = 10**12
_FK = f"""WITH RECURSIVE e AS (
  SELECT {_K} + n_regionkey::BIGINT AS src, {2 * _K} + n_nationkey::BIGINT AS dst FROM nation
  UNION ALL SELECT {2 * _K} + c_nationkey::BIGINT, {3 * _K} + c_custkey FROM customer
  UNION ALL SELECT {3 * _K} + o_custkey, {4 * _K} + o_orderkey FROM orders
  UNION ALL SELECT {2 * _K} + s_nationkey::BIGINT, {5 * _K} + s_suppkey FROM supplier
  UNION ALL SELECT DISTINCT {4 * _K} + l_orderkey, {6 * _K} + l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT {5 * _K} + l_suppkey, {6 * _K} + l_partkey FROM lineitem
)"""
SQL |= {
    "fk_descendant_counts": _FK
    + f""", d(qid, node) AS (
      SELECT r_regionkey::BIGINT, {_K} + r_regionkey::BIGINT FROM region UNION SELECT d.qid, e.dst FROM d JOIN e ON e.src = d.node
    ) SELECT qid, count(*) - 1 AS n_descendants FROM d GROUP BY qid""",
    "fk_ancestors_of_orders": f"""
    SELECT o_orderkey AS qid, {3 * _K} + o_custkey AS node FROM orders
    UNION ALL SELECT o_orderkey, {2 * _K} + c_nationkey::BIGINT FROM orders JOIN customer ON o_custkey = c_custkey
    UNION ALL SELECT o_orderkey, {_K} + n_regionkey::BIGINT FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "fk_children_fanout": _FK + f" SELECT kind, n_children, count(*) AS n_nodes FROM (SELECT src // {_K} AS kind, count(*) AS n_children FROM e GROUP BY src) GROUP BY ALL",
    "fk_parents_of_parts": f"""
    SELECT p_partkey AS qid, 4::BIGINT AS kind, count(DISTINCT l_orderkey) AS n_parents FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL
    UNION ALL SELECT p_partkey, 5::BIGINT, count(DISTINCT l_suppkey) FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL""",
    "fk_markov_of_customers": "SELECT c_custkey AS qid, 1 + count(o_orderkey) AS n_boundary FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL",
    "fk_weak_components": f"SELECT {3 * _K} + o_custkey AS label, 1 + count(*) AS n_nodes FROM orders GROUP BY ALL",
    "hyper_incident": "SELECT l_partkey AS vertex, count(DISTINCT l_orderkey) AS n_hyperedges FROM lineitem GROUP BY ALL",
    "hyper_cooccurrence": "WITH d AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT x.l_partkey AS a, y.l_partkey AS b, count(*) AS n FROM d x JOIN d y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY ALL",
    "prop_node_names": "SELECT * FROM (VALUES " + ", ".join(f"({k}::BIGINT, '{v}')" for k, v in NAMES.items()) + ") v(node, name)",
    "prop_upsert": "SELECT node::BIGINT AS node, key, value FROM (VALUES "
    + ", ".join(f"({k}, 'name', '\"{v}\"')" for k, v in NAMES.items())
    + ", (1, 'kind', '\"node\"'), (2, 'kind', '\"treatment\"'), (4, 'kind', '\"node\"')) v(node, key, value)",
    "ppl_confounders": "SELECT node::BIGINT AS node, name, true AS is_identifiable FROM (VALUES (1, 'Z1'), (3, 'Z2')) v(node, name)",
    "viz_backdoor_styles": "SELECT src::BIGINT AS src, dst::BIGINT AS dst, color, width::DOUBLE AS width FROM (VALUES (1, 2, 'red', 3.0), (1, 4, 'red', 3.0), (2, 3, 'black', 1.0), (3, 4, 'black', 1.0)) v(src, dst, color, width)",
}


def _effect(rows: str, strata: str) -> str:
    """``rows``: a query giving ``w..., a, y``.  The influence curve, row by row."""
    by = f"PARTITION BY {strata}" if strata else ""
    return f"""WITH d AS ({rows}), s AS (
      SELECT a, y, avg(a) OVER ({by}) AS g, avg(y) FILTER (WHERE a = 1) OVER ({by}) AS q1, avg(y) FILTER (WHERE a = 0) OVER ({by}) AS q0,
             {f"dense_rank() OVER (ORDER BY {strata})" if strata else "1"} AS cell FROM d
    ), k AS (SELECT * FROM s WHERE g > 0 AND g < 1), m AS (SELECT avg(q1 - q0) AS ate FROM k),
    c AS (SELECT CASE WHEN a = 1 THEN (y - q1) / g ELSE -(y - q0) / (1 - g) END + q1 - q0 - ate AS ic, cell, ate FROM k, m)
    SELECT round(min(ate), 6) AS estimate, round(sqrt(var_samp(ic) / count(*)), 6) AS std_error, count(*) AS n, count(DISTINCT cell) AS n_cells FROM c"""


_LINES = "SELECT l_returnflag, l_linestatus, CASE WHEN l_discount >= 0.05 THEN 1.0::DOUBLE ELSE 0 END AS a, l_quantity AS y FROM lineitem"
SQL |= {
    "ate_lineitem": _effect(_LINES, "l_returnflag, l_linestatus"),
    "ate_no_confounder": _effect(_LINES, ""),
    "ate_labels_by_lang": _effect("SELECT lang, toxic::DOUBLE AS a, quality::DOUBLE AS y FROM labels JOIN documents USING (doc_id)", "lang"),
    "ate_orders_by_segment": _effect("SELECT c_mktsegment, CASE WHEN o_orderpriority LIKE '1%' THEN 1.0::DOUBLE ELSE 0 END AS a, o_totalprice AS y FROM orders JOIN customer ON o_custkey = c_custkey", "c_mktsegment"),
}
