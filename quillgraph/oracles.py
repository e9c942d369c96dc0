"""SQL that gives the same rows as the registered queries of the graph engine."""

from __future__ import annotations


def _hash(i: str, k: int) -> str:
    return f"(CAST(CAST('0x' || substr(md5(CAST({i} AS VARCHAR) || ':{k // 4}'), {8 * (k % 4) + 1}, 8) AS BIGINT) AS DOUBLE) / 4294967296e0)"


def _edges(rows: str, left: str, right: str) -> str:
    return f"SELECT {left} * 2 AS i, {right} * 2 + 1 AS j, CAST(count(*) AS DOUBLE) AS w FROM {rows} GROUP BY 1, 2"


_BOTH = "adj AS MATERIALIZED (SELECT i, j, w FROM e0 UNION ALL SELECT j, i, w FROM e0)"
_GRAPH = f"""e0 AS MATERIALIZED ({_edges("lineitem", "l_orderkey", "l_partkey")}), {_BOTH},
ids AS MATERIALIZED (SELECT DISTINCT i FROM adj),
lap AS MATERIALIZED (SELECT i, j, -w AS v FROM adj UNION ALL SELECT i, i, sum(w) AS v FROM adj GROUP BY i),
x AS MATERIALIZED (SELECT i, {_hash("i", 0)} AS v FROM ids), y AS MATERIALIZED (SELECT i, {_hash("i", 1)} AS v FROM ids)"""
_ELIM = """cand AS (SELECT i FROM lap GROUP BY i HAVING count(*) - 1 <= 4),
elim AS MATERIALIZED (SELECT a.i FROM lap a JOIN cand p ON a.i = p.i JOIN cand q ON a.j = q.i GROUP BY a.i HAVING min(a.j) = a.i),
dg AS MATERIALIZED (SELECT i, v AS d FROM lap WHERE i = j),
kept AS MATERIALIZED (SELECT i FROM dg WHERE i NOT IN (SELECT i FROM elim)),
p AS MATERIALIZED (SELECT i, i AS c, CAST(1 AS DOUBLE) AS v FROM kept UNION ALL
    SELECT a.i, a.j, -a.v / dg.d FROM lap a JOIN elim e ON e.i = a.i JOIN dg ON dg.i = a.i WHERE a.i <> a.j)"""
_BLOCKS = "blk AS (SELECT i, i // 8 AS agg FROM ids)"
_STRENGTH = """s AS MATERIALIZED (SELECT i, j, w AS v FROM adj), rs AS MATERIALIZED (SELECT i, sum(v) AS t, max(v) AS m FROM s GROUP BY i)"""


def _sql(body: str, *more: str, recursive: str = "") -> str:
    return f"WITH {recursive} {', '.join((_GRAPH, *more))} {body}"


def _product(add: str) -> str:
    return _sql(f"SELECT a.i, round({add}, 6) + 0 AS v FROM lap a JOIN x ON x.i = a.j GROUP BY a.i")


_TV = [f"t0 AS MATERIALIZED (SELECT i, k, h - avg(h) OVER (PARTITION BY k) AS x FROM ({' UNION ALL '.join(f'SELECT i, {k} AS k, {_hash("i", k)} AS h FROM ids' for k in range(10))}))"]
_TV += [
    f"""t{n + 1} AS MATERIALIZED (SELECT a.i, t.k, (2e0/3e0) * (0 - sum(CASE WHEN a.v < 0 THEN a.v * t.x ELSE 0 END)) / max(CASE WHEN a.i = a.j THEN a.v END)
    + (1 - 2e0/3e0) * max(CASE WHEN a.i = a.j THEN t.x END) AS x FROM lap a JOIN t{n} t ON t.i = a.j GROUP BY a.i, t.k)"""
    for n in range(4)
]
_SCALED = ", f AS MATERIALIZED (SELECT * FROM (SELECT s.i, s.j, round(s.v / greatest(a.m, b.m), 9) AS v FROM s JOIN rs a ON a.i = s.i JOIN rs b ON b.i = s.j) WHERE v >= 1e-8), cs AS MATERIALIZED (SELECT j AS i, sum(v) AS s FROM f GROUP BY j), s0 AS MATERIALIZED (SELECT DISTINCT i, i AS ind, 'U' AS s, CAST(0 AS DOUBLE) AS votes FROM f)"
_TIED = _STRENGTH + _SCALED
#: Strengths by affinity in place of weights.
_AFFINE = """s AS MATERIALIZED (SELECT i, j, xy * xy / (xx * yy * (xx * yy)) AS v FROM (
    SELECT a.i, a.j, sum(p.x * q.x) AS xy, sum(p.x * p.x) AS xx, sum(q.x * q.x) AS yy FROM adj a JOIN t4 p ON p.i = a.i JOIN t4 q ON q.i = a.j AND q.k = p.k GROUP BY 1, 2)),
rs AS MATERIALIZED (SELECT i, max(v) AS m FROM s GROUP BY i)"""


def _round(r: int) -> str:
    th = 0.5 * 0.5**r
    return f"""v{r} AS MATERIALIZED (SELECT i, max_by({{'p': p, 'ind': ind, 'w': w, 'j': j}}, row(p, w, j)) AS b FROM (
    SELECT f.i, f.j, st.ind, f.v AS w, CASE WHEN st.s = 'S' AND f.v > {th} THEN 2 WHEN st.s = 'U' THEN 1 ELSE 0 END AS p FROM f JOIN s{r} st ON st.i = f.j) GROUP BY i),
g{r} AS MATERIALIZED (SELECT st.i, v.b.ind AS t, v.b.w AS w FROM s{r} st JOIN v{r} v ON v.i = st.i WHERE st.s = 'U' AND v.b.w >= {th} AND v.b.ind <> st.i),
n{r} AS MATERIALIZED (SELECT st.i, st.ind, st.s, st.votes + coalesce(n.w, 0) AS vt FROM s{r} st LEFT JOIN (SELECT t, sum(w) AS w FROM g{r} GROUP BY t) n ON n.t = st.i),
m{r} AS MATERIALIZED (SELECT a.i, a.t FROM g{r} a JOIN g{r} b ON b.i = a.t AND b.t = a.i WHERE {r} = 0),
s{r + 1} AS MATERIALIZED (SELECT st.i,
    CASE WHEN st.s <> 'U' THEN st.ind WHEN m.i IS NOT NULL THEN least(st.i, m.t) WHEN v.b.p = 2 THEN v.b.ind WHEN st.vt >= cs.s THEN st.i ELSE st.ind END AS ind,
    CASE WHEN st.s IN ('D', 'R') THEN st.s WHEN st.s = 'S' THEN CASE WHEN st.vt > -1 THEN 'R' ELSE 'S' END
        WHEN m.i IS NOT NULL THEN CASE WHEN st.i < m.t THEN 'S' ELSE 'D' END WHEN v.b.p = 2 THEN 'D' WHEN st.vt >= cs.s THEN 'S' ELSE st.s END AS s, st.vt AS votes
    FROM n{r} st LEFT JOIN v{r} v ON v.i = st.i LEFT JOIN cs ON cs.i = st.i LEFT JOIN m{r} m ON m.i = st.i)"""


_ROUNDS = [_round(r) for r in range(10)]
_USERS = """e1 AS (SELECT user_id AS a, lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS b FROM events),
e0 AS MATERIALIZED (SELECT least(a, b) AS i, greatest(a, b) AS j FROM e1 WHERE a <> b GROUP BY 1, 2),
tri AS MATERIALIZED (SELECT p.i AS a, p.j AS b, q.j AS c FROM e0 p JOIN e0 q ON q.i = p.j JOIN e0 r ON r.i = p.i AND r.j = q.j),
per AS MATERIALIZED (SELECT i, count(*) AS t FROM (SELECT a AS i FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri) GROUP BY i),
deg AS MATERIALIZED (SELECT i, count(*) AS d FROM (SELECT i FROM e0 UNION ALL SELECT j FROM e0) GROUP BY i)"""
#: Each order hangs on its customer, so a component's greatest id is that of its customer or of one of its orders.
_STARS = "lab AS MATERIALIZED (SELECT o_custkey AS c, greatest(o_custkey * 2, max(o_orderkey) * 2 + 1) AS label FROM orders GROUP BY o_custkey), l AS (SELECT c * 2 AS i, label FROM lab UNION ALL SELECT o_orderkey * 2 + 1, label FROM orders JOIN lab ON c = o_custkey)"


def _cg(iterations: int, diagonal: str = "v") -> list[str]:
    parts = [f"d AS (SELECT i, {diagonal} AS d FROM lap WHERE i = j)", "c0 AS MATERIALIZED (SELECT x.i, CAST(0 AS DOUBLE) AS x, x.v - (SELECT avg(v) FROM x) AS r, CAST(0 AS DOUBLE) AS p FROM x)"]
    for k in range(iterations):
        beta = "0" if k == 0 else f"(SELECT sum(r * z) FROM z{k}) / (SELECT sum(r * z) FROM z{k - 1})"
        parts += [
            f"z{k} AS MATERIALIZED (SELECT c.*, c.r / d.d AS z FROM c{k} c JOIN d ON d.i = c.i)",
            f"p{k} AS MATERIALIZED (SELECT i, x, r, z + {beta} * p AS p FROM z{k})",
            f"a{k} AS MATERIALIZED (SELECT a.i, sum(a.v * p.p) AS ap FROM lap a JOIN p{k} p ON p.i = a.j GROUP BY a.i)",
            f"al{k} AS MATERIALIZED (SELECT (SELECT sum(r * z) FROM z{k}) / (SELECT sum(p.p * a.ap) FROM p{k} p JOIN a{k} a ON a.i = p.i) AS al)",
            f"c{k + 1} AS MATERIALIZED (SELECT p.i, p.x + al * p.p AS x, p.r - al * a.ap AS r, p.p FROM p{k} p JOIN a{k} a ON a.i = p.i, al{k})",
        ]
    return parts


def _two_grid(lap: str, b: str, sweeps: int = 60) -> list[str]:
    """``tg`` (i, x): a Jacobi sweep on ``lap``, the exact answer on aggregates by i % 16, another sweep. The exact answer
    is that of many sweeps."""
    parts = [
        f"dt AS MATERIALIZED (SELECT i, v AS d FROM {lap} WHERE i = j)",
        f"x1 AS MATERIALIZED (SELECT b.i, (2e0/3e0) * b.v / d AS x, b.v AS b FROM {b} b JOIN dt ON dt.i = b.i)",
        f"r1 AS MATERIALIZED (SELECT a.i % 16 AS i, sum(r) AS r FROM (SELECT y.i, max(y.b) - sum(a.v * x1.x) AS r FROM {lap} a JOIN x1 ON x1.i = a.j JOIN x1 y ON y.i = a.i GROUP BY y.i) a GROUP BY 1)",
        f"lc AS MATERIALIZED (SELECT i % 16 AS i, j % 16 AS j, sum(v) AS v FROM {lap} GROUP BY 1, 2)",
        "dc AS MATERIALIZED (SELECT i, v AS d FROM lc WHERE i = j)",
        "w0 AS MATERIALIZED (SELECT i, CAST(0 AS DOUBLE) AS x FROM dc)",
    ]
    for k in range(sweeps):
        parts.append(f"w{k + 1} AS MATERIALIZED (SELECT w.i, max(w.x) + (2e0/3e0) * (max(r1.r) - sum(lc.v * u.x)) / max(dc.d) AS x FROM w{k} w JOIN lc ON lc.i = w.i JOIN w{k} u ON u.i = lc.j JOIN r1 ON r1.i = w.i JOIN dc ON dc.i = w.i GROUP BY w.i)")
    parts += [
        f"x2 AS MATERIALIZED (SELECT x1.i, x1.x + w.x - (SELECT avg(x) FROM w{sweeps}) AS x, x1.b FROM x1 JOIN w{sweeps} w ON w.i = x1.i % 16)",
        f"tg AS MATERIALIZED (SELECT y.i, (2e0/3e0) * (max(y.b) - sum(CASE WHEN a.v < 0 THEN a.v * x2.x ELSE 0 END)) / max(dt.d) + (1 - 2e0/3e0) * max(y.x) AS x FROM {lap} a JOIN x2 ON x2.i = a.j JOIN x2 y ON y.i = a.i JOIN dt ON dt.i = a.i GROUP BY y.i)",
    ]
    return parts


_PARTS = f"""e0 AS MATERIALIZED ({_edges("lineitem", "l_partkey", "l_suppkey")}), {_BOTH}, ids AS MATERIALIZED (SELECT DISTINCT i FROM adj),
lap AS MATERIALIZED (SELECT i, j, -w AS v FROM adj UNION ALL SELECT i, i, sum(w) AS v FROM adj GROUP BY i)"""
_JACOBI = ["j0 AS MATERIALIZED (SELECT x.i, x.v AS x, y.v AS b FROM x JOIN y ON y.i = x.i)"] + [
    f"""j{k + 1} AS MATERIALIZED (SELECT a.i, (2e0/3e0) * (max(CASE WHEN a.i = a.j THEN j.b END) - sum(CASE WHEN a.v < 0 THEN a.v * j.x ELSE 0 END)) / max(CASE WHEN a.i = a.j THEN a.v END)
    + (1 - 2e0/3e0) * max(CASE WHEN a.i = a.j THEN j.x END) AS x, max(CASE WHEN a.i = a.j THEN j.b END) AS b FROM lap a JOIN j{k} j ON j.i = a.j GROUP BY a.i)"""
    for k in range(4)
]
_POWER = ["dg AS MATERIALIZED (SELECT i, v AS d FROM lap WHERE i = j)", f"h0 AS MATERIALIZED (SELECT i, {_hash('i', 3)} - 0.5e0 AS x FROM ids)"] + [
    f"h{k + 1} AS MATERIALIZED (SELECT a.i, sum(a.v * h.x) / max(dg.d) AS x FROM lap a JOIN h{k} h ON h.i = a.j JOIN dg ON dg.i = a.i GROUP BY a.i)" for k in range(8)
]
_BASIS = """basis AS MATERIALIZED (SELECT i, agg, k, CASE WHEN m = k + 1 THEN -k ELSE 1 END / sqrt(CAST(k * (k + 1) AS DOUBLE)) AS v FROM (
    SELECT i, agg, m, unnest(range(greatest(m - 1, 1), n)) AS k FROM (SELECT i, agg, row_number() OVER (PARTITION BY agg ORDER BY i) AS m, count(*) OVER (PARTITION BY agg) AS n FROM blk)))"""
_COMPLEMENT = ["dg AS MATERIALIZED (SELECT i, v AS d FROM lap WHERE i = j)", f"q0 AS MATERIALIZED (SELECT DISTINCT agg, k, {_hash('(agg + 31 * k)', 2)} - 0.5e0 AS x FROM basis)"] + [
    f"""q{k + 1} AS MATERIALIZED (SELECT b.agg, b.k, sum(b.v * y.y) AS x FROM basis b JOIN (SELECT a.i, sum(a.v * f.v) / max(dg.d) AS y FROM lap a
    JOIN (SELECT b.i, sum(b.v * q.x) AS v FROM basis b JOIN q{k} q ON q.agg = b.agg AND q.k = b.k GROUP BY b.i) f ON f.i = a.j JOIN dg ON dg.i = a.i GROUP BY a.i) y ON y.i = b.i GROUP BY 1, 2)"""
    for k in range(4)
]
_BAD = """pm AS MATERIALIZED (SELECT x.i, agg, v - avg(v) OVER (PARTITION BY agg) AS v FROM x JOIN blk ON blk.i = x.i),
bad AS MATERIALIZED (SELECT agg FROM pm GROUP BY agg HAVING count(*) > 1 AND greatest(avg(v * v), max(abs(v))) > 0.4)"""
#: A second elimination, on what the first one leaves.
_ELIM2 = """lap2 AS MATERIALIZED (SELECT p.c AS i, q.c AS j, sum(p.v * a.v * q.v) AS v FROM p JOIN lap a ON a.i = p.i JOIN p q ON q.i = a.j GROUP BY 1, 2),
cand2 AS (SELECT i FROM lap2 WHERE v <> 0 GROUP BY i HAVING count(*) - 1 <= 4),
elim2 AS MATERIALIZED (SELECT a.i FROM lap2 a JOIN cand2 p ON a.i = p.i JOIN cand2 q ON a.j = q.i WHERE a.v <> 0 GROUP BY a.i HAVING min(a.j) = a.i),
dg2 AS MATERIALIZED (SELECT i, v AS d FROM lap2 WHERE i = j),
p2 AS MATERIALIZED (SELECT i, i AS c, CAST(1 AS DOUBLE) AS v FROM dg2 WHERE i NOT IN (SELECT i FROM elim2) UNION ALL
    SELECT a.i, a.j, -a.v / dg2.d FROM lap2 a JOIN elim2 e ON e.i = a.i JOIN dg2 ON dg2.i = a.i WHERE a.i <> a.j)"""
_RESTRICTION = "rr AS MATERIALIZED (SELECT a.i, coalesce(r.ind, a.ind) AS agg FROM s10 a LEFT JOIN s10 r ON r.i = a.ind)"


def _fixed(i: str) -> str:
    return f"(({i} * 37 % 1000) / 1000e0)"


_HUBS = f"""e0 AS MATERIALIZED (SELECT i, j, CAST(count(*) AS DOUBLE) AS w FROM (SELECT l_orderkey * 2 AS i, l_partkey * 2 + 1 AS j FROM lineitem UNION ALL SELECT o_orderkey * 2, -ascii(o_orderstatus) FROM orders) GROUP BY 1, 2), {_BOTH},
ids AS MATERIALIZED (SELECT DISTINCT i FROM adj), lap AS MATERIALIZED (SELECT i, j, -w AS v FROM adj UNION ALL SELECT i, i, sum(w) AS v FROM adj GROUP BY i),
t0 AS MATERIALIZED (SELECT i, k, h - avg(h) OVER (PARTITION BY k) AS x FROM ({' UNION ALL '.join(f'SELECT i, {k} AS k, {_hash("i", k)} AS h FROM ids' for k in range(4))}))"""
#: Test vectors after two sweeps, aggregates' means taken out after each.
_CR = [f"p0 AS MATERIALIZED (SELECT i, k, h - avg(h) OVER (PARTITION BY k) AS x FROM ({' UNION ALL '.join(f'SELECT i, {k} AS k, {_hash("i", k)} AS h FROM ids' for k in range(4))}))"] + [
    f"""p{n + 1} AS MATERIALIZED (SELECT s.i, s.k, s.x - avg(s.x) OVER (PARTITION BY s.k, b.agg) AS x FROM (SELECT a.i, t.k, (2e0/3e0) * (0 - sum(CASE WHEN a.v < 0 THEN a.v * t.x ELSE 0 END)) / max(CASE WHEN a.i = a.j THEN a.v END)
    + (1 - 2e0/3e0) * max(CASE WHEN a.i = a.j THEN t.x END) AS x FROM lap a JOIN p{n} t ON t.i = a.j GROUP BY a.i, t.k) s JOIN blk b ON b.i = s.i)"""
    for n in range(2)
]


_SIGMA = "CAST(1.4 AS DOUBLE) / 0.8"  # bounds of 0.6 and 2.2
ORACLES: dict[str, str] = {
    "scan_edges": _sql("SELECT i, j, w AS v FROM adj"),
    "pattern_apply": _sql("SELECT i, j, CAST(v <> 0 AS DOUBLE) AS v FROM lap"),
    "transpose": "SELECT l_suppkey AS i, l_orderkey AS j, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2",
    "diagonal": _sql("SELECT i, v FROM lap WHERE i = j"),
    "identity_spmv": _sql("SELECT i, round(v, 6) AS v FROM x"),
    "axpy": _sql("SELECT x.i, round(2.5e0 * x.v + y.v, 6) AS v FROM x JOIN y ON y.i = x.i"),
    "row_reduce": _sql("SELECT i, sum(w) AS total, max(w) AS most FROM adj GROUP BY i"),
    "col_reduce": _sql("SELECT j AS i, max(w) AS v FROM adj GROUP BY j"),
    "dot": _sql("SELECT round(sum(x.v * y.v), 6) AS v FROM x JOIN y ON y.i = x.i"),
    "orthogonalize": _sql("SELECT i, round(v - (SELECT avg(v) FROM x), 6) + 0 AS v FROM x"),
    "ewise_add": _sql("SELECT i, j, sum(v) AS v FROM (SELECT * FROM lap UNION ALL SELECT i, j, w FROM adj) GROUP BY i, j"),
    "permute": _sql("SELECT (i * 7 + 3) % 1000003 AS i, (j * 7 + 3) % 1000003 AS j, w AS v FROM adj"),
    "renumber": _sql("SELECT i, row_number() OVER (ORDER BY i) - 1 AS new FROM ids"),
    "remove_zero_rows": """WITH a AS (SELECT l_partkey AS i, l_suppkey AS j, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2),
        k AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS new FROM a GROUP BY i HAVING sum(v) <> 0) SELECT new AS i, j, v FROM a JOIN k ON k.i = a.i""",
    "spmv_plus_times": _product("sum(a.v * x.v)"),
    "spmv_offdiag": _product("sum(CASE WHEN a.v < 0 THEN a.v * x.v ELSE 0 END)"),
    "spmv_diag": _product("sum(CASE WHEN a.v > 0 THEN a.v * x.v ELSE 0 END)"),
    "spmv_inv_diag": _product("sum(CASE WHEN a.v > 0 THEN x.v / a.v ELSE 0 END)"),
    "spmv_max": _product("max(x.v)"),
    "spmv_min_index": _sql("SELECT i, min(j) AS v FROM lap WHERE v <> 0 GROUP BY i"),
    "spmv_collect": _sql("SELECT i, string_agg(CAST(j AS VARCHAR), ',' ORDER BY j) AS v FROM adj GROUP BY i"),
    "spgemm": f"WITH e0 AS ({_edges('nation', 'n_nationkey', 'n_regionkey')}), {_BOTH} SELECT a.i, b.j, sum(a.w * b.w) AS v FROM adj a JOIN adj b ON b.i = a.j GROUP BY 1, 2",
    "spgemm_customer_order": f"WITH e0 AS ({_edges('orders', 'o_custkey', 'o_orderkey')}), {_BOTH} SELECT a.i, b.j, sum(a.w * b.w) AS v FROM adj a JOIN adj b ON b.i = a.j GROUP BY 1, 2",
    "residual": _sql("SELECT y.i, round(y.v - sum(a.v * x.v), 6) + 0 AS v FROM lap a JOIN x ON x.i = a.j JOIN y ON y.i = a.i GROUP BY y.i, y.v"),
    "residual_norm": _sql("SELECT round(sqrt(sum(r * r)), 6) AS v FROM (SELECT y.v - sum(a.v * x.v) AS r FROM lap a JOIN x ON x.i = a.j JOIN y ON y.i = a.i GROUP BY y.i, y.v)"),
    "laplacian": _sql("SELECT i, j, v FROM lap"),
    "degrees": _sql("SELECT i, count(*) AS v FROM adj GROUP BY i"),
    "weighted_degree": _sql("SELECT i, sum(w) AS v FROM adj GROUP BY i"),
    "symmetrize": """WITH a AS (SELECT l_suppkey AS i, l_linenumber AS j, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2)
        SELECT i, j, sum(v) / 2 AS v FROM (SELECT i, j, v FROM a UNION ALL SELECT j, i, v FROM a) GROUP BY 1, 2""",
    "cooccurrence": """WITH a AS (SELECT l_suppkey AS i, l_partkey AS j, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2)
        SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM a JOIN a b ON b.j = a.j AND a.i <> b.i GROUP BY 1, 2""",
    "cooccurrence_all": """WITH a AS (SELECT l_suppkey AS i, l_partkey AS j, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2)
        SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM a JOIN a b ON b.j = a.j AND a.i <> b.i GROUP BY 1, 2""",
    "connected_components": f"WITH {_STARS} SELECT i, label FROM l",
    "component_sizes": f"WITH {_STARS} SELECT label, count(*) AS size FROM l GROUP BY label",
    "largest_cc": f"""WITH e0 AS ({_edges("nation", "n_nationkey", "n_regionkey")}), {_BOTH}, lab AS (SELECT j, greatest(j, max(i)) AS label, count(*) AS n FROM e0 GROUP BY j),
        top AS (SELECT j FROM lab ORDER BY n DESC, label LIMIT 1), m AS (SELECT i FROM e0 WHERE j IN (FROM top) UNION SELECT j FROM top), k AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS new FROM m)
        SELECT a.new AS i, b.new AS j, w FROM adj JOIN k a ON a.i = adj.i JOIN k b ON b.i = adj.j""",
    "triangles": f"WITH {_USERS} SELECT i, t AS triangles FROM per",
    "clustering": f"""WITH {_USERS} SELECT CAST(sum(coalesce(t, 0)) / 3 AS BIGINT) AS triangles, round(coalesce(sum(coalesce(t, 0)) / nullif(sum(d * (d - 1) / 2), 0), 0), 6) AS global_clustering,
        round(avg(coalesce(coalesce(t, 0) / nullif(d * (d - 1) / 2, 0), 0)), 6) AS average_local FROM deg LEFT JOIN per ON per.i = deg.i""",
    "block_nnz": _sql("SELECT least(i // 1875, 15) AS bi, least(j // 1875, 15) AS bj, count(*) AS nnz, count(DISTINCT i) AS rows FROM adj GROUP BY 1, 2"),
    "catalog_select": "SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#11', 'Brand#22', 'Brand#33', 'Brand#44')",
    "colormap_bins": _sql("SELECT i, CAST(floor(1 + (w - min(w) OVER ()) / (max(w) OVER () - min(w) OVER ()) * 9) AS BIGINT) AS bin FROM (SELECT i, sum(w) AS w FROM adj GROUP BY i)"),
    "elim_candidates": _sql("SELECT i FROM cand", _ELIM),
    "elim_select": _sql("SELECT i FROM elim", _ELIM),
    "elim_idmap": _sql("SELECT i, row_number() OVER (ORDER BY i) - 1 AS new FROM kept UNION ALL SELECT i, -1 FROM elim", _ELIM),
    "elim_P": _sql("SELECT i, c AS j, round(v, 6) AS v FROM p", _ELIM),
    "elim_Q": _sql("SELECT i, i AS j, round(1 / d, 6) AS v FROM dg WHERE i IN (SELECT i FROM elim)", _ELIM),
    "galerkin_elim": _sql("SELECT p.c AS i, q.c AS j, round(sum(p.v * a.v * q.v), 6) + 0 AS v FROM p JOIN lap a ON a.i = p.i JOIN p q ON q.i = a.j GROUP BY 1, 2", _ELIM),
    "elim_solve": _sql("SELECT i, round(sum(v), 6) + 0 AS v FROM (SELECT p.i, p.v * y.v AS v FROM p JOIN y ON y.i = p.c UNION ALL SELECT e.i, x.v / dg.d FROM elim e JOIN dg ON dg.i = e.i JOIN x ON x.i = e.i) GROUP BY i", _ELIM),
    "tv_init": _sql("SELECT i, k, round(x, 6) + 0 AS v FROM t0", _TV[0]),
    "tv_smooth": _sql("SELECT i, k, round(x, 6) + 0 AS v FROM t4", *_TV),
    "affinity_raw": _sql("""SELECT i, j, round(log10(1 + xy * xy / (xx * yy * (xx * yy))), 6) AS v FROM (
        SELECT a.i, a.j, sum(p.x * q.x) AS xy, sum(p.x * p.x) AS xx, sum(q.x * q.x) AS yy FROM adj a JOIN t4 p ON p.i = a.i JOIN t4 q ON q.i = a.j AND q.k = p.k GROUP BY 1, 2)""", *_TV),
    "affinity_algdist": _sql("SELECT i, j, round(log10(1 + 1 / m), 6) AS v FROM (SELECT a.i, a.j, max(abs(p.x - q.x)) AS m FROM adj a JOIN t4 p ON p.i = a.i JOIN t4 q ON q.i = a.j AND q.k = p.k GROUP BY 1, 2)", *_TV),
    "affinity_none": _sql("SELECT i, j, v FROM s", _STRENGTH),
    "affinity_row": _sql("SELECT s.i, s.j, round(v / a.t, 9) AS v FROM s JOIN rs a ON a.i = s.i", _STRENGTH),
    "affinity_col": _sql("SELECT s.i, s.j, round(v / a.t, 9) AS v FROM s JOIN rs a ON a.i = s.j", _STRENGTH),
    "affinity_rowcol": _sql("SELECT r.i, r.j, round(r.v / c.t, 9) AS v FROM r JOIN (SELECT j, sum(v) AS t FROM r GROUP BY j) c ON c.j = r.j", _STRENGTH, "r AS MATERIALIZED (SELECT s.i, s.j, v / a.t AS v FROM s JOIN rs a ON a.i = s.i)"),
    "affinity_sym": _sql("SELECT s.i, s.j, round((v / a.t + v / b.t) / 2, 9) AS v FROM s JOIN rs a ON a.i = s.i JOIN rs b ON b.i = s.j", _STRENGTH),
    "affinity_max": _sql("SELECT s.i, s.j, round(v / greatest(a.m, b.m), 9) AS v FROM s JOIN rs a ON a.i = s.i JOIN rs b ON b.i = s.j", _STRENGTH),
    "affinity_prune": _sql("SELECT * FROM (SELECT s.i, s.j, round(v / greatest(a.m, b.m), 9) AS v FROM s JOIN rs a ON a.i = s.i JOIN rs b ON b.i = s.j) WHERE v >= 0.3", _STRENGTH),
    "agg_vote": _sql("SELECT i, b.p AS prio, b.w AS weight, b.j AS j, b.ind AS ind FROM v0", _TIED, _ROUNDS[0]),
    "agg_round1": _sql("SELECT i, ind, s AS state, round(votes, 6) AS votes FROM s1", _TIED, _ROUNDS[0]),
    "agg_assign": _sql("SELECT i, ind, s AS state FROM s10", _TIED, *_ROUNDS),
    "agg_state_counts": _sql("SELECT s AS state, count(*) AS n FROM s10 GROUP BY s", _TIED, *_ROUNDS),
    "agg_sizes": _sql("SELECT ind, count(*) AS size FROM s10 GROUP BY ind", _TIED, *_ROUNDS),
    "conductance": f"""WITH e0 AS ({_edges("lineitem", "l_partkey", "l_suppkey")}), {_BOTH}
        SELECT i, sum(CASE WHEN i % 16 <> j % 16 THEN w ELSE 0 END) AS external, sum(CASE WHEN i % 16 = j % 16 THEN w ELSE 0 END) AS internal,
        round(sum(CASE WHEN i % 16 <> j % 16 THEN w ELSE 0 END) / nullif(sum(CASE WHEN i % 16 = j % 16 THEN w ELSE 0 END), 0), 6) AS ratio FROM adj GROUP BY i""",
    "galerkin_agg": _sql("SELECT i // 8 AS i, j // 8 AS j, sum(v) AS v FROM lap GROUP BY 1, 2"),
    "agg_renumber": _sql("SELECT i, dense_rank() OVER (ORDER BY agg) - 1 AS agg FROM blk", _BLOCKS),
    "jacobi_sweep": _sql("""SELECT a.i, round((2e0/3e0) * (max(CASE WHEN a.i = a.j THEN y.v END) - sum(CASE WHEN a.v < 0 THEN a.v * x.v ELSE 0 END)) / max(CASE WHEN a.i = a.j THEN a.v END)
        + (1 - 2e0/3e0) * max(CASE WHEN a.i = a.j THEN x.v END), 6) + 0 AS v FROM lap a JOIN x ON x.i = a.j JOIN y ON y.i = a.j GROUP BY a.i"""),
    "chebyshev_2": _sql(f"""SELECT a.i, round(max(CASE WHEN a.i = a.j THEN c.x END) + k.an * k.rho * max(CASE WHEN a.i = a.j THEN c.x END)
        + 2 * k.an / 0.8e0 * (max(CASE WHEN a.i = a.j THEN c.b END) - sum(a.v * c.x)) / max(CASE WHEN a.i = a.j THEN a.v END), 6) + 0 AS v FROM lap a JOIN c ON c.i = a.j, k GROUP BY a.i, k.an, k.rho""",
        "c AS MATERIALIZED (SELECT y.i, y.v AS b, y.v / lap.v / 1.4e0 AS x FROM y JOIN lap ON lap.i = y.i AND lap.j = y.i)", f"k AS (SELECT 1 / ({_SIGMA}) AS rho, 1 / (2 * ({_SIGMA}) - 1 / ({_SIGMA})) AS an)"),
    "restrict": _sql("SELECT agg AS i, round(sum(v), 6) AS v FROM x JOIN blk ON blk.i = x.i GROUP BY agg", _BLOCKS),
    "prolong": _sql(f"SELECT i, round({_hash('agg', 0)}, 6) AS v FROM blk", _BLOCKS),
    "project_mean": _sql("SELECT x.i, round(v - avg(v) OVER (PARTITION BY agg), 6) + 0 AS v FROM x JOIN blk ON blk.i = x.i", _BLOCKS),
    "cr_bad_aggregates": _sql("""SELECT agg, round(avg(v * v), 6) AS norm2, round(max(abs(v)), 6) AS norm_inf, count(*) AS size FROM (SELECT agg, v - avg(v) OVER (PARTITION BY agg) AS v FROM x JOIN blk ON blk.i = x.i)
        GROUP BY agg HAVING count(*) > 1 AND greatest(avg(v * v), max(abs(v))) > 0.4""", _BLOCKS),
    "pcg_jacobi_k": _sql("SELECT i, round(x, 5) + 0 AS v FROM c3", *_cg(3)),
    "spmv_hub": f"WITH {_HUBS}, x AS (SELECT i, {_hash('i', 0)} AS v FROM ids) SELECT a.i, round(sum(a.v * x.v), 6) + 0 AS v FROM lap a JOIN x ON x.i = a.j GROUP BY a.i",
    "smooth_hub": f"WITH {_HUBS}, {_TV[1]}, {_TV[2]} SELECT i, k, round(x, 6) + 0 AS v FROM t2",
    "affinity_hub": f"""WITH {_HUBS} SELECT i, j, round(log10(1 + xy * xy / (xx * yy * (xx * yy))), 6) AS v FROM (
        SELECT a.i, a.j, sum(p.x * q.x) AS xy, sum(p.x * p.x) AS xx, sum(q.x * q.x) AS yy FROM adj a JOIN t0 p ON p.i = a.i JOIN t0 q ON q.i = a.j AND q.k = p.k GROUP BY 1, 2)""",
    "cooccurrence_hub": """WITH a AS (SELECT i, j, CAST(count(*) AS DOUBLE) AS v FROM (SELECT l_suppkey AS i, l_partkey AS j FROM lineitem UNION ALL SELECT s_suppkey, 0 FROM supplier) GROUP BY 1, 2)
        SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM a JOIN a b ON b.j = a.j AND a.i <> b.i GROUP BY 1, 2""",
    "cg_coefficients": _sql(" UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS step, round((SELECT al FROM al{k}), 6) AS alpha, round({'0e0' if k == 0 else f'(SELECT sum(r * z) FROM z{k}) / (SELECT sum(r * z) FROM z{k - 1})'}, 6) AS beta" for k in range(3)), *_cg(3)),
    "fcg_k": _sql("SELECT i, round(x, 5) + 0 AS v FROM c3", *_cg(3)),
    "pipecg_k": _sql("SELECT i, round(x, 5) + 0 AS v FROM c3", *_cg(3)),
    "smallest_eigenpairs": "SELECT CAST(k AS INTEGER) AS k, 0e0 AS away, 1e0 AS length FROM range(3) r(k)",
    "largest_eigenpairs": "SELECT CAST(k AS INTEGER) AS k, 0e0 AS away, 1e0 AS length FROM range(2) r(k)",
    "smoothing_eigenpair": "SELECT 0e0 AS away, 1e0 AS length",
    "colours": "SELECT CAST(0 AS BIGINT) AS alike, CAST(2 AS BIGINT) AS colours",
    "cr_smooth": _sql("SELECT i, k, round(x, 6) + 0 AS v FROM p2", _BLOCKS, *_CR),
    "cr_bad": _sql("""SELECT agg, round(sum(s), 6) AS two, round(sum(m), 6) AS inf, count(*) AS size FROM (SELECT i, sum(x * x) / 4 AS s, max(abs(x)) AS m FROM p2 GROUP BY i) t JOIN blk ON blk.i = t.i
        GROUP BY agg HAVING count(*) > 1 AND greatest(sum(s), sum(m)) > 0.35""", _BLOCKS, *_CR),
    "solve": f"WITH {_PARTS} SELECT i, round({_fixed('i')} - (SELECT {_fixed('min(i)')} FROM ids), 3) + 0 AS v FROM ids",
    "coarse_solve": f"WITH c AS (SELECT DISTINCT i % 16 AS i FROM (SELECT l_partkey * 2 AS i FROM lineitem UNION SELECT l_suppkey * 2 + 1 FROM lineitem)) SELECT i, round({_fixed('i')} - (SELECT {_fixed('min(i)')} FROM c), 3) + 0 AS v FROM c",
    "two_grid": f"WITH {_PARTS}, b0 AS (SELECT i, {_hash('i', 1)} AS v FROM ids), b AS MATERIALIZED (SELECT i, v - (SELECT avg(v) FROM b0) AS v FROM b0), {', '.join(_two_grid('lap', 'b'))} SELECT i, round(x, 6) + 0 AS v FROM tg",
    "vcycle_1": _sql("""SELECT i, round(sum(v), 6) + 0 AS v FROM (SELECT p.i, p.v * tg.x AS v FROM p JOIN tg ON tg.i = p.c UNION ALL SELECT e.i, b.v / dg.d FROM elim e JOIN dg ON dg.i = e.i JOIN b ON b.i = e.i) GROUP BY i""",
        _ELIM, "b AS MATERIALIZED (SELECT i, v - (SELECT avg(v) FROM y) AS v FROM y)", "lap2 AS MATERIALIZED (SELECT p.c AS i, q.c AS j, sum(p.v * a.v * q.v) AS v FROM p JOIN lap a ON a.i = p.i JOIN p q ON q.i = a.j GROUP BY 1, 2)",
        "b2 AS MATERIALIZED (SELECT p.c AS i, sum(p.v * b.v) AS v FROM p JOIN b ON b.i = p.i GROUP BY 1)", *_two_grid("lap2", "b2")),
    "hierarchy_report": _sql("""SELECT CAST(0 AS INTEGER) AS level, 'agg' AS kind, (SELECT count(*) FROM ids) AS size, (SELECT count(*) FROM lap) AS nnz UNION ALL
        SELECT 1, 'coarse', (SELECT count(DISTINCT agg) FROM rr), (SELECT count(*) FROM (SELECT DISTINCT a.agg, b.agg AS o FROM lap JOIN rr a ON a.i = lap.i JOIN rr b ON b.i = lap.j))""", _TIED, *_ROUNDS, _RESTRICTION),
    "restriction": _sql("SELECT i, agg FROM rr", _TIED, *_ROUNDS, _RESTRICTION),
    "agg_affinity": _sql("SELECT i, agg FROM rr", *_TV, _AFFINE + _SCALED, *_ROUNDS, _RESTRICTION),
    "affinity_scaled": _sql("SELECT s.i, s.j, round(v / greatest(a.m, b.m), 6) AS v FROM s JOIN rs a ON a.i = s.i JOIN rs b ON b.i = s.j", *_TV, _AFFINE),
    "agg_tally": _sql("SELECT i, round(vt, 6) AS votes FROM n0", _TIED, _ROUNDS[0]),
    "agg_reject_size": _sql("""SELECT a.i, CASE WHEN m.place > 4 THEN a.i ELSE a.ind END AS ind, CASE WHEN m.place > 4 THEN 'U' WHEN z.ind IS NOT NULL THEN 'R' ELSE a.s END AS state
        FROM s3 a LEFT JOIN m ON m.i = a.i LEFT JOIN z ON z.ind = a.i""", _TIED, *_ROUNDS[:3], "z AS (SELECT ind FROM s3 WHERE ind <> i GROUP BY ind HAVING count(*) > 4)",
        "m AS (SELECT s3.i, row_number() OVER (PARTITION BY s3.ind ORDER BY coalesce(f.v, 0) DESC, s3.i) AS place FROM s3 JOIN z ON z.ind = s3.ind LEFT JOIN f ON f.i = s3.i AND f.j = s3.ind WHERE s3.ind <> s3.i)"),
    "agg_reject_loose": _sql("""SELECT a.i, CASE WHEN a.s = 'D' AND coalesce(e.loose, false) THEN a.i ELSE a.ind END AS ind, CASE WHEN a.s = 'D' AND coalesce(e.loose, false) THEN 'U' ELSE a.s END AS state FROM s3 a LEFT JOIN e ON e.i = a.i""",
        _TIED, *_ROUNDS[:3], """e AS (SELECT i, CASE WHEN n > 0 THEN x / n > 2 ELSE x > 0 END AS loose FROM (SELECT adj.i, sum(CASE WHEN a.ind <> b.ind THEN w ELSE 0 END) AS x, sum(CASE WHEN a.ind = b.ind THEN w ELSE 0 END) AS n
        FROM adj JOIN s3 a ON a.i = adj.i JOIN s3 b ON b.i = adj.j GROUP BY adj.i))"""),
    "elim_compose": _sql("SELECT p.i, p2.c AS j, round(sum(p.v * p2.v), 6) + 0 AS v FROM p JOIN p2 ON p2.i = p.c GROUP BY 1, 2", _ELIM, _ELIM2),
    "jacobi_4": _sql("SELECT i, round(x, 6) + 0 AS v FROM j4", *_JACOBI),
    "lambda_max_power": _sql("SELECT round((SELECT sqrt(sum(x * x)) FROM h8) / (SELECT sqrt(sum(x * x)) FROM h7), 6) AS v", *_POWER),
    "cg_k": _sql("SELECT i, round(x, 5) + 0 AS v FROM c3", *_cg(3, "1")),
    "smoothing_power": _sql("SELECT round((SELECT sqrt(sum(x * x)) FROM q4) / (SELECT sqrt(sum(x * x)) FROM q3), 6) AS v", _BLOCKS, _BASIS, *_COMPLEMENT),
    "p_to_s": _sql("""SELECT i, agg, CAST(k AS INTEGER) AS k, round(CASE WHEN m = k + 1 THEN -k ELSE 1 END / sqrt(CAST(k * (k + 1) AS DOUBLE)), 6) AS v FROM (
        SELECT i, agg, m, unnest(range(greatest(m - 1, 1), n)) AS k FROM (SELECT i, agg, row_number() OVER (PARTITION BY agg ORDER BY i) AS m, count(*) OVER (PARTITION BY agg) AS n FROM blk))""", _BLOCKS),
    "cr_split": _sql("""SELECT pm.i, CASE WHEN bad.agg IS NOT NULL AND v < 0 THEN min(CASE WHEN v < 0 THEN pm.i END) OVER (PARTITION BY pm.agg) ELSE pm.agg END AS agg FROM pm LEFT JOIN bad ON bad.agg = pm.agg""", _BLOCKS, _BAD),
    "cr_roots": _sql("SELECT pm.agg, arg_min(i, row(v, i)) AS least, arg_min(i, row(-v, i)) AS most FROM pm JOIN bad ON bad.agg = pm.agg GROUP BY pm.agg", _BLOCKS, _BAD),
    "cr_voted_roots": _sql("""SELECT pm.agg, arg_min(i, row(-round(abs(v), 3), i)) FILTER (v < 0) AS low, arg_min(i, row(-round(abs(v), 3), i)) FILTER (v >= 0) AS high FROM pm JOIN bad ON bad.agg = pm.agg GROUP BY pm.agg""", _BLOCKS, _BAD),
    "cr_votes": f"""WITH {_PARTS}, x AS MATERIALIZED (SELECT i, {_hash("i", 0)} - 0.5e0 AS v FROM ids) SELECT a.i, round(sum(CASE WHEN a.i % 16 = a.j % 16 AND sign(x.v) = sign(u.v) THEN w / (abs(x.v - u.v) + 1e-4) ELSE 0 END), 6) AS votes
        FROM adj a JOIN x ON x.i = a.i JOIN x u ON u.i = a.j GROUP BY a.i""",
    "fiedler": f"WITH {_STARS} SELECT CAST(1 AS DOUBLE) AS smallest, CAST(0 AS DOUBLE) AS away, CAST(max(n) AS DOUBLE) AS largest FROM (SELECT count(*) AS n FROM l GROUP BY label)",
    "largest_cc_customer_order": f"""WITH e0 AS ({_edges("orders", "o_custkey", "o_orderkey")}), {_BOTH}, {_STARS}, n AS (SELECT label FROM l GROUP BY label ORDER BY count(*) DESC, label LIMIT 1),
        k AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS new FROM l WHERE label IN (FROM n)) SELECT a.new AS i, b.new AS j, w FROM adj JOIN k a ON a.i = adj.i JOIN k b ON b.i = adj.j""",
}
