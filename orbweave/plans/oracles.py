"""Longer SQL of the queries' oracles: shortest paths, chance-adjusted information, hexagons by nearest centre."""

from __future__ import annotations


def betweenness(length: str, edges: str, nodes: str, steps: int = 24) -> str:
    """Common table expressions up to ``eb`` (orig, dest, edge_betweenness): shortest paths over ``edges``, each ``length`` long, between all ``nodes`` (cell).

    Distances relax ``steps`` times, as often as a path has hops; the other two recursions walk the arcs that lie on shortest paths.
    """
    return f"""e AS MATERIALIZED ({edges}), node AS MATERIALIZED ({nodes}),
        arc AS MATERIALIZED (SELECT orig AS v, dest AS w, CAST({length} AS DOUBLE) AS len FROM e WHERE orig <> dest),
        hop AS MATERIALIZED (SELECT * FROM arc UNION ALL SELECT cell, cell, CAST(0 AS DOUBLE) FROM node),
        far(step, s, v, d) AS (SELECT 0, cell, cell, CAST(0 AS DOUBLE) FROM node UNION ALL SELECT step + 1, s, hop.w, min(d + len) FROM far JOIN hop USING (v) WHERE step < {steps} GROUP BY step, s, hop.w),
        dist AS MATERIALIZED (SELECT s, v, d FROM far WHERE step = {steps}),
        dag AS MATERIALIZED (SELECT a.s, arc.v, arc.w FROM arc JOIN dist a ON a.v = arc.v JOIN dist b ON b.s = a.s AND b.v = arc.w WHERE a.d + len = b.d),
        walk(step, s, v, c) AS (SELECT 0, cell, cell, CAST(1 AS DOUBLE) FROM node UNION ALL SELECT step + 1, s, dag.w, sum(c) FROM walk JOIN dag USING (s, v) GROUP BY step, s, dag.w),
        sigma AS MATERIALIZED (SELECT s, v, sum(c) AS c FROM walk GROUP BY 1, 2),
        back(step, s, v, t, c) AS (SELECT 0, s, v, v, CAST(1 AS DOUBLE) FROM dist UNION ALL SELECT step + 1, dag.s, dag.v, t, sum(c) FROM back JOIN dag ON dag.s = back.s AND dag.w = back.v GROUP BY step, dag.s, dag.v, t),
        rest AS MATERIALIZED (SELECT s, v, t, sum(c) AS c FROM back GROUP BY 1, 2, 3),
        b AS (SELECT dag.v, dag.w, sum(x.c * rest.c / y.c) AS b FROM dag JOIN sigma x ON x.s = dag.s AND x.v = dag.v JOIN rest ON rest.s = dag.s AND rest.v = dag.w JOIN sigma y ON y.s = dag.s AND y.v = rest.t GROUP BY 1, 2),
        eb AS (SELECT o.orig, o.dest, round(coalesce(b, 0) / (n * (n - 1)), 6) AS edge_betweenness FROM (SELECT DISTINCT orig, dest FROM e) o LEFT JOIN b ON b.v = o.orig AND b.w = o.dest CROSS JOIN (SELECT count(*) AS n FROM node))"""


_NET0 = ("SELECT * FROM fx_edges WHERE net = 0", "SELECT cell FROM fx_cells")
EDGE_BETWEENNESS = f"WITH RECURSIVE {betweenness('1 / weight', *_NET0)} SELECT * FROM eb"
HOP_BETWEENNESS = f"WITH RECURSIVE {betweenness('1', *_NET0)} SELECT * FROM eb"

#: fx_trade leads from customers over orders and parts to suppliers; a path has three hops at most
LARGE_BETWEENNESS = f"WITH RECURSIVE {betweenness('1 / weight', 'SELECT * FROM fx_trade', 'SELECT orig AS cell FROM fx_trade UNION SELECT dest FROM fx_trade', 3)} SELECT e.orig, e.dest, round(coalesce(b, 0), 6) AS edge_betweenness FROM e LEFT JOIN b ON b.v = e.orig AND b.w = e.dest"

_HIGHWAYS = "SELECT orig, dest, CAST(count(*) AS DOUBLE) AS weight FROM fx_pairs WHERE orig <> dest GROUP BY 1, 2 HAVING count(*) >= 8"
_SIX = ", ".join(f"quantile_cont(dest_ivt - orig_ivt, {q}) AS q{i}" for i, q in enumerate((0.1, 0.25, 0.4, 0.6, 0.75, 0.9)))
HIGHWAYS = f"""WITH RECURSIVE {betweenness('1 / weight', _HIGHWAYS, 'SELECT orig AS cell FROM e UNION SELECT dest FROM e')},
    q AS (SELECT {_SIX} FROM fx_pairs), g AS (SELECT orig, dest, avg(dest_ivt - orig_ivt) AS v FROM fx_pairs GROUP BY 1, 2)
    SELECT orig, dest, weight, round(v, 12) + 0.0 AS ivt_diff, CAST({" + ".join(f"(v >= q{i})::INT" for i in range(6))} - 3 AS BIGINT) AS ivt_class, edge_betweenness FROM e JOIN g USING (orig, dest) JOIN eb USING (orig, dest) CROSS JOIN q"""


def pagerank(edges: str, nodes: str, steps: int) -> str:
    """A million times the rank after ``steps`` rounds from equal ranks; what nodes without outgoing weight hold is shared by all."""
    rounds = ", ".join(
        f"""f{i} AS (SELECT dest AS cell, sum(r * p) AS f FROM p JOIN r{i - 1} ON cell = orig GROUP BY 1),
        r{i} AS MATERIALIZED (SELECT cell, 0.85 * (coalesce(f, 0) + (SELECT coalesce(sum(r), 0) FROM r{i - 1} WHERE cell NOT IN (SELECT orig FROM e)) / n) + 0.15 / n AS r FROM node LEFT JOIN f{i} USING (cell) CROSS JOIN n)"""
        for i in range(1, steps + 1)
    )
    return f"""WITH e AS MATERIALIZED ({edges}), node AS MATERIALIZED ({nodes}), n AS (SELECT count(*) AS n FROM node),
        p AS MATERIALIZED (SELECT orig, dest, weight / sum(weight) OVER (PARTITION BY orig) AS p FROM e), r0 AS (SELECT cell, CAST(1 AS DOUBLE) / n AS r FROM node, n), {rounds}
        SELECT cell AS coord_id, round(1e6 * r, 6) AS pagerank FROM r{steps}"""


#: (information − expected) / (mean entropy − expected); the expectation over tables with the same margins is hypergeometric
ADJUSTED_INFORMATION = """WITH p AS (SELECT * FROM fx_partitions WHERE community <> -999),
    c AS (SELECT a.seed AS s1, b.seed AS s2, a.community AS c1, b.community AS c2, count(*) AS n FROM p a JOIN p b ON a.node = b.node AND a.seed < b.seed GROUP BY 1, 2, 3, 4),
    t AS (SELECT s1, s2, CAST(sum(n) AS BIGINT) AS t FROM c GROUP BY 1, 2),
    x AS (SELECT s1, s2, c1, CAST(sum(n) AS BIGINT) AS x FROM c GROUP BY 1, 2, 3), y AS (SELECT s1, s2, c2, CAST(sum(n) AS BIGINT) AS y FROM c GROUP BY 1, 2, 3),
    mi AS (SELECT s1, s2, sum(n / t * ln(n * t / (x * y))) AS mi FROM c JOIN t USING (s1, s2) JOIN x USING (s1, s2, c1) JOIN y USING (s1, s2, c2) GROUP BY 1, 2),
    hx AS (SELECT s1, s2, -sum(x / t * ln(x / t)) AS h FROM x JOIN t USING (s1, s2) GROUP BY 1, 2), hy AS (SELECT s1, s2, -sum(y / t * ln(y / t)) AS h FROM y JOIN t USING (s1, s2) GROUP BY 1, 2),
    k AS (SELECT s1, s2, x, y, t, unnest(range(greatest(1, x + y - t), least(x, y) + 1)) AS k FROM x JOIN y USING (s1, s2) JOIN t USING (s1, s2)),
    ex AS (SELECT s1, s2, sum(k / t * ln(t * k / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(t - x + 1) + lgamma(t - y + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(x - k + 1) - lgamma(y - k + 1) - lgamma(t - x - y + k + 1))) AS e FROM k GROUP BY 1, 2)
    SELECT s1, s2, round((mi - e) / ((hx.h + hy.h) / 2 - e), 6) AS ami FROM mi JOIN ex USING (s1, s2) JOIN hx USING (s1, s2) JOIN hy USING (s1, s2)"""


def radius(res: int) -> str:
    return f"(12 / pow(sqrt(7), {res}))"


def nearest_hexagon(points: str, res: int) -> str:
    """``points`` (key, lat, lon) with q and s of the nearest centre of the tiling, among the ones around the rounded place."""
    a, lon = radius(res), "((lon + 180) - 360 * floor((lon + 180) / 360) - 180)"
    return f"""SELECT key, arg_min(q, far) AS q, arg_min(s, far) AS s FROM (
        SELECT key, q, s, pow(y - {a} * 1.5 * s, 2) + pow(x - {a} * sqrt(3) * (q + s / 2), 2) AS far FROM (
            SELECT key, x, y, s, CAST(round(x / ({a} * sqrt(3)) - s / 2) AS BIGINT) + dq AS q FROM (
                SELECT key, lat AS y, {lon} AS x, CAST(round(lat / (1.5 * {a})) AS BIGINT) + ds AS s FROM ({points}) p, (VALUES (-1), (0), (1)) o(ds)) o, (VALUES (-1), (0), (1)) i(dq)) c) d GROUP BY key"""


HEX_ENCODE = f"""WITH pts AS (SELECT DISTINCT k AS key, centroid_lat AS lat, centroid_lon AS lon FROM fx_catalog_a),
    {", ".join(f"h{r} AS ({nearest_hexagon('SELECT * FROM pts', r)})" for r in range(3))}
    SELECT {", ".join(f"printf('{r}:%d:%d', h{r}.q, h{r}.s) AS res{r}" for r in range(3))}, count(*) AS count FROM fx_catalog_a JOIN h0 ON h0.key = k JOIN h1 ON h1.key = k JOIN h2 ON h2.key = k GROUP BY 1, 2, 3"""


def icosphere(res: int) -> str:
    """Table expressions of the spherical grid at ``res``: vertices, faces, ``lattice`` (every point of every face with its cell's name),
    ``cells``, and ``place``: the cells of the catalog's points, yb solving for weights and trying all points of the face."""
    n = 4 << res
    named = lambda i, j, k: f"concat_ws('-', CASE WHEN {i} > 0 THEN concat(a, 'x', {i}) END, CASE WHEN {j} > 0 THEN concat(b, 'x', {j}) END, CASE WHEN {k} > 0 THEN concat(c, 'x', {k}) END)"
    middle = lambda x: f"i * {x}a + j * {x}b + k * {x}c"
    det = lambda p, q, r: f"(x{p} * (y{q} * z{r} - z{q} * y{r}) + y{p} * (z{q} * x{r} - x{q} * z{r}) + z{p} * (x{q} * y{r} - y{q} * x{r}))"
    near = lambda p, q: f"{p}.x * {q}.x + {p}.y * {q}.y + {p}.z * {q}.z > 0.4"
    corner = lambda t: f"concat('c{res}:', a, 'x', 3 * i + {t}, '-', b, 'x', 3 * j + {t}, '-', c, 'x', 3 * k + {t})"
    return f"""v AS (SELECT v, CASE WHEN v IN (0, 11) THEN 0 ELSE cos(la) * cos(lo) END AS x, CASE WHEN v IN (0, 11) THEN 0 ELSE cos(la) * sin(lo) END AS y, CASE v WHEN 0 THEN 1 WHEN 11 THEN -1 ELSE sin(la) END AS z
            FROM (SELECT v, CASE WHEN v < 6 THEN atan(0.5) ELSE -atan(0.5) END AS la, radians(11 + CASE WHEN v < 6 THEN 72 * (v - 1) ELSE 72 * (v - 6) + 36 END) AS lo FROM range(12) t(v)) r),
        f AS MATERIALIZED (SELECT a.v AS a, b.v AS b, c.v AS c, a.x AS xa, a.y AS ya, a.z AS za, b.x AS xb, b.y AS yb, b.z AS zb, c.x AS xc, c.y AS yc, c.z AS zc FROM v a, v b, v c WHERE a.v < b.v AND b.v < c.v AND {near("a", "b")} AND {near("b", "c")} AND {near("a", "c")}),
        lattice AS MATERIALIZED (SELECT *, {n} - i - j AS k FROM f, range({n + 1}) t(i), range({n + 1}) u(j) WHERE i + j <= {n}),
        cells AS MATERIALIZED (SELECT coord_id, any_value(mx / r) AS x, any_value(my / r) AS y, any_value(mz / r) AS z FROM (SELECT coord_id, mx, my, mz, sqrt(mx * mx + my * my + mz * mz) AS r FROM (SELECT concat('{res}:', {named("i", "j", "k")}) AS coord_id, {middle("x")} AS mx, {middle("y")} AS my, {middle("z")} AS mz FROM lattice) m) r GROUP BY 1),
        points AS (SELECT key, cos(radians(lat)) * cos(radians(lon)) AS xp, cos(radians(lat)) * sin(radians(lon)) AS yp, sin(radians(lat)) AS zp FROM (SELECT DISTINCT k AS key, centroid_lat AS lat, centroid_lon AS lon FROM fx_catalog_a) d),
        on_face AS (SELECT key, f.*, {det("p", "b", "c")} / {det("a", "b", "c")} AS wa, {det("a", "p", "c")} / {det("a", "b", "c")} AS wb, {det("a", "b", "p")} / {det("a", "b", "c")} AS wc FROM points, f QUALIFY row_number() OVER (PARTITION BY key ORDER BY xp * (xa + xb + xc) + yp * (ya + yb + yc) + zp * (za + zb + zc) DESC) = 1),
        place AS MATERIALIZED (SELECT key, arg_min(concat('{res}:', {named("i", "j", "k")}), pow(i - {n} * wa / (wa + wb + wc), 2) + pow(j - {n} * wb / (wa + wb + wc), 2) + pow(k - {n} * wc / (wa + wb + wc), 2)) AS coord_id
            FROM (SELECT key, o.a, o.b, o.c, wa, wb, wc, i, j, k FROM on_face o JOIN lattice l ON l.a = o.a AND l.b = o.b AND l.c = o.c) c GROUP BY key),
        corner AS MATERIALIZED (SELECT corner, concat('{res}:', cell) AS cell, mx / sqrt(mx * mx + my * my + mz * mz) AS x, my / sqrt(mx * mx + my * my + mz * mz) AS y, mz / sqrt(mx * mx + my * my + mz * mz) AS z FROM (
            SELECT {corner(1)} AS corner, unnest([{named("i + 1", "j", "k")}, {named("i", "j + 1", "k")}, {named("i", "j", "k + 1")}]) AS cell, {", ".join(f"(3 * i + 1) * {x}a + (3 * j + 1) * {x}b + (3 * k + 1) * {x}c AS m{x}" for x in "xyz")} FROM (SELECT * EXCLUDE (k), k - 1 AS k FROM lattice WHERE k >= 1) u
            UNION ALL SELECT {corner(2)}, unnest([{named("i", "j + 1", "k + 1")}, {named("i + 1", "j", "k + 1")}, {named("i + 1", "j + 1", "k")}]), {", ".join(f"(3 * i + 2) * {x}a + (3 * j + 2) * {x}b + (3 * k + 2) * {x}c" for x in "xyz")} FROM (SELECT * EXCLUDE (k), k - 2 AS k FROM lattice WHERE k >= 2) d) t)"""


ICO_ENCODE = f"WITH {icosphere(1)} SELECT coord_id, count(*) AS n FROM fx_catalog_a JOIN place ON key = k GROUP BY 1"

ICO_CELLS = f"""WITH {icosphere(1)}, s AS (SELECT coord_id, count(*) AS n, sum(mean_ivt) AS ivt FROM fx_catalog_a JOIN place ON key = k GROUP BY 1)
    SELECT coord_id, degrees(asin(z)) AS lat, degrees(atan2(y, x)) AS lon, n, ivt FROM cells LEFT JOIN s USING (coord_id)"""

ICO_CORNERS = f"""WITH {icosphere(0)} SELECT coord_id, corner, degrees(asin(z)) AS lat, degrees(atan2(y, x)) AS lon FROM (SELECT DISTINCT coord_id FROM place) p JOIN corner ON cell = coord_id"""

ICO_NEIGHBOURS = f"""WITH {icosphere(0)}, s AS (SELECT coord_id, count(*) AS n FROM fx_catalog_a JOIN place ON key = k GROUP BY 1),
    d AS (SELECT DISTINCT p.cell, q.cell AS neighbour FROM corner p JOIN corner q ON p.corner = q.corner AND p.cell <> q.cell)
    SELECT coord_id, any_value(s.n) AS n, count(*) AS neighbours, CAST(coalesce(sum(o.n), 0) AS BIGINT) AS around FROM s JOIN d ON cell = s.coord_id LEFT JOIN (SELECT coord_id AS neighbour, n FROM s) o USING (neighbour) GROUP BY 1"""

_REGIMES = "c AS (SELECT coord_id AS cell, regime AS m FROM (SELECT coord_id, regime, count(*) AS n FROM fx_catalog_a JOIN place ON key = k GROUP BY 1, 2) g QUALIFY row_number() OVER (PARTITION BY coord_id ORDER BY n DESC, regime) = 1)"

ICO_SIDES = f"""WITH {icosphere(0)}, {_REGIMES} SELECT DISTINCT c.cell AS node, q.cell AS neighbour, c.m AS community FROM c JOIN corner p ON p.cell = c.cell JOIN corner q ON p.corner = q.corner AND p.cell <> q.cell LEFT JOIN c o ON o.cell = q.cell WHERE o.m IS NULL OR o.m <> c.m"""

ICO_OUTLINES = f"""WITH RECURSIVE {icosphere(0)}, {_REGIMES},
    side AS MATERIALIZED (SELECT p.cell, q.cell AS other, min(p.corner) AS c1, max(p.corner) AS c2 FROM corner p JOIN corner q ON p.corner = q.corner AND p.cell <> q.cell GROUP BY 1, 2),
    link AS MATERIALIZED (SELECT c.m, c.cell, c1, c2 FROM c JOIN side ON side.cell = c.cell LEFT JOIN c o ON o.cell = other WHERE o.m IS NULL OR o.m <> c.m),
    r(m, x, y) AS (SELECT m, c1, c1 FROM link UNION SELECT m, c2, c2 FROM link UNION SELECT r.m, r.x, l.y FROM r JOIN (SELECT m, c1 AS x, c2 AS y FROM link UNION SELECT m, c2, c1 FROM link) l ON l.m = r.m AND l.x = r.y),
    ring AS (SELECT m, x, min(y) AS ring FROM r GROUP BY 1, 2), spot AS (SELECT DISTINCT corner, x, y, z FROM corner),
    e AS (SELECT l.m, ring, sign(o.x * (p.y * q.z - p.z * q.y) + o.y * (p.z * q.x - p.x * q.z) + o.z * (p.x * q.y - p.y * q.x)) * 2 * atan2(p.x * q.y - p.y * q.x, 1 + p.z + q.z + p.x * q.x + p.y * q.y + p.z * q.z) AS e
        FROM link l JOIN ring ON ring.m = l.m AND ring.x = c1 JOIN spot p ON p.corner = c1 JOIN spot q ON q.corner = c2 JOIN cells o ON o.coord_id = l.cell)
    SELECT community, ring, n_corners, area, CAST(area > 2 * pi() AS BIGINT) AS hole FROM (SELECT m AS community, ring, count(*) AS n_corners, sum(e) - 4 * pi() * floor(sum(e) / (4 * pi())) AS area FROM e GROUP BY 1, 2) a"""
