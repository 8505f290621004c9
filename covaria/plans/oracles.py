"""DuckDB SQL that gives the registered queries' results."""

from __future__ import annotations

CELLS = """
cells AS (SELECT 's' || (vec_id % 2) AS slide, vec_id AS cell_id, 'T' || (label % 3) AS ct, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
expr AS (SELECT vec_id AS cell_id, 'g' || i AS gene, embedding[i]::DOUBLE AS v FROM embeddings, range(4, 65) r(i)),
fixed AS (SELECT c.slide, c.ct, c.cell_id, cc::INT AS cc, e.v AS score FROM cells c JOIN expr e USING (cell_id) JOIN (VALUES ('g4', 1), ('g5', 2)) n(gene, cc) USING (gene))"""

PAIRS = "(VALUES ('T0', 'T1'), ('T0', 'T2'), ('T1', 'T2')) p(ct_1, ct_2)"
SELVES = "(VALUES ('T0', 'T0'), ('T1', 'T1'), ('T2', 'T2')) p(ct_1, ct_2)"
ALL = "(VALUES ('T0', 'T1'), ('T0', 'T2'), ('T1', 'T2'), ('T0', 'T0'), ('T1', 'T1'), ('T2', 'T2')) p(ct_1, ct_2)"
BLOCK = "sigma, slide, ct_1, ct_2"


def dist(pairs: str, name: str = "dist") -> str:
    return f"""{name} AS (SELECT a.slide, p.ct_1, p.ct_2, a.cell_id AS i, b.cell_id AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d
  FROM {pairs} JOIN cells a ON a.ct = p.ct_1 JOIN cells b ON b.ct = p.ct_2 AND a.slide = b.slide WHERE p.ct_1 <> p.ct_2 OR a.cell_id <> b.cell_id)"""


def kern(pairs: str, name: str = "kern", sigmas: str = "(VALUES (0.01::DOUBLE), (0.02::DOUBLE))") -> str:
    return f"""{dist(pairs, name + "_d")},
{name}_r AS (SELECT sigma, slide, ct_1, ct_2, i, j, exp(-0.5 * (d / sigma) * (d / sigma)) AS k FROM {name}_d, {sigmas} s(sigma) WHERE exp(-0.5 * (d / sigma) * (d / sigma)) >= 1e-7),
{name}_q AS (SELECT {BLOCK}, quantile_cont(k, 0.85) AS q FROM {name}_r GROUP BY ALL),
{name} AS (SELECT {BLOCK}, i, j, least(k, q) AS k FROM {name}_r JOIN {name}_q USING ({BLOCK}))"""


SIZES = "sizes AS (SELECT slide, ct, count(*) AS n FROM cells GROUP BY ALL)"


def low(name: str) -> str:
    """Low quantile of each block of a table of distances without zeros, and the scale factor."""
    return f"""{name}_lev AS (SELECT DISTINCT d.slide, d.ct_1, d.ct_2, CASE WHEN d.ct_1 = d.ct_2 THEN 1e-4::DOUBLE ELSE least(1e-3::DOUBLE, 2.0::DOUBLE / greatest(a.n, b.n)) END AS p
  FROM {name} d JOIN sizes a ON a.slide = d.slide AND a.ct = d.ct_1 JOIN sizes b ON b.slide = d.slide AND b.ct = d.ct_2),
{name}_rk AS (SELECT d.slide, d.ct_1, d.ct_2, d, row_number() OVER o - 1 AS r, (count(*) OVER (PARTITION BY d.slide, d.ct_1, d.ct_2) - 1) * p AS h FROM {name} d JOIN {name}_lev USING (slide, ct_1, ct_2) WINDOW o AS (PARTITION BY d.slide, d.ct_1, d.ct_2 ORDER BY d)),
{name}_low AS (SELECT slide, ct_1, ct_2, max(d) FILTER (r = floor(h)) + (h - floor(h)) * (max(d) FILTER (r = ceil(h)) - max(d) FILTER (r = floor(h))) AS low FROM {name}_rk GROUP BY slide, ct_1, ct_2, h),
{name}_f AS (SELECT 0.01::DOUBLE / min(low) AS f FROM {name}_low)"""


def resampled(draws: int, bins: int = 6) -> str:
    """Tiles of each type's extent, shuffled by md5; their cells take those of the tile that they got and, as far as needed, of its neighbours."""
    group = "slide, ct"
    tile = lambda v: f"least(greatest(ceil(({v} - {v}0) / (({v}1 - {v}0) / {bins})) - 1, 0), {bins - 1})::INT"
    return f"""box AS (SELECT {group}, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM cells GROUP BY ALL),
placed AS (SELECT {group}, cell_id, {tile("x")} AS tx, {tile("y")} AS ty FROM cells JOIN box USING ({group})),
occ AS (SELECT draw::INT AS draw, {group}, tx, ty, count(*) AS n FROM placed, range(1, {draws + 1}) d(draw) GROUP BY ALL),
rnk AS (SELECT *, row_number() OVER (PARTITION BY draw, {group} ORDER BY tx, ty) AS a, row_number() OVER (PARTITION BY draw, {group} ORDER BY md5('1|' || draw || '|' || tx || '|' || ty), tx, ty) AS b FROM occ),
mapped AS (SELECT x.draw, x.slide, x.ct, x.tx, x.ty, x.n, g.tx AS gx, g.ty AS gy FROM rnk x JOIN rnk g ON x.draw = g.draw AND x.slide = g.slide AND x.ct = g.ct AND x.a = g.b),
around AS (SELECT * FROM (VALUES (0, 0, 0), (1, -1, -1), (2, -1, 0), (3, -1, 1), (4, 0, -1), (5, 0, 1), (6, 1, -1), (7, 1, 0), (8, 1, 1)) o(o, dx, dy)),
csize AS (SELECT {group}, tx AS cx, ty AS cy, count(*) AS cn FROM placed GROUP BY ALL),
near AS (SELECT m.*, o, cx, cy, cn, coalesce(sum(cn) OVER (PARTITION BY draw, m.slide, m.ct, tx, ty ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM mapped m CROSS JOIN around JOIN csize c ON c.slide = m.slide AND c.ct = m.ct AND c.cx = m.gx + dx AND c.cy = m.gy + dy),
used AS (SELECT * FROM near WHERE before < n),
tot AS (SELECT draw, {group}, tx, ty, sum(cn) AS total FROM used GROUP BY ALL),
offered AS (SELECT u.draw, u.slide, u.ct, u.tx, u.ty, p.cell_id AS source_id, row_number() OVER (PARTITION BY u.draw, u.slide, u.ct, u.tx, u.ty ORDER BY md5('1|' || u.draw || '|' || u.tx || '|' || u.ty || '|' || p.cell_id), p.cell_id) - 1 AS r
  FROM used u JOIN placed p ON p.slide = u.slide AND p.ct = u.ct AND p.tx = u.cx AND p.ty = u.cy),
asked AS (SELECT w.draw, w.slide, w.ct, w.cell_id, w.tx, w.ty, (w.a % total)::BIGINT AS r FROM (
  SELECT draw::INT AS draw, {group}, cell_id, tx, ty, row_number() OVER (PARTITION BY draw, {group}, tx, ty ORDER BY md5('1|' || draw || '|' || cell_id), cell_id) - 1 AS a FROM placed, range(1, {draws + 1}) d(draw)) w
  JOIN tot USING (draw, {group}, tx, ty))"""


def norms(k: str = "kern") -> str:
    return f"""rs AS (SELECT {BLOCK}, i, sum(k) AS s, sum(k * k) AS q FROM {k} GROUP BY ALL),
cs AS (SELECT {BLOCK}, j, sum(k) AS s FROM {k} GROUP BY ALL),
br AS (SELECT {BLOCK}, sum(q) AS k2, sum(s * s) AS r2, sum(s) AS t FROM rs GROUP BY ALL),
bc AS (SELECT {BLOCK}, sum(s * s) AS c2 FROM cs GROUP BY ALL),
norms AS (SELECT br.sigma, br.slide, br.ct_1, br.ct_2, sqrt(greatest(k2 - r2 / b.n - c2 / a.n + t * t / (a.n * b.n), 0)) AS norm
  FROM br JOIN bc USING ({BLOCK}) JOIN sizes a ON a.slide = br.slide AND a.ct = br.ct_1 JOIN sizes b ON b.slide = br.slide AND b.ct = br.ct_2)"""


def ncorr(scores: str = "fixed") -> str:
    return f"""num AS (SELECT kern.sigma, kern.slide, ct_1, ct_2, a.cc, sum(k * a.score * b.score) AS num FROM kern JOIN {scores} a ON a.cell_id = i JOIN {scores} b ON b.cell_id = j AND b.cc = a.cc GROUP BY ALL),
len AS (SELECT slide, ct, cc, sum(score * score) AS q FROM {scores} GROUP BY ALL),
parts AS (SELECT num.*, norm, a.q AS q1, b.q AS q2 FROM num JOIN norms USING ({BLOCK}) JOIN len a ON a.slide = num.slide AND a.ct = num.ct_1 AND a.cc = num.cc
  JOIN len b ON b.slide = num.slide AND b.ct = num.ct_2 AND b.cc = num.cc),
assoc AS (SELECT {BLOCK}, cc, CASE WHEN abs(sqrt(q1) * sqrt(q2) * norm) < 1e-9 THEN 0.0 ELSE num / (sqrt(q1) * sqrt(q2) * norm) END AS v FROM parts),
agg AS (SELECT sigma, ct_1, ct_2, cc, sum(num) / (sqrt(sum(q1)) * sqrt(sum(q2)) * avg(norm)) AS v FROM parts WHERE norm >= 1e-9 GROUP BY ALL)"""


def bidir(a: str, b: str, k1: str, k2: str) -> str:
    """Given CTEs of the sides (block, id, cc, value) and the two kernels."""
    return f"""ka AS (SELECT {BLOCK}, j, cc, sum(k * a) AS s FROM {k1} JOIN {a} USING ({BLOCK}, i) GROUP BY ALL),
kb AS (SELECT {BLOCK}, i, cc, sum(k * b) AS s FROM {k2} JOIN {b} USING ({BLOCK}, j) GROUP BY ALL),
r1 AS (SELECT {BLOCK}, cc, coalesce(s, 0) AS x, b AS y FROM {b} LEFT JOIN ka USING ({BLOCK}, j, cc)),
r2 AS (SELECT {BLOCK}, cc, coalesce(s, 0) AS x, a AS y FROM {a} LEFT JOIN kb USING ({BLOCK}, i, cc)),
p1 AS (SELECT {BLOCK}, cc, corr(x, y) AS r FROM r1 GROUP BY ALL), p2 AS (SELECT {BLOCK}, cc, corr(x, y) AS r FROM r2 GROUP BY ALL)
SELECT {BLOCK}, cc, round((coalesce(p1.r, 0) + coalesce(p2.r, 0)) / 2, DIGITS) + 0.0 AS bidir_correlation FROM p1 JOIN p2 USING ({BLOCK}, cc)"""


def crossed_bidir(scores: str = "fixed", digits: int = 6) -> str:
    return f"""rowsum AS (SELECT {BLOCK}, i, sum(k) AS s FROM kern GROUP BY ALL HAVING sum(k) > 5e-3),
one AS (SELECT kern.* FROM kern SEMI JOIN rowsum USING ({BLOCK}, i)),
colsum AS (SELECT {BLOCK}, j, sum(k) AS s FROM one GROUP BY ALL HAVING sum(k) > 5e-3),
used AS (SELECT one.* FROM one SEMI JOIN colsum USING ({BLOCK}, j)),
side_a AS (SELECT rowsum.sigma, rowsum.slide, ct_1, ct_2, i, f.cc, f.score AS a FROM rowsum JOIN {scores} f ON f.cell_id = i),
side_b AS (SELECT colsum.sigma, colsum.slide, ct_1, ct_2, j, f.cc, f.score AS b FROM colsum JOIN {scores} f ON f.cell_id = j),
k1 AS (SELECT {BLOCK}, i, j, k / sum(k) OVER (PARTITION BY {BLOCK}, i) AS k FROM used),
k2 AS (SELECT {BLOCK}, i, j, k / sum(k) OVER (PARTITION BY {BLOCK}, j) AS k FROM used),
{bidir("side_a", "side_b", "k1", "k2").replace("DIGITS", str(digits))}"""


def scaled_kernel(rounds: int = 12) -> str:
    """Rows and columns scaled in turn: a pair of vectors for each round."""
    out = [f"""sc0 AS (SELECT DISTINCT {BLOCK}, j, 1.0::DOUBLE AS c FROM kern)"""]
    for t in range(1, rounds + 1):
        out.append(f"sr{t} AS MATERIALIZED (SELECT {BLOCK}, i, 1 / sum(k * c) AS r FROM kern JOIN sc{t - 1} USING ({BLOCK}, j) GROUP BY ALL)")
        out.append(f"sc{t} AS MATERIALIZED (SELECT {BLOCK}, j, 1 / sum(k * r) AS c FROM kern JOIN sr{t} USING ({BLOCK}, i) GROUP BY ALL)")
    return ",\n".join([*out, f"scaled AS (SELECT {BLOCK}, i, j, k * r * c AS k FROM kern JOIN sr{rounds} USING ({BLOCK}, i) JOIN sc{rounds} USING ({BLOCK}, j))"])


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c for c in ctes)


SUMMARY = f"SELECT {BLOCK}, count(*)::BIGINT AS n, round(sum(k), 6) AS total, round(max(k), 6) AS largest FROM {{k}} GROUP BY ALL"
MOMENTS = """
stat AS (SELECT ct, slide, gene, count(*) AS n, avg(v) AS m, sqrt(greatest(sum(v * v) - count(*) * avg(v) * avg(v), 0) / (count(*) - 1)) AS sd, count(*) FILTER (v <> 0) AS nz FROM expr JOIN cells USING (cell_id) GROUP BY ALL),
mom AS (SELECT *, bool_or(n < 2 OR sd < 1e-3 OR nz / n < 0.01) OVER (PARTITION BY ct, gene) AS guarded FROM stat)"""
WEIGHTS = "w AS (SELECT t.ct, pc::INT AS pc, cc::INT AS cc, 1.0::DOUBLE / (pc + cc + o) AS w FROM (VALUES ('T0', 0), ('T1', 1), ('T2', 2)) t(ct, o), range(1, 3) a(pc), range(1, 3) b(cc))"
HALVES = """
full_ AS (SELECT slide, ct, cell_id, gene, v FROM expr JOIN cells USING (cell_id)),
ref AS (SELECT * FROM full_ WHERE slide = 's0'), tar AS (SELECT * FROM full_ WHERE slide = 's1')"""


def qn(keys: str) -> str:
    return f"""rk AS (SELECT {keys}, v, row_number() OVER (PARTITION BY {keys} ORDER BY v) - 1 AS k FROM ref),
nr AS (SELECT {keys}, count(*) AS n FROM ref GROUP BY ALL),
tp AS (SELECT tar.*, n, percent_rank() OVER (PARTITION BY {keys} ORDER BY v) * (n - 1) AS h FROM tar JOIN nr USING ({keys})),
qn AS (SELECT tp.slide, tp.ct, tp.cell_id, tp.gene, a.v + (h - floor(h)) * (b.v - a.v) AS v FROM tp JOIN rk a ON {" AND ".join(f"a.{k.strip()} = tp.{k.strip()}" for k in keys.split(","))} AND a.k = floor(h)
  JOIN rk b ON {" AND ".join(f"b.{k.strip()} = tp.{k.strip()}" for k in keys.split(","))} AND b.k = least(floor(h) + 1, n - 1))"""


TRANSFER = f"""{qn("ct, gene")},
st AS (SELECT ct, gene, avg(v) AS m, stddev_samp(v) AS sd FROM ref GROUP BY ALL),
gw AS (SELECT 'g' || g AS gene, CASE WHEN abs(0.1::DOUBLE * g - 0.45::DOUBLE) < 0.1 THEN 0.0::DOUBLE ELSE 0.1::DOUBLE * g - 0.45::DOUBLE END AS w FROM range(4, 9) r(g)),
moved AS (SELECT slide, ct, cell_id, 1 AS cc, sum((v - m) / CASE WHEN sd IS NULL OR sd < 1e-8 THEN 1.0 ELSE sd END * w) AS score FROM qn JOIN st USING (ct, gene) JOIN gw USING (gene) GROUP BY ALL)"""
Z = """
zs AS (SELECT ct, slide, gene, cell_id, CASE WHEN stddev_samp(v) OVER b > 0 THEN (v - avg(v) OVER b) / stddev_samp(v) OVER b ELSE 0 END AS s FROM expr JOIN cells USING (cell_id) WINDOW b AS (PARTITION BY slide, ct, gene)),
own AS (SELECT a.slide, a.ct, a.gene AS gene_1, b.gene AS gene_2, sum(a.s * b.s) / count(DISTINCT a.cell_id) AS c FROM zs a JOIN zs b ON a.cell_id = b.cell_id AND a.gene <= b.gene GROUP BY ALL)"""
CROSSCOV = f"""xc AS (SELECT kern.sigma, kern.slide, ct_1, ct_2, a.gene AS gene_1, b.gene AS gene_2, sum(k * a.s * b.s) AS y FROM kern JOIN zs a ON a.cell_id = i JOIN zs b ON b.cell_id = j GROUP BY ALL),
crossed AS (SELECT xc.sigma, xc.slide, ct_1, ct_2, gene_1, gene_2, y / sqrt(a.n * b.n) AS c FROM xc JOIN sizes a ON a.slide = xc.slide AND a.ct = ct_1 JOIN sizes b ON b.slide = xc.slide AND b.ct = ct_2)"""
NULL_ = f"""{kern(PAIRS)},
draws AS (SELECT draw::INT AS draw, slide, ct, cell_id FROM cells, range(1, 10) d(draw) WHERE ct IN ('T1', 'T2')),
ra AS (SELECT *, row_number() OVER (PARTITION BY draw, slide, ct ORDER BY cell_id) AS a, row_number() OVER (PARTITION BY draw, slide, ct ORDER BY md5('1|' || draw || '|' || cell_id), cell_id) AS b FROM draws),
perm AS (SELECT x.draw, x.cell_id, s.cell_id AS source_id FROM ra x JOIN ra s ON x.draw = s.draw AND x.slide = s.slide AND x.ct = s.ct AND x.a = s.b),
one AS (SELECT * FROM fixed WHERE cc = 1),
sm AS (SELECT sigma, ct_1, ct_2, j, sum(k * score) AS s FROM kern JOIN one ON cell_id = i GROUP BY ALL),
nul AS (SELECT draw, sigma, ct_1, ct_2, sum(s * score) AS v FROM sm JOIN perm ON perm.cell_id = j JOIN one ON one.cell_id = source_id GROUP BY ALL),
obs AS (SELECT sigma, ct_1, ct_2, sum(s * score) AS v FROM sm JOIN one ON one.cell_id = j GROUP BY ALL),
dm AS (SELECT draw, max(v) AS v FROM nul GROUP BY ALL)"""
TILES = """
box AS (SELECT slide, ct, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM cells GROUP BY ALL)"""

ORACLES: dict[str, str] = {
    "create_cells": f"{with_(CELLS)} SELECT '7' AS slide, ct AS cell_type, count(*)::BIGINT AS n, round(min(x), 6) AS x_min, round(max(y), 6) AS y_max FROM cells GROUP BY ALL",
    "subset_types": f"{with_(CELLS)} SELECT gene, count(*)::BIGINT AS n, round(sum(v), 6) AS total FROM expr JOIN cells USING (cell_id) WHERE ct IN ('T0', 'T2') GROUP BY ALL",
    "pair_enumeration": f"{with_(CELLS)} SELECT DISTINCT a.ct AS ct_1, b.ct AS ct_2 FROM cells a JOIN cells b ON a.ct < b.ct",
    "block_sizes": f"""{with_(CELLS, SIZES)} SELECT a.slide, ct_1, ct_2, a.n::BIGINT AS n_1, b.n::BIGINT AS n_2, CASE WHEN ct_1 = ct_2 THEN a.n * (a.n - 1) ELSE a.n * b.n END::BIGINT AS n_pairs,
  round(CASE WHEN ct_1 = ct_2 THEN 1e-4::DOUBLE ELSE least(1e-3::DOUBLE, 2.0::DOUBLE / greatest(a.n, b.n)) END, 10) AS level
  FROM {ALL} JOIN sizes a ON a.ct = ct_1 JOIN sizes b ON b.ct = ct_2 AND a.slide = b.slide WHERE a.n > 5 AND b.n > 5""",
    "prevalent_genes": f"{with_(CELLS)} SELECT gene, count(*) FILTER (v > 0)::BIGINT AS n_expressing FROM expr GROUP BY gene HAVING count(*) FILTER (v > 0) >= 20 AND count(*) FILTER (v > 0) >= 0.45::DOUBLE * (SELECT count(*) FROM cells)",
    "clip_values": f"{with_(CELLS, 'lim AS (SELECT quantile_cont(v, 0.98) AS q FROM expr WHERE v > 0)')} SELECT gene, round(max(least(v, q)), 6) AS largest, round(sum(least(v, q)), 6) AS total FROM expr, lim GROUP BY ALL",
    "sufficient_slides": f"{with_(CELLS, SIZES)} SELECT slide FROM sizes WHERE n >= 60 GROUP BY slide HAVING count(*) = 3",
    "cap_and_log_genes": f"""{with_(CELLS, "pos AS (SELECT cell_id, gene, CASE WHEN v > 0 THEN v ELSE 0 END AS v FROM expr)", "cap AS (SELECT gene, quantile_cont(v, 0.95) AS q FROM pos GROUP BY ALL)")}
  SELECT gene, count(*)::BIGINT AS n, round(sum(ln(1 + least(v, q))), 6) AS total FROM pos JOIN cap USING (gene) WHERE v > 0 GROUP BY ALL""",
    "distance_cross": f"{with_(CELLS, dist(PAIRS))} SELECT slide, ct_1, ct_2, count(*)::BIGINT AS n, round(sum(d), 6) AS total, round(min(d), 6) AS least FROM dist GROUP BY ALL",
    "distance_self": f"{with_(CELLS, dist(SELVES))} SELECT slide, ct_1, ct_2, count(*)::BIGINT AS n, round(sum(d), 6) AS total, round(min(d), 6) AS least FROM dist GROUP BY ALL",
    "distance_three_axes": f"""{with_(CELLS)} SELECT a.slide, ct_1, ct_2, count(*)::BIGINT AS n, round(sum(sqrt(power(a.x - b.x, 2) + power(2 * a.y - 2 * b.y, 2) + power(0.5 * a.z - 0.5 * b.z, 2))), 6) AS total
  FROM {PAIRS} JOIN cells a ON a.ct = ct_1 JOIN cells b ON a.slide = b.slide AND b.ct = ct_2 GROUP BY ALL""",
    "range_join": f"{with_(CELLS, dist(PAIRS))} SELECT slide, ct_1, ct_2, i, j, round(d, 10) AS d FROM dist WHERE d <= 0.02",
    "range_join_events": """WITH p AS (SELECT event_type AS ct, event_id AS id, (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 3600.0::DOUBLE AS x, value AS y FROM events)
  SELECT a.ct AS ct_1, count(*)::BIGINT AS n FROM p a JOIN p b ON a.ct = b.ct AND a.id <> b.id AND b.x BETWEEN a.x - 0.06 AND a.x + 0.06 WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.05 GROUP BY ALL""",
    "low_quantiles": f"""{with_(CELLS, SIZES, dist(ALL))} , lev AS (SELECT a.slide, ct_1, ct_2, CASE WHEN ct_1 = ct_2 THEN 1e-4::DOUBLE ELSE least(1e-3::DOUBLE, 2.0::DOUBLE / greatest(a.n, b.n)) END AS p FROM {ALL} JOIN sizes a ON a.ct = ct_1 JOIN sizes b ON b.ct = ct_2 AND a.slide = b.slide),
  rk AS (SELECT slide, ct_1, ct_2, d, p, row_number() OVER b - 1 AS r, count(*) OVER (PARTITION BY slide, ct_1, ct_2) AS n FROM dist JOIN lev USING (slide, ct_1, ct_2) WINDOW b AS (PARTITION BY slide, ct_1, ct_2 ORDER BY d))
  SELECT slide, ct_1, ct_2, n::BIGINT AS n_pairs, round(max(d) FILTER (r = floor((n - 1) * p)) + ((n - 1) * p - floor((n - 1) * p)) * (max(d) FILTER (r = ceil((n - 1) * p)) - max(d) FILTER (r = floor((n - 1) * p))), 10) AS low FROM rk GROUP BY slide, ct_1, ct_2, n, p""",
    "conditioned_distances": f"""{with_(CELLS, SIZES, dist(PAIRS), low("dist"))}
  SELECT slide, ct_1, ct_2, count(*)::BIGINT AS n, round(min(greatest(d, low) * f), 5) AS least, round(sum(greatest(d, low) * f), 5) AS total FROM dist JOIN dist_low USING (slide, ct_1, ct_2), dist_f GROUP BY ALL""",
    "kernel_doubly_stochastic": f"""{with_(CELLS, kern(PAIRS, sigmas="(VALUES (0.2::DOUBLE))"), scaled_kernel())}, rs AS (SELECT {BLOCK}, i, sum(k) AS s FROM scaled GROUP BY ALL), cs AS (SELECT {BLOCK}, j, sum(k) AS s FROM scaled GROUP BY ALL),
  r AS (SELECT {BLOCK}, min(s) AS r0, max(s) AS r1 FROM rs GROUP BY ALL), c AS (SELECT {BLOCK}, min(s) AS c0, max(s) AS c1 FROM cs GROUP BY ALL), v AS (SELECT {BLOCK}, count(*) AS n, sum(k * k) AS q, max(k) AS m FROM scaled GROUP BY ALL)
  SELECT {BLOCK}, n::BIGINT AS n, round(q, 5) AS squares, round(m, 5) AS largest, round(r0, 5) AS least_row, round(r1, 5) AS largest_row, round(c0, 5) AS least_column, round(c1, 5) AS largest_column FROM v JOIN r USING ({BLOCK}) JOIN c USING ({BLOCK})""",
    "kernel_conditioned": f"""{with_(CELLS, SIZES, dist(PAIRS), low("dist"))},
  far AS (SELECT slide, ct_1, ct_2, i, j, greatest(d, low) * f AS d FROM dist JOIN dist_low USING (slide, ct_1, ct_2), dist_f),
  raw AS (SELECT sigma, slide, ct_1, ct_2, i, j, exp(-0.5 * (d / sigma) * (d / sigma)) AS k FROM far, (VALUES (0.0001::DOUBLE), (0.01::DOUBLE), (0.02::DOUBLE)) s(sigma) WHERE exp(-0.5 * (d / sigma) * (d / sigma)) >= 1e-7),
  good AS (SELECT sigma, raw.slide, ct_1, ct_2, quantile_cont(k, 0.85) AS q FROM raw JOIN sizes a ON a.slide = raw.slide AND a.ct = ct_1 JOIN sizes b ON b.slide = raw.slide AND b.ct = ct_2 GROUP BY sigma, raw.slide, ct_1, ct_2 HAVING count(*) FILTER (k > 1e-7) >= 2 * least(min(a.n), min(b.n))),
  kern AS (SELECT {BLOCK}, i, j, least(k, q) AS k FROM raw JOIN good USING ({BLOCK}))
  {SUMMARY.format(k="kern")}""",
    "bidirectional_sinkhorn": f"""{with_(CELLS, kern(PAIRS, sigmas="(VALUES (0.2::DOUBLE))"), scaled_kernel())}, bl AS (SELECT DISTINCT {BLOCK} FROM kern),
  side_a AS (SELECT bl.sigma, bl.slide, ct_1, ct_2, cell_id AS i, cc, score AS a FROM bl JOIN fixed f ON f.slide = bl.slide AND f.ct = ct_1), side_b AS (SELECT bl.sigma, bl.slide, ct_1, ct_2, cell_id AS j, cc, score AS b FROM bl JOIN fixed f ON f.slide = bl.slide AND f.ct = ct_2),
  {bidir("side_a", "side_b", "scaled", "scaled").replace("DIGITS", "4")}""",
    "three_type_cca": "SELECT sigma, cell_type, true AS stationary, true AS unit FROM (VALUES (0.1::DOUBLE), (0.2::DOUBLE)) s(sigma), (VALUES ('T0'), ('T1'), ('T2')) t(cell_type)",
    "genespace_axes": "SELECT 0.05::DOUBLE AS sigma, 1 AS cc, true AS agrees, true AS spread, true AS unit",
    "permutation_test_three_types": f"SELECT sigma, ct_1, ct_2, cc::INT AS cc, true AS agrees, 9::BIGINT AS n_draws, true AS bounded, 9::BIGINT AS distinct_values FROM (VALUES (0.1::DOUBLE), (0.2::DOUBLE)) s(sigma), {PAIRS}, range(1, 3) c(cc)",
    # a median leaves half of all but one on its lower side
    "split_large_slides": """WITH RECURSIVE c AS (SELECT count(*) AS n FROM embeddings GROUP BY vec_id % 2),
  s AS (SELECT n FROM c UNION ALL SELECT unnest([(n - 1 + 1) // 2, n - n // 2]) FROM s WHERE n > 100) SELECT max(n) FILTER (n <= 100)::INT AS largest, sum(n) FILTER (n <= 100)::BIGINT AS cells FROM s""",
    "split_slides_kmeans": f"{with_(CELLS)} SELECT slide, count(*)::BIGINT AS cells, true AS bounded, round(sum(x), 6) + 0.0 AS sx, round(sum(y), 6) + 0.0 AS sy, true AS compact FROM cells GROUP BY ALL",
    "plot_slicing": f"{with_(CELLS)} SELECT slide, count(*)::BIGINT AS cells, true AS bounded, count(*) > 100 AS named, round(sum(x), 6) + 0.0 AS sx, round(sum(y), 6) + 0.0 AS sy FROM cells GROUP BY ALL",
    "self_distance_factor": f"""{with_(CELLS, SIZES, dist(PAIRS), low("dist"), dist(SELVES, "own"), low("own"))} SELECT round(dist_f.f, 5) AS cross_factor, round(own_f.f, 5) AS own_factor FROM dist_f, own_f""",
    "self_kernel_own_factor": f"""{with_(CELLS, SIZES, dist(SELVES, "own"), low("own"))},
  scaled AS (SELECT slide, ct_1, ct_2, greatest(d, low) * f AS d FROM own JOIN own_low USING (slide, ct_1, ct_2), own_f),
  raw AS (SELECT slide, ct_1, ct_2, exp(-0.5 * (d / 0.02) * (d / 0.02)) AS k FROM scaled WHERE exp(-0.5 * (d / 0.02) * (d / 0.02)) >= 1e-7),
  q AS (SELECT slide, ct_1, ct_2, quantile_cont(k, 0.85) AS q FROM raw GROUP BY ALL)
  SELECT 0.02::DOUBLE AS sigma, slide, ct_1, ct_2, count(*)::BIGINT AS n, round(sum(least(k, q)), 5) AS total, round(max(least(k, q)), 5) AS largest FROM raw JOIN q USING (slide, ct_1, ct_2) GROUP BY ALL""",
    "kernel_edges": f"{with_(CELLS, kern(PAIRS))} SELECT {BLOCK}, i, j, round(k, 8) AS k FROM kern",
    "kernel_self": f"{with_(CELLS, kern(SELVES))} {SUMMARY.format(k='kern')}",
    "kernel_dense_path": f"{with_(CELLS, kern(PAIRS))} {SUMMARY.format(k='kern')}",
    "kernel_row_normalized": f"{with_(CELLS, kern(PAIRS), f'rs AS (SELECT *, sum(k) OVER (PARTITION BY {BLOCK}, i) AS s FROM kern)', 'nk AS (SELECT * REPLACE (CASE WHEN s > 1e-4 THEN k / s ELSE k END AS k) FROM rs)', 'f AS (SELECT * FROM nk WHERE k >= 1e-7)')} {SUMMARY.format(k='f')}",
    "kernel_col_normalized": f"{with_(CELLS, kern(PAIRS), f'rs AS (SELECT *, sum(k) OVER (PARTITION BY {BLOCK}, j) AS s FROM kern)', 'nk AS (SELECT * REPLACE (CASE WHEN s > 1e-4 THEN k / s ELSE k END AS k) FROM rs)', 'f AS (SELECT * FROM nk WHERE k >= 1e-7)')} {SUMMARY.format(k='f')}",
    "kernel_median_normalized": f"""{with_(CELLS, kern(PAIRS), f'rs AS (SELECT {BLOCK}, i, sum(k) AS s FROM kern GROUP BY ALL)', f'md AS (SELECT {BLOCK}, median(s) AS m FROM rs WHERE s > 1e-5 GROUP BY ALL)', f'nk AS (SELECT {BLOCK}, i, j, k / m AS k FROM kern JOIN md USING ({BLOCK}))', 'f AS (SELECT * FROM nk WHERE k >= 1e-7)')} {SUMMARY.format(k='f')}""",
    "kernel_support": f"""{with_(CELLS, SIZES, dist(PAIRS))}, r AS (SELECT sigma, slide, ct_1, ct_2, exp(-0.5 * (d / sigma) * (d / sigma)) AS k FROM dist, (VALUES (0.001::DOUBLE), (0.01::DOUBLE)) s(sigma) WHERE d <= 0.06),
  c AS (SELECT {BLOCK}, count(*) FILTER (k > 1e-7)::BIGINT AS n_edges FROM r WHERE k >= 1e-7 GROUP BY ALL)
  SELECT c.sigma, c.slide, ct_1, ct_2, n_edges, 2.0::DOUBLE * least(a.n, b.n) AS required, n_edges >= 2.0::DOUBLE * least(a.n, b.n) AS valid FROM c JOIN sizes a ON a.slide = c.slide AND a.ct = ct_1 JOIN sizes b ON b.slide = c.slide AND b.ct = ct_2""",
    "kernel_filter_cross": f"""{with_(CELLS, kern(PAIRS))}, r AS (SELECT {BLOCK}, i FROM kern GROUP BY ALL HAVING sum(k) > 0.5), a AS (SELECT kern.* FROM kern SEMI JOIN r USING ({BLOCK}, i)),
  c AS (SELECT {BLOCK}, j FROM a GROUP BY ALL HAVING sum(k) > 0.5), f AS (SELECT a.* FROM a SEMI JOIN c USING ({BLOCK}, j)) {SUMMARY.format(k='f')}""",
    "kernel_filter_self": f"""{with_(CELLS, kern(SELVES))}, r AS (SELECT {BLOCK}, i FROM kern GROUP BY ALL HAVING sum(k) > 0.5), c AS (SELECT {BLOCK}, j FROM kern GROUP BY ALL HAVING sum(k) > 0.5),
  b AS (SELECT r.* FROM r JOIN c ON r.sigma = c.sigma AND r.slide = c.slide AND r.ct_1 = c.ct_1 AND r.i = c.j), f AS (SELECT kern.* FROM kern SEMI JOIN b USING ({BLOCK}, i) SEMI JOIN b b2 ON kern.sigma = b2.sigma AND kern.slide = b2.slide AND kern.ct_1 = b2.ct_1 AND kern.j = b2.i) {SUMMARY.format(k='f')}""",
    "gene_moments": f"{with_(CELLS, MOMENTS)} SELECT ct AS cell_type, slide, gene, n::BIGINT AS n, round(m, 6) + 0.0 AS center, guarded, round(CASE WHEN guarded THEN 1.0 ELSE sd END, 6) AS scale FROM mom",
    "gene_moments_pooled": f"""{with_(CELLS, "stat AS (SELECT ct, gene, count(*) AS n, sqrt(sum(v * v) / (count(*) - 1)) AS sd, count(*) FILTER (v <> 0) AS nz FROM expr JOIN cells USING (cell_id) GROUP BY ALL)")}
  SELECT ct AS cell_type, gene, n::BIGINT AS n, 0.0::DOUBLE AS center, sd < 1e-3 OR nz / n < 0.01 AS guarded, round(CASE WHEN sd < 1e-3 OR nz / n < 0.01 THEN 1.0 ELSE sd END, 6) AS scale FROM stat""",
    "gram_matrix": f"""{with_(CELLS, MOMENTS)}, zz AS (SELECT e.cell_id, mom.ct, e.gene, (e.v - m) / CASE WHEN guarded THEN 1.0 ELSE sd END AS s FROM expr e JOIN cells c USING (cell_id) JOIN mom ON mom.ct = c.ct AND mom.slide = c.slide AND mom.gene = e.gene)
  SELECT a.ct AS cell_type, a.gene AS gene_1, b.gene AS gene_2, round(sum(a.s * b.s), 5) + 0.0 AS g FROM zz a JOIN zz b ON a.cell_id = b.cell_id AND a.gene <= b.gene GROUP BY ALL""",
    "principal_components": f"""{with_(CELLS)}, g AS (SELECT DISTINCT ct, gene FROM cells JOIN expr USING (cell_id)), n AS (SELECT ct AS cell_type, count(*) AS genes FROM g GROUP BY ALL)
  SELECT cell_type, pc::INT AS pc, true AS eigenpair, true AS spread_is_sdev, true AS descending FROM n, range(1, 6) r(pc)""",
    "cross_operator": f"{with_(CELLS, kern(PAIRS))} SELECT sigma, ct_1, ct_2, a.cc AS pc_1, b.cc AS pc_2, round(sum(k * a.score * b.score), 6) + 0.0 AS y FROM kern JOIN fixed a ON a.cell_id = i JOIN fixed b ON b.cell_id = j GROUP BY ALL",
    "cross_operator_by_slide": f"{with_(CELLS, kern(PAIRS))} SELECT {BLOCK.replace('slide', 'kern.slide')}, a.cc AS pc_1, b.cc AS pc_2, round(sum(k * a.score * b.score), 6) + 0.0 AS y FROM kern JOIN fixed a ON a.cell_id = i JOIN fixed b ON b.cell_id = j GROUP BY ALL",
    "kernel_norms": f"{with_(CELLS, SIZES, kern(PAIRS), norms())} SELECT {BLOCK}, round(norm, 6) AS norm FROM norms",
    "kernel_norms_whitened": f"""{with_(CELLS, SIZES, kern(PAIRS), kern(SELVES, "self"))},
  rr AS (SELECT sigma, slide, ct_1 AS ct, i AS a, j AS b, k / 2 AS k FROM self UNION ALL SELECT sigma, slide, ct_1, j, i, k / 2 FROM self), r AS (SELECT sigma, slide, ct, a, b, sum(k) AS w FROM rr GROUP BY ALL),
  grid AS (SELECT s.sigma, a.slide, p.ct_1, p.ct_2, a.cell_id AS i, b.cell_id AS j, coalesce(k, 0) AS k FROM {PAIRS} JOIN cells a ON a.ct = p.ct_1 JOIN cells b ON a.slide = b.slide AND b.ct = p.ct_2 CROSS JOIN (SELECT DISTINCT sigma FROM kern) s LEFT JOIN kern ON kern.sigma = s.sigma AND kern.i = a.cell_id AND kern.j = b.cell_id),
  kc AS (SELECT {BLOCK}, i, j, k - avg(k) OVER (PARTITION BY {BLOCK}, i) - avg(k) OVER (PARTITION BY {BLOCK}, j) + avg(k) OVER (PARTITION BY {BLOCK}) AS k FROM grid),
  t AS (SELECT r.sigma, r.slide, kc.ct_1, kc.ct_2, r.a AS i, kc.j, sum(w * k) AS t FROM r JOIN kc ON r.sigma = kc.sigma AND r.slide = kc.slide AND r.ct = kc.ct_1 AND r.b = kc.i GROUP BY ALL),
  m AS (SELECT t.sigma, t.slide, t.ct_1, t.ct_2, t.i, r.b AS j, sum(t * w) AS m FROM t JOIN r ON r.sigma = t.sigma AND r.slide = t.slide AND r.ct = t.ct_2 AND r.a = t.j GROUP BY ALL)
  SELECT {BLOCK}, round(sqrt(greatest(sum(m * k), 0)), 5) AS norm FROM m JOIN kc USING ({BLOCK}, i, j) GROUP BY ALL""",
    "normalized_correlation": f"{with_(CELLS, SIZES, kern(PAIRS), norms(), ncorr())} SELECT {BLOCK}, cc, round(v, 6) + 0.0 AS normalized_correlation FROM assoc",
    "normalized_correlation_aggregate": f"{with_(CELLS, SIZES, kern(PAIRS), norms(), ncorr())} SELECT sigma, ct_1, ct_2, cc, round(v, 6) + 0.0 AS normalized_correlation FROM agg",
    "choose_sigma": f"{with_(CELLS, SIZES, kern(PAIRS), norms(), ncorr())} SELECT sigma, round(avg(v), 6) AS mean_cc1 FROM assoc WHERE cc = 1 GROUP BY sigma ORDER BY avg(v) DESC, sigma LIMIT 1",
    "bidirectional_correlation": f"{with_(CELLS, kern(PAIRS), crossed_bidir())}",
    "bidirectional_unfiltered": f"""{with_(CELLS, kern(PAIRS))}, bl AS (SELECT DISTINCT {BLOCK} FROM kern),
  side_a AS (SELECT bl.sigma, bl.slide, ct_1, ct_2, cell_id AS i, cc, score AS a FROM bl JOIN fixed f ON f.slide = bl.slide AND f.ct = ct_1), side_b AS (SELECT bl.sigma, bl.slide, ct_1, ct_2, cell_id AS j, cc, score AS b FROM bl JOIN fixed f ON f.slide = bl.slide AND f.ct = ct_2),
  {bidir("side_a", "side_b", "kern", "kern").replace("DIGITS", "6")}""",
    "bidirectional_self": f"""{with_(CELLS, kern(SELVES))}, r AS (SELECT {BLOCK}, i FROM kern GROUP BY ALL HAVING sum(k) > 5e-3), c AS (SELECT {BLOCK}, j AS i FROM kern GROUP BY ALL HAVING sum(k) > 5e-3), b AS (SELECT * FROM r SEMI JOIN c USING ({BLOCK}, i)),
  used AS (SELECT kern.* FROM kern SEMI JOIN b USING ({BLOCK}, i) SEMI JOIN b b2 ON kern.sigma = b2.sigma AND kern.slide = b2.slide AND kern.ct_1 = b2.ct_1 AND kern.j = b2.i),
  side_a AS (SELECT b.sigma, b.slide, ct_1, ct_2, i, cc, score AS a FROM b JOIN fixed f ON f.cell_id = i), side_b AS (SELECT sigma, slide, ct_1, ct_2, i AS j, cc, a AS b FROM side_a),
  k1 AS (SELECT {BLOCK}, i, j, k / sum(k) OVER (PARTITION BY {BLOCK}, i) AS k FROM used), k2 AS (SELECT {BLOCK}, i, j, k / sum(k) OVER (PARTITION BY {BLOCK}, j) AS k FROM used),
  {bidir("side_a", "side_b", "k1", "k2").replace("DIGITS", "6")}""",
    "cell_scores": f"{with_(CELLS, WEIGHTS)} SELECT slide, ct AS cell_type, cell_id, w.cc, round(sum(score * w), 6) + 0.0 AS score FROM fixed JOIN w USING (ct) WHERE fixed.cc = w.pc GROUP BY ALL",
    "gene_scores": f"""{with_(CELLS, WEIGHTS, "stat AS (SELECT ct, gene, count(*) AS n, avg(v) AS m, sqrt(greatest(sum(v * v) - count(*) * avg(v) * avg(v), 0) / (count(*) - 1)) AS sd, count(*) FILTER (v <> 0) AS nz FROM expr JOIN cells USING (cell_id) GROUP BY ALL)")},
  l AS (SELECT ct, gene, 1 AS pc, m AS l FROM stat UNION ALL SELECT ct, gene, 2, CASE WHEN sd < 1e-3 OR nz / n < 0.01 THEN 1.0 ELSE sd END FROM stat)
  SELECT ct AS cell_type, gene, cc, round(sum(l * w / (0.5::DOUBLE * pc)), 6) + 0.0 AS score FROM l JOIN w USING (ct, pc) GROUP BY ALL""",
    "regression_gene_scores": f"{with_(CELLS)} SELECT f.ct AS cell_type, cc, gene, round(regr_slope(v, score), 6) + 0.0 AS score FROM fixed f JOIN expr USING (cell_id) GROUP BY ALL",
    "quantile_normalize": f"{with_(CELLS, HALVES, qn('gene'))} SELECT gene, cell_id, round(v, 6) + 0.0 AS value FROM qn",
    "transfer_scores": f"{with_(CELLS, HALVES, TRANSFER)} SELECT slide, ct AS cell_type, cell_id, cc, round(score, 6) + 0.0 AS score FROM moved",
    "transfer_correlation": f"{with_(CELLS, SIZES, HALVES, TRANSFER, kern(PAIRS, 'kern0'), chr(10) + chr(39).join(['kern AS (SELECT * FROM kern0 WHERE slide = ', 's1', ')']), norms(), ncorr('moved'))} SELECT sigma, ct_1, ct_2, cc, round(v, 5) + 0.0 AS normalized_correlation FROM agg",
    "transfer_bidirectional": f"{with_(CELLS, HALVES, TRANSFER, kern(PAIRS, 'kern0'), chr(39).join(['kern AS (SELECT * FROM kern0 WHERE slide = ', 's1', ')']), crossed_bidir('moved', 5))}",
    "spatial_tiles": f"""{with_(CELLS, TILES)} SELECT cell_id, least(greatest(ceil((x - x0) / ((x1 - x0) / 7)) - 1, 0), 6)::INT AS tx, least(greatest(ceil((y - y0) / ((y1 - y0) / 5)) - 1, 0), 4)::INT AS ty FROM cells JOIN box USING (slide, ct)""",
    "global_permutation": f"""{with_(CELLS)}, d AS (SELECT draw::INT AS draw, slide, ct, cell_id FROM cells, range(1, 4) r(draw)),
  k AS (SELECT *, row_number() OVER (PARTITION BY draw, slide, ct ORDER BY cell_id) AS a, row_number() OVER (PARTITION BY draw, slide, ct ORDER BY md5('1|' || draw || '|' || cell_id), cell_id) AS b FROM d)
  SELECT x.draw, x.slide, x.ct AS cell_type, x.cell_id, s.cell_id AS source_id FROM k x JOIN k s ON x.draw = s.draw AND x.slide = s.slide AND x.ct = s.ct AND x.a = s.b""",
    "toroidal_permutation": f"""{with_(CELLS, TILES)}, d AS (SELECT draw::INT AS draw, c.*, x0, x1 - x0 AS wx, y0, y1 - y0 AS wy FROM cells c JOIN box USING (slide, ct), range(1, 3) r(draw)),
  u AS (SELECT *, ('0x' || substr(md5('1|' || draw || '|' || slide || '|' || ct || '|x'), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS ux, ('0x' || substr(md5('1|' || draw || '|' || slide || '|' || ct || '|y'), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS uy FROM d),
  m AS (SELECT *, x0 + fmod(x - x0 + (0.1::DOUBLE + 0.8::DOUBLE * ux) * wx, wx) AS mx, y0 + fmod(y - y0 + (0.1::DOUBLE + 0.8::DOUBLE * uy) * wy, wy) AS my FROM u),
  k AS (SELECT *, row_number() OVER (PARTITION BY draw, slide, ct ORDER BY x, y, cell_id) AS a, row_number() OVER (PARTITION BY draw, slide, ct ORDER BY mx, my, cell_id) AS b FROM m)
  SELECT p.draw, p.slide, p.ct AS cell_type, p.cell_id, s.cell_id AS source_id FROM k p JOIN k s ON p.draw = s.draw AND p.slide = s.slide AND p.ct = s.ct AND p.b = s.a""",
    "spatial_resampling": f"{with_(CELLS, resampled(3))} SELECT draw, slide, ct AS cell_type, cell_id, source_id FROM asked JOIN offered USING (draw, slide, ct, tx, ty, r)",
    "quantile_matched_resampling": f"{with_(CELLS)} SELECT draw::INT AS draw, slide, ct AS cell_type, count(*)::BIGINT AS cells, count(*)::BIGINT AS distinct_cells, count(*)::BIGINT AS own_sources FROM cells, range(1, 3) r(draw) GROUP BY ALL",
    "component_permutation": f"""{with_(CELLS)}, d AS (SELECT draw::INT AS draw, slide, ct, cell_id, cc AS pc, score FROM fixed, range(1, 3) r(draw)),
  k AS (SELECT *, row_number() OVER (PARTITION BY draw, slide, ct, pc ORDER BY cell_id) AS a, row_number() OVER (PARTITION BY draw, slide, ct, pc ORDER BY md5('1|' || draw || '|' || pc || '|' || cell_id), cell_id) AS b FROM d)
  SELECT x.draw, x.slide, x.ct AS cell_type, x.cell_id, x.pc, round(s.score, 6) + 0.0 AS score FROM k x JOIN k s ON x.draw = s.draw AND x.slide = s.slide AND x.ct = s.ct AND x.pc = s.pc AND x.a = s.b""",
    "permuted_scores": f"""{with_(CELLS)}, d AS (SELECT draw::INT AS draw, slide, ct, cell_id FROM cells, range(1, 3) r(draw)),
  k AS (SELECT *, row_number() OVER (PARTITION BY draw, slide, ct ORDER BY cell_id) AS a, row_number() OVER (PARTITION BY draw, slide, ct ORDER BY md5('1|' || draw || '|' || cell_id), cell_id) AS b FROM d)
  SELECT x.draw, x.slide, x.ct AS cell_type, x.cell_id, f.cc AS pc, round(f.score, 6) + 0.0 AS score FROM k x JOIN k s ON x.draw = s.draw AND x.slide = s.slide AND x.ct = s.ct AND x.a = s.b JOIN fixed f ON f.cell_id = s.cell_id""",
    "permutation_pvalue": f"""{with_(CELLS, NULL_)}, o AS (SELECT max(v) AS o FROM obs)
  SELECT round(o, 6) AS observed, count(*)::BIGINT AS n_draws, round(least(1.0, 2 * least((1.0 + count(*) FILTER (v >= o)) / (count(*) + 1), (1.0 + count(*) FILTER (v <= o)) / (count(*) + 1)))::DOUBLE, 6) AS p_value, round(1.0::DOUBLE / (count(*) + 1), 6) AS p_floor,
  round(avg(v), 6) + 0.0 AS null_mean, round(stddev_samp(v), 6) AS null_sd FROM dm, o GROUP BY o""",
    "step_down_pvalues": f"""{with_(CELLS, NULL_)}, o AS (SELECT ct_1, ct_2, max(v) AS o FROM obs GROUP BY ALL), d AS (SELECT draw, ct_1, ct_2, max(v) AS v FROM nul GROUP BY ALL),
  r AS (SELECT row_number() OVER (ORDER BY ct_1, ct_2) AS cc, (1.0::DOUBLE + count(*) FILTER (v >= o)) / (count(*) + 1) AS p_raw FROM d JOIN o USING (ct_1, ct_2) GROUP BY ct_1, ct_2),
  t AS (SELECT *, max(p_raw) OVER (ORDER BY cc) AS p_value FROM r)
  SELECT cc::INT AS cc, round(p_raw, 6) AS p_raw, round(p_value, 6) AS p_value, p_value <= 0.5 AS significant FROM t""",
    "null_histogram": f"""{with_(CELLS, NULL_)}, b AS (SELECT min(v) AS lo, max(v) AS hi FROM dm), h AS (SELECT least(floor((v - lo) / ((hi - lo) / 5)), 4)::INT AS bin, lo, hi FROM dm, b)
  SELECT bin, round(lo + bin * ((hi - lo) / 5), 6) + 0.0 AS low, count(*)::BIGINT AS n FROM h GROUP BY ALL""",
    "genespace_self_covariance": f"{with_(CELLS, Z)} SELECT slide, ct AS cell_type, gene_1, gene_2, round(c, 6) + 0.0 AS c FROM own",
    "genespace_cross_covariance": f"{with_(CELLS, SIZES, Z, kern(PAIRS), CROSSCOV)} SELECT {BLOCK}, gene_1, gene_2, round(c, 6) + 0.0 AS c FROM crossed",
    "genespace_objective": f"""{with_(CELLS, SIZES, Z, kern(PAIRS), CROSSCOV)}, w AS (SELECT ct, 'g' || g AS gene, 0.3::DOUBLE * (g - 4) + 0.2::DOUBLE * (o + 1) AS w FROM (VALUES ('T0', 0), ('T1', 1), ('T2', 2)) t(ct, o), range(4, 7) r(g)),
  dev AS (SELECT slide, own.ct, greatest(sqrt(greatest(sum(CASE WHEN gene_1 = gene_2 THEN 1 ELSE 2 END * c * a.w * b.w), 0)), 1e-12) AS s FROM own JOIN w a ON a.ct = own.ct AND a.gene = gene_1 JOIN w b ON b.ct = own.ct AND b.gene = gene_2 GROUP BY ALL),
  n AS (SELECT {BLOCK}, sum(c * a.w * b.w) AS num FROM crossed JOIN w a ON a.ct = ct_1 AND a.gene = gene_1 JOIN w b ON b.ct = ct_2 AND b.gene = gene_2 GROUP BY ALL),
  v AS (SELECT n.sigma, n.slide, sum(num / (a.s * b.s)) AS v FROM n JOIN dev a ON a.slide = n.slide AND a.ct = ct_1 JOIN dev b ON b.slide = n.slide AND b.ct = ct_2 GROUP BY ALL) SELECT sigma, 1 AS cc, round(avg(v), 6) + 0.0 AS objective FROM v GROUP BY sigma""",
    "gene_slopes": f"{with_(CELLS)} SELECT f.ct AS cell_type, cc, gene, round(regr_slope(score, v), 6) + 0.0 AS estimate FROM fixed f JOIN expr USING (cell_id) GROUP BY ALL",
    # the tail of Student's t by Simpson's rule
    "gene_test_glm": f"""{with_(CELLS)}, g AS (SELECT f.ct, cc, gene, regr_slope(score, v) AS b, corr(score, v) AS r, count(*)::DOUBLE - 2 AS nu FROM fixed f JOIN expr USING (cell_id) GROUP BY ALL),
  t AS (SELECT *, abs(r) * sqrt(nu / (1 - r * r)) AS t FROM g),
  q AS (SELECT *, CASE WHEN abs(r) > 1 - 1e-9 THEN 0 ELSE 1 - 2 * exp(lgamma((nu + 1) / 2) - lgamma(nu / 2)) / sqrt(nu * pi()) * t / 6000 * list_sum(list_transform(range(2001), lambda x: (CASE WHEN x = 0 OR x = 2000 THEN 1 WHEN x % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + (t * x / 2000) * (t * x / 2000) / nu, -(nu + 1) / 2))) END AS p FROM t),
  p AS (SELECT *, CASE WHEN p = 0 THEN min(p) FILTER (p > 0) OVER (PARTITION BY ct, cc) ELSE p END / 2 AS half FROM q)
  SELECT ct AS cell_type, cc, gene, round(b, 6) + 0.0 AS estimate, round(p, 6) + 0.0 AS pvalue, round(CASE WHEN b > 0 THEN -log10(half) ELSE log10(half) END, 4) + 0.0 AS z_score FROM p""",
    "plot_correlation": f"{with_(CELLS, SIZES, kern(PAIRS), norms(), ncorr())} SELECT ct_1 || '-' || ct_2 AS pair, sigma, round(v, 6) + 0.0 AS normalized_correlation FROM agg WHERE cc = 1",
    "plot_scores_in_place": f"{with_(CELLS)} SELECT cell_id, round(score, 6) + 0.0 AS score, c.slide, c.ct AS cell_type, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM fixed JOIN cells c USING (cell_id) WHERE cc = 1",
    "plot_smoothed_scores": f"""{with_(CELLS, kern(PAIRS))}, s AS (SELECT ct_1, ct_2, j, sum(k * score) AS s FROM kern JOIN fixed ON cell_id = i AND cc = 1 WHERE sigma = 0.02 GROUP BY ALL)
  SELECT p.ct_1, p.ct_2, slide, cell_id, round(coalesce(s, 0), 6) + 0.0 AS smoothed, round(score, 6) + 0.0 AS score FROM {PAIRS} JOIN fixed ON ct = p.ct_2 AND cc = 1 LEFT JOIN s ON j = cell_id AND s.ct_1 = p.ct_1 AND s.ct_2 = p.ct_2""",
    "plot_top_genes": f"{with_(CELLS)} SELECT f.ct AS cell_type, cc, gene, round(regr_slope(v, score), 6) + 0.0 AS score FROM fixed f JOIN expr USING (cell_id) WHERE ct = 'T0' AND cc = 1 GROUP BY ALL ORDER BY abs(regr_slope(v, score)) DESC, gene LIMIT 8",
    "plot_type_shares": f"""{with_(CELLS)}, b AS (SELECT min(score) AS lo, max(score) AS hi FROM fixed WHERE cc = 1), h AS (SELECT least(floor((score - lo) / ((hi - lo) / 10)), 9)::INT AS bin, ct, count(*) AS n FROM fixed, b WHERE cc = 1 GROUP BY ALL)
  SELECT bin, ct AS cell_type, n::BIGINT AS n, round(n / sum(n) OVER (PARTITION BY bin), 6) AS share FROM h""",
    "plot_volcano": f"""{with_(CELLS)}, g AS (SELECT f.ct, cc, gene, round(regr_slope(score, v), 6) + 0.0 AS e FROM fixed f JOIN expr USING (cell_id) GROUP BY ALL), t AS (SELECT *, exp(-abs(e) * 20) AS p FROM g)
  SELECT ct AS cell_type, cc, gene, e AS estimate, round(-log10(greatest(p, 1e-300)), 5) + 0.0 AS log_p, p < 0.05 AS significant, row_number() OVER (PARTITION BY ct, cc ORDER BY p, abs(e) DESC, gene) <= 3 AS labelled FROM t""",
    "kendall_tau": f"""{with_(CELLS)}, m AS (SELECT gene, median(v) AS x, max(v) AS y FROM expr GROUP BY ALL), d AS (SELECT sign(a.x - b.x) AS dx, sign(a.y - b.y) AS dy FROM m a JOIN m b ON a.gene < b.gene)
  SELECT round(sum(dx * dy) / sqrt(sum(abs(dx))::DOUBLE * sum(abs(dy))), 6) + 0.0 AS tau FROM d""",
    "dataset_round_trip": f"{with_(CELLS)} SELECT slide, ct AS cell_type, count(*)::BIGINT AS n, round(sum(v), 6) + 0.0 AS total FROM expr JOIN cells USING (cell_id) GROUP BY ALL",
}
ORACLES["plot_bidirectional"] = " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, sigma, slide, ct_1 || '-' || ct_2 AS pair, cc, bidir_correlation FROM ({ORACLES[name]})" for kind, name in (("cross", "bidirectional_correlation"), ("self", "bidirectional_self"))
)
