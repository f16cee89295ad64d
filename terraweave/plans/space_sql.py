"""SQL counterparts of space_queries."""

from __future__ import annotations

from ..functions import lexicon as lx, names as nm
from ..operators.constraints import INFERABLE, PARAMS
from . import sql_parts as P
from ..sources.writers import TYPE_COLOR
from .tables import LINE_TYPES
from .text_sql import _pick as pick

q = P.q
lst = lambda values: ", ".join(map(q, values))
rnd = lambda *cols: ", ".join(f"round({c}, 4) AS {c}" for c in cols)

# -- derived inputs, as in tables.py -------------------------------------------

SCALE = "(6371.0 * pi() / 180.0)"
COS0 = "cos(radians(40.7128))"

ENT = f"""
ent AS (
  SELECT s_suppkey AS ord, 's' || s_suppkey AS entity_id, s_name AS name, s_name AS canonical_name, 'real' AS type,
    CASE WHEN s_suppkey % 10 <> 9 THEN round(40.7128 + ((s_suppkey * 37) % 201 - 100) / 20.0::DOUBLE, 4) END AS latitude,
    CASE WHEN s_suppkey % 10 <> 9 THEN round(-74.006 + ((s_suppkey * 73) % 301 - 150) / 20.0::DOUBLE, 4) END AS longitude,
    s_suppkey % 5 AS mention_count FROM supplier
  UNION ALL
  SELECT c_custkey + 1000000000, 'c' || c_custkey, c_name, c_name, 'fictional', NULL, NULL, c_custkey % 4 FROM customer),
km AS (SELECT *, CASE WHEN latitude IS NOT NULL THEN (longitude + 74.006) * {COS0} * {SCALE} END AS x_km,
                 CASE WHEN latitude IS NOT NULL THEN (latitude - 40.7128) * {SCALE} END AS y_km FROM ent)"""

_cust = lambda c: f"'Customer#' || lpad(({c})::VARCHAR, 9, '0')"
_supp = lambda c: f"'Supplier#' || lpad(({c})::VARCHAR, 9, '0')"

REL = f"""
rel AS (
  SELECT *, weight AS confidence FROM (
    SELECT l_orderkey * 8 + l_linenumber AS rel_ord,
      concat_ws('_', 'r', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS relation_id,
      {pick(LINE_TYPES, 'l_partkey + l_linenumber')} AS relation_type,
      CASE WHEN l_linenumber % 4 = 3 THEN {_supp('l_suppkey')} ELSE {_cust('o_custkey')} END AS entity_1,
      CASE WHEN {pick(LINE_TYPES, 'l_partkey + l_linenumber')} = 'on_coast' AND l_linenumber % 2 = 0 THEN NULL
           WHEN l_linenumber % 4 = 0 THEN {_cust('l_partkey')} ELSE {_supp('l_suppkey + l_linenumber')} END AS entity_2,
      round(0.5 + l_discount * 5, 3) AS weight,
      CASE WHEN l_quantity < 3 THEN 0.0::DOUBLE WHEN l_quantity <= 45 THEN l_quantity END AS distance_value,
      CASE l_returnflag WHEN 'R' THEN 'miles' WHEN 'A' THEN 'km' END AS distance_unit,
      CASE WHEN l_linestatus = 'F' AND l_linenumber % 4 = 3 THEN 'geographic_knowledge'
           WHEN l_linenumber = 5 THEN 'anchor_geographic' ELSE 'model' END AS extraction_method
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"""


def haversine(a, b, c, d):
    return (f"(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * "
            f"cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))")


AXIS = "('north_of', 'south_of', 'east_of', 'west_of')"
SPEC = f"""{ENT}, {REL},
pairs AS (SELECT r.*, a.entity_id AS ai, b.entity_id AS bi, a.type AS aty, b.type AS bty, a.latitude AS ala,
    a.longitude AS alo, b.latitude AS bla, b.longitude AS blo, b.x_km AS bkx, b.y_km AS bky
  FROM rel r JOIN km a ON r.entity_1 = a.canonical_name LEFT JOIN km b ON r.entity_2 = b.canonical_name
  WHERE (r.entity_2 IS NULL OR b.entity_id IS NOT NULL) AND (b.entity_id IS NULL OR a.entity_id <> b.entity_id)),
adm AS (SELECT * FROM pairs WHERE
    NOT coalesce(extraction_method = 'geographic_knowledge' AND aty = 'real' AND bty = 'real' AND ala IS NOT NULL AND bla IS NOT NULL, false)
    AND (relation_type <> 'in_region' OR (bkx IS NOT NULL AND NOT coalesce(
      CASE WHEN aty = 'real' AND bty = 'real' THEN ala <> 0 AND bla <> 0 AND {haversine('ala', 'alo', 'bla', 'blo')} > 500
           WHEN aty = 'fictional' AND bty = 'real' THEN sqrt(bkx * bkx + bky * bky) > 500 END, false)))),
spec AS (SELECT 'c_' || CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END AS constraint_id, * FROM (
  SELECT row_number() OVER (ORDER BY rel_ord, relation_id) AS n, relation_type AS type, ai AS e1, bi AS e2,
    CASE WHEN relation_type = 'co_occurrence' THEN 0.1::DOUBLE ELSE weight END AS weight, relation_id AS source_relation_id,
    CASE WHEN relation_type IN {AXIS} OR relation_type = 'across' THEN 1.0::DOUBLE END AS epsilon_km,
    CASE WHEN relation_type IN ('near', 'co_occurrence') THEN 10.0::DOUBLE WHEN relation_type = 'across' THEN 15.0::DOUBLE END AS d_near_km,
    CASE WHEN relation_type = 'far' THEN 50.0::DOUBLE END AS d_far_km,
    CASE WHEN relation_type = 'distance_approx' THEN round(coalesce(nullif(distance_value, 0), 10.0::DOUBLE) *
      CASE WHEN distance_unit = 'miles' THEN 1.60934::DOUBLE ELSE 1.0::DOUBLE END, 2) END AS target_d_km,
    CASE WHEN relation_type = 'distance_approx' THEN 5.0::DOUBLE END AS sigma_km,
    CASE WHEN relation_type = 'on_coast' THEN 0.0::DOUBLE END AS coast_x_km,
    CASE WHEN relation_type = 'in_region' THEN bkx END AS centroid_x_km,
    CASE WHEN relation_type = 'in_region' THEN bky END AS centroid_y_km,
    CASE WHEN relation_type = 'in_region' THEN 20.0::DOUBLE END AS radius_km
  FROM adm)),
latent AS (SELECT entity_id, canonical_name AS name FROM ent WHERE NOT (type = 'real' AND latitude IS NOT NULL)),
weak AS (SELECT l.entity_id, l.name, count(e.e) AS n_constraints FROM latent l LEFT JOIN (
    SELECT e1 AS e FROM spec WHERE type IN ({lst(INFERABLE)}) UNION ALL
    SELECT e2 FROM spec WHERE type IN ({lst(INFERABLE)}) AND e2 IS NOT NULL) e ON e.e = l.entity_id
  GROUP BY 1, 2 HAVING count(e.e) < 12)"""

_h = lambda v: f"pow(greatest(0.0, {v}), 2)"


def penalty(energy: bool) -> str:
    d = "sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))"
    c = lambda p, v: f"coalesce({p}, {v})"
    eps, near = c("epsilon_km", 1.0), c("d_near_km", 10.0)
    out = f"""CASE type WHEN 'north_of' THEN {_h(f'y2 + {eps} - y1')} WHEN 'south_of' THEN {_h(f'y1 - (y2 - {eps})')}
      WHEN 'east_of' THEN {_h(f'x2 + {eps} - x1')} WHEN 'west_of' THEN {_h(f'x1 - (x2 - {eps})')}
      WHEN 'near' THEN {_h(f'{d} - {near}')} WHEN 'co_occurrence' THEN {_h(f'{d} - {near}')}
      WHEN 'far' THEN {_h(f"{c('d_far_km', 50.0)} - {d}")}
      WHEN 'distance_approx' THEN pow({d} - {c('target_d_km', 10.0)}, 2) / (2.0 * pow({c('sigma_km', 5.0)}, 2)) """
    if energy:
        out += f"""WHEN 'across' THEN {_h(f"{d} - {c('d_near_km', 15.0)}")} + 0.3 * {_h(f'x2 + {eps} - x1')}
      WHEN 'in_region' THEN {_h(f"sqrt(pow(x1 - {c('centroid_x_km', 'x2')}, 2) + pow(y1 - {c('centroid_y_km', 'y2')}, 2)) - {c('radius_km', 20.0)}")} """
    else:
        out += f"WHEN 'across' THEN {_h(f'{d} - {near}')} "
    return out + "ELSE 0.0 END"


ENERGY = f"""{SPEC},
pos AS (SELECT entity_id, round(x_km, 4) AS x, round(y_km, 4) AS y FROM km WHERE type = 'real' AND latitude IS NOT NULL
  UNION ALL SELECT entity_id, ((n * 7) % 120 - 60)::DOUBLE, ((n * 11) % 90 - 45)::DOUBLE FROM (
    SELECT entity_id, regexp_extract(entity_id, '(\\d+)', 1)::BIGINT AS n FROM latent)),
placed AS (SELECT s.*, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM spec s JOIN pos a ON a.entity_id = s.e1
  JOIN pos b ON b.entity_id = s.e2 WHERE type IN ({lst(INFERABLE)})),
en AS (SELECT constraint_id, type, weight, {penalty(True)} AS pen FROM placed)"""



def uniform(text: str, nth: int = 0) -> str:
    """(0, 1) from 40 bits of the MD5 digest of a text."""
    return f"((('0x' || substr(md5({text}), {1 + 10 * nth}, 10))::BIGINT + 0.5::DOUBLE) / 1099511627776.0::DOUBLE)"


def normal(text: str) -> str:
    return f"(sqrt(-2.0::DOUBLE * ln({uniform(text)})) * cos(2.0::DOUBLE * pi() * {uniform(text, 1)}))"


_params = ", ".join(PARAMS)
# sweep(entity_id, chain_id, moves, x, y, won): one sweep of every latent entity from its starting position
SWEEP = f"""{SPEC},
few AS (SELECT l.entity_id FROM latent l LEFT JOIN (
    SELECT e1 AS e FROM spec WHERE type IN ({lst(INFERABLE)}) UNION ALL
    SELECT e2 FROM spec WHERE type IN ({lst(INFERABLE)}) AND e2 IS NOT NULL) e ON e.e = l.entity_id GROUP BY 1 HAVING count(e.e) < 1),
ids AS (SELECT entity_id FROM latent WHERE entity_id NOT IN (SELECT entity_id FROM few)),
fixed AS (SELECT entity_id, round(x_km, 4) AS x, round(y_km, 4) AS y FROM km WHERE type = 'real' AND latitude IS NOT NULL),
ends AS (SELECT entity_id, NULL::DOUBLE AS x, NULL::DOUBLE AS y, true AS free FROM ids UNION ALL SELECT entity_id, x, y, false FROM fixed),
term AS (SELECT s.*, a.free AS f1, b.free AS f2, a.x AS fx1, a.y AS fy1, b.x AS fx2, b.y AS fy2 FROM (
    SELECT type, e1, e2, {_params}, sum(weight) AS weight FROM spec WHERE type IN ({lst(INFERABLE)})
      AND (e2 IS NOT NULL OR (type = 'in_region' AND (centroid_x_km IS NOT NULL OR centroid_y_km IS NOT NULL)))
      AND e1 NOT IN (SELECT entity_id FROM few) AND (e2 IS NULL OR e2 NOT IN (SELECT entity_id FROM few)) GROUP BY ALL) s
  JOIN ends a ON a.entity_id = s.e1 LEFT JOIN ends b ON b.entity_id = s.e2
  WHERE (a.free OR coalesce(b.free, false)) AND (s.e2 IS NULL OR b.entity_id IS NOT NULL)),
link AS (SELECT DISTINCT unnest([e1, e2]) AS a, unnest([e2, e1]) AS b FROM term WHERE f1 AND f2 AND e1 <> e2),
turn AS (SELECT entity_id, -ln({uniform("concat_ws(':', 42, 'turn', 0, entity_id)")}) AS h FROM ids),
rest AS (SELECT DISTINCT a AS entity_id FROM link JOIN turn s ON s.entity_id = a JOIN turn t ON t.entity_id = b WHERE (t.h, b) < (s.h, a)),
box AS (SELECT min(x) FILTER (WHERE near) - 30 AS x0, max(x) FILTER (WHERE near) + 30 AS x1, min(y) FILTER (WHERE near) - 30 AS y0,
    max(y) FILTER (WHERE near) + 30 AS y1 FROM (SELECT *, sqrt(x * x + y * y) <= 300 AS near FROM fixed)),
at0 AS (SELECT entity_id, c AS chain_id, entity_id NOT IN (SELECT entity_id FROM rest) AS moves,
    x0 + (x1 - x0) * {uniform("concat_ws(':', 42, 'start', 'x', entity_id)")} + 10.0 * {normal("concat_ws(':', 42, 'jitter', 'x', c, entity_id)")} AS x,
    y0 + (y1 - y0) * {uniform("concat_ws(':', 42, 'start', 'y', entity_id)")} + 10.0 * {normal("concat_ws(':', 42, 'jitter', 'y', c, entity_id)")} AS y,
    concat_ws(':', 42, 'step', 1, c, entity_id) AS luck FROM ids, box, range(4) r(c)),
at1 AS (SELECT *, 10.0 * sqrt(-2.0::DOUBLE * ln({uniform("luck")})) AS reach, 2.0::DOUBLE * pi() * {uniform("luck", 1)} AS angle FROM at0),
at2 AS (SELECT *, CASE WHEN moves THEN x + reach * cos(angle) ELSE x END AS nx, CASE WHEN moves THEN y + reach * sin(angle) ELSE y END AS ny FROM at1),
met AS (SELECT t.*, c.chain_id, CASE WHEN a.moves THEN e1 WHEN b.moves THEN e2 END AS mover,
    coalesce(a.x, fx1) AS ox1, coalesce(a.y, fy1) AS oy1, coalesce(b.x, fx2, 0.0) AS ox2, coalesce(b.y, fy2, 0.0) AS oy2,
    coalesce(a.nx, fx1) AS nx1, coalesce(a.ny, fy1) AS ny1, coalesce(b.nx, fx2, 0.0) AS nx2, coalesce(b.ny, fy2, 0.0) AS ny2
  FROM term t CROSS JOIN (SELECT range AS chain_id FROM range(4)) c
  LEFT JOIN at2 a ON a.entity_id = t.e1 AND a.chain_id = c.chain_id LEFT JOIN at2 b ON b.entity_id = t.e2 AND b.chain_id = c.chain_id),
was AS (SELECT mover, chain_id, sum(weight * {penalty(True)}) AS e FROM (SELECT *, ox1 AS x1, oy1 AS y1, ox2 AS x2, oy2 AS y2 FROM met
  WHERE mover IS NOT NULL) GROUP BY ALL),
will AS (SELECT mover, chain_id, sum(weight * {penalty(True)}) AS e FROM (SELECT *, nx1 AS x1, ny1 AS y1, nx2 AS x2, ny2 AS y2 FROM met
  WHERE mover IS NOT NULL) GROUP BY ALL),
gain AS (SELECT was.mover, was.chain_id, will.e - was.e AS d FROM was JOIN will ON was.mover = will.mover AND was.chain_id = will.chain_id),
judged AS (SELECT at2.*, moves AND (coalesce(d, 0) < 0 OR {uniform("luck", 2)} < exp(-greatest(coalesce(d, 0), 0))) AS won
  FROM at2 LEFT JOIN gain ON mover = entity_id AND gain.chain_id = at2.chain_id),
sweep AS (SELECT entity_id, chain_id, moves, won, CASE WHEN won THEN nx ELSE x END AS x, CASE WHEN won THEN ny ELSE y END AS y FROM judged)"""

REAL = "real AS (SELECT * FROM ent WHERE type = 'real' AND latitude IS NOT NULL AND mention_count >= 2)"
_edge_text = "a_name || ' → ' || b_name || ': ' || round(km, 0)::BIGINT || ' km'"
GEO = f"""{ENT}, {REL}, {REAL},
gp AS (SELECT DISTINCT least(entity_1, entity_2) AS a_name, greatest(entity_1, entity_2) AS b_name FROM rel
  WHERE extraction_method NOT IN ('geographic_knowledge', 'transitive_geographic', 'anchor_geographic')
    AND entity_2 IS NOT NULL AND entity_1 <> entity_2),
gk AS (SELECT a_name, b_name, {haversine('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS km,
    CASE WHEN a.latitude > b.latitude THEN 'north_of' ELSE 'south_of' END AS ns,
    CASE WHEN a.longitude > b.longitude THEN 'east_of' ELSE 'west_of' END AS ew
  FROM gp JOIN real a ON a.canonical_name = a_name JOIN real b ON b.canonical_name = b_name),
ge AS (SELECT ns AS relation_type, a_name AS entity_1, b_name AS entity_2, replace(ns, '_of', '') AS direction, km,
    replace(ns, '_', ' ') || ': ' || {_edge_text} AS source_text FROM gk
  UNION ALL SELECT ew, a_name, b_name, replace(ew, '_of', ''), km, replace(ew, '_', ' ') || ': ' || {_edge_text} FROM gk
  UNION ALL SELECT 'distance_approx', a_name, b_name, NULL, km, 'distance: ' || {_edge_text} FROM gk),
geo AS (SELECT relation_type, entity_1, entity_2, direction, round(km, 1) AS distance_value, 'km' AS distance_unit,
    0.95::DOUBLE AS weight, 0.05::DOUBLE AS uncertainty, substr(source_text, 1, 200) AS source_text,
    'geographic_knowledge' AS extraction_method FROM ge),
ap AS (SELECT DISTINCT entity_1 AS a, entity_2 AS b FROM rel WHERE extraction_method NOT IN ('geographic_knowledge', 'anchor_geographic')),
atab AS (SELECT a, b, x.type AS ta, y.type AS tb, rx.canonical_name IS NOT NULL AS ra, ry.canonical_name IS NOT NULL AS rb
  FROM ap JOIN ent x ON x.canonical_name = a JOIN ent y ON y.canonical_name = b
  LEFT JOIN real rx ON rx.canonical_name = a LEFT JOIN real ry ON ry.canonical_name = b),
fr AS (SELECT a, b FROM atab WHERE ta = 'fictional' AND tb = 'real' AND rb
       UNION SELECT b, a FROM atab WHERE tb = 'fictional' AND ta = 'real' AND ra),
ff AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM atab WHERE ta = 'fictional' AND tb = 'fictional'),
anchor AS (SELECT 'near' AS relation_type, a AS entity_1, b AS entity_2, 50.0::DOUBLE AS distance_value, 0.8::DOUBLE AS weight,
    0.2::DOUBLE AS uncertainty, a || ' near ' || b || ' (anchor radius 50.0 km)' AS source_text FROM fr
  UNION ALL SELECT 'near', a, b, 50.0::DOUBLE, 0.7::DOUBLE, 0.3::DOUBLE, a || ' near ' || b || ' (co-occurring fictional entities)' FROM ff)"""

DRAWS = """
draws AS (SELECT vec_id % 4 AS chain_id, vec_id AS sample_id, 'v' || j AS entity_id,
    embedding[2 * j + 1]::DOUBLE * 100 AS x, embedding[2 * j + 2]::DOUBLE * 100 AS y
  FROM embeddings, (SELECT unnest(range(0, 32)) AS j))"""

CELLS = f"""{DRAWS},
span AS (SELECT entity_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM draws GROUP BY 1),
cells AS (SELECT entity_id, CASE WHEN x1 = x0 THEN 0 ELSE least(floor((x - x0) / (x1 - x0) * 20), 19) END::BIGINT AS cell_x,
    CASE WHEN y1 = y0 THEN 0 ELSE least(floor((y - y0) / (y1 - y0) * 20), 19) END::BIGINT AS cell_y FROM draws JOIN span USING (entity_id)),
grid AS (SELECT entity_id, cell_x, cell_y, count(*) AS n FROM cells GROUP BY 1, 2, 3)"""

_kernel = lambda v: (f"CASE WHEN h_{v} IS NULL THEN (to_{v} = cell_{v})::INT::DOUBLE ELSE "
                     f"exp(-0.5::DOUBLE * pow((to_{v} - cell_{v}) / h_{v}, 2)) END")
SMOOTH = f"""{CELLS},
scale AS (SELECT entity_id, CASE WHEN max(x) > min(x) THEN pow(count(*), -1.0::DOUBLE / 6) * stddev_samp(x) * 20 / (max(x) - min(x)) END AS h_x,
    CASE WHEN max(y) > min(y) THEN pow(count(*), -1.0::DOUBLE / 6) * stddev_samp(y) * 20 / (max(y) - min(y)) END AS h_y
  FROM draws GROUP BY 1 HAVING count(*) >= 10),
spread AS (SELECT entity_id, to_x AS cell_x, to_y AS cell_y, sum(n * {_kernel('x')} * {_kernel('y')}) AS m
  FROM grid JOIN scale USING (entity_id), range(20) a(to_x), range(20) b(to_y) GROUP BY ALL),
smooth AS (SELECT entity_id, cell_x, cell_y, m / sum(m) OVER (PARTITION BY entity_id) AS mass FROM spread)"""

_ncol = lambda p: f"{ {'d_near_km': 'p_size::DOUBLE', 'target_d_km': 'CASE WHEN p_size > 5 THEN p_size::DOUBLE END'}.get(p, 'NULL::DOUBLE')} AS {p}"
PARTC = f"""
pc AS (SELECT p_partkey, {pick(LINE_TYPES, 'p_size + p_partkey')} AS type,
    CASE WHEN p_partkey % 5 = 0 THEN 'f' || (p_size % 8) ELSE 'v' || (p_partkey % 34) END AS e1,
    CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 7 <= 2 THEN 'f' || (p_partkey % 25)
         ELSE 'v' || ((p_partkey * 3 + 1) % 33) END AS e2, {', '.join(map(_ncol, PARAMS))} FROM part),
fx AS (SELECT 'f' || n_nationkey AS entity_id, n_nationkey * 2.0::DOUBLE - 25 AS x, n_regionkey * 5.0::DOUBLE - 10 AS y FROM nation)"""


def scores(extra: str, name: str) -> str:
    return f"""{name}_p AS (SELECT s.sample_id, c.*, coalesce(f1.x, d1.x) AS x1, coalesce(f1.y, d1.y) AS y1,
    coalesce(f2.x, d2.x, f1.x, d1.x) AS x2, coalesce(f2.y, d2.y, f1.y, d1.y) AS y2
  FROM (SELECT DISTINCT sample_id FROM sub) s CROSS JOIN pc c LEFT JOIN fx f1 ON f1.entity_id = c.e1
  LEFT JOIN fx f2 ON f2.entity_id = c.e2 LEFT JOIN sub d1 ON d1.sample_id = s.sample_id AND d1.entity_id = c.e1
  LEFT JOIN sub d2 ON d2.sample_id = s.sample_id AND d2.entity_id = c.e2
  WHERE (c.e2 IS NOT NULL OR c.type = 'on_coast') {extra}),
{name} AS (SELECT sample_id, coalesce(avg(CASE WHEN {penalty(False)} < 0.1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
    FILTER (WHERE x1 IS NOT NULL), 1.0::DOUBLE) AS score FROM {name}_p GROUP BY 1)"""


SCORES = f"""{DRAWS}, {PARTC},
sub AS (SELECT * FROM draws),
{scores('', 'sc')}, {scores(f'AND c.type IN ({lst(INFERABLE)})', 'se')}"""

RHAT = f"""{DRAWS.strip()},
chained AS (SELECT *, row_number() OVER (PARTITION BY entity_id, chain_id ORDER BY sample_id) - 1 AS pos FROM draws),
clen AS (SELECT entity_id, chain_id, count(*) AS n FROM draws GROUP BY 1, 2),
mlen AS (SELECT entity_id, min(n) AS n, count(*) AS m FROM clen GROUP BY 1),
cst AS (SELECT entity_id, chain_id, n, m, avg(x) AS ax, avg(y) AS ay, var_samp(x) AS vx, var_samp(y) AS vy
  FROM chained JOIN mlen USING (entity_id) WHERE pos < n GROUP BY 1, 2, 3, 4),
rhat AS (SELECT entity_id, CASE WHEN m >= 2 AND n >= 2 AND avg(vx) > 0 THEN sqrt(((n - 1) / n * avg(vx) + var_samp(ax)) / avg(vx)) END AS r_hat_x,
    CASE WHEN m >= 2 AND n >= 2 AND avg(vy) > 0 THEN sqrt(((n - 1) / n * avg(vy) + var_samp(ay)) / avg(vy)) END AS r_hat_y
  FROM cst GROUP BY entity_id, m, n)"""

ESS = """
ser AS (SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY chain_id, sample_id) - 1 AS i,
    count(*) OVER (PARTITION BY entity_id) AS n, x - avg(x) OVER (PARTITION BY entity_id) AS x,
    y - avg(y) OVER (PARTITION BY entity_id) AS y FROM draws),
lagsum AS (SELECT a.entity_id, b.i - a.i AS lag, sum(a.x * b.x) AS sx, sum(a.y * b.y) AS sy, any_value(a.n) AS n
  FROM ser a JOIN ser b ON a.entity_id = b.entity_id AND b.i >= a.i GROUP BY 1, 2),
pair AS (SELECT l.entity_id, l.lag - l.lag % 2 AS i, sum(l.sx / z.sx) AS px, sum(l.sy / z.sy) AS py, any_value(l.n) AS n, count(*) AS k
  FROM lagsum l JOIN lagsum z ON z.entity_id = l.entity_id AND z.lag = 0 GROUP BY 1, 2 HAVING count(*) = 2),
stop AS (SELECT entity_id, min(i) FILTER (WHERE px < 0) AS ex, min(i) FILTER (WHERE py < 0) AS ey FROM pair GROUP BY 1),
ess AS (SELECT entity_id, n / greatest(1.0, 2 * sum(CASE WHEN ex IS NULL OR i < ex THEN px ELSE 0.0 END) - 1) AS ess_x,
    n / greatest(1.0, 2 * sum(CASE WHEN ey IS NULL OR i < ey THEN py ELSE 0.0 END) - 1) AS ess_y
  FROM pair JOIN stop USING (entity_id) GROUP BY entity_id, n)"""

_few = lambda *cols: ", ".join(f"CASE WHEN count(*) >= 4 THEN {v} END AS {name}" for name, v in cols)
MOMENTS = f"""mom AS (SELECT entity_id, count(*) AS n, {_few(('mean_x', 'avg(x)'), ('mean_y', 'avg(y)'), ('std_x', 'stddev_pop(x)'),
  ('std_y', 'stddev_pop(y)'))} FROM draws GROUP BY 1)"""
ELLIPSE = f"""cov AS (SELECT entity_id, {_few(('center_x', 'avg(x)'), ('center_y', 'avg(y)'), ('a', 'var_samp(x)'), ('b', 'var_samp(y)'),
  ('c', 'covar_samp(x, y)'))} FROM draws GROUP BY 1),
ell AS (SELECT entity_id, sqrt(-2 * ln(0.05) * greatest(0.0, (a + b) / 2 + sqrt(pow((a - b) / 2, 2) + c * c))) AS semi_major,
    sqrt(-2 * ln(0.05) * greatest(0.0, (a + b) / 2 - sqrt(pow((a - b) / 2, 2) + c * c))) AS semi_minor,
    (degrees(atan2(2 * c, a - b)) / 2 + 180) % 180 AS angle_deg, center_x, center_y FROM cov)"""
ENTROPY = "ent AS (SELECT entity_id, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS spatial_entropy FROM grid GROUP BY 1)"

# k-means for k = 1 to 5, five starts each; draws with the least digests start a run
MODES = """seed AS (SELECT entity_id, s, c, arg_min({'x': x, 'y': y}, md5(concat_ws(':', s * 100 + c, chain_id, sample_id))) AS p
               FROM draws, range(5) a(s), range(5) b(c) GROUP BY ALL),
      run AS (SELECT entity_id, s, k, list(p ORDER BY c) AS cs FROM seed, range(1, 6) r(k) WHERE c < k GROUP BY ALL),
      move AS (SELECT entity_id, s, k, cs, true AS going FROM run UNION ALL
        SELECT entity_id, s, k, cs, len(cs) <> len(old) OR len(list_filter(range(1, len(cs) + 1), lambda i:
                 greatest(abs(cs[i].x - old[i].x), abs(cs[i].y - old[i].y)) > 1e-9)) > 0
        FROM (SELECT entity_id, s, k, list({'x': x, 'y': y} ORDER BY x, y) AS cs, any_value(list_sort(old)) AS old
          FROM (SELECT entity_id, s, k, any_value(cs) AS old, avg(x) AS x, avg(y) AS y
            FROM (SELECT m.*, d.x, d.y, list_sort(list_transform(cs, lambda q, i: {'d': (q.x - d.x) * (q.x - d.x) + (q.y - d.y) * (q.y - d.y), 'c': i}))[1].c AS c
                  FROM move m JOIN draws d ON d.entity_id = m.entity_id WHERE going) GROUP BY entity_id, s, k, c) GROUP BY entity_id, s, k)),
      sse AS (SELECT m.entity_id, s, k, count(*) AS n, sum(list_min(list_transform(cs, lambda q: (q.x - d.x) * (q.x - d.x) + (q.y - d.y) * (q.y - d.y)))) AS e
              FROM move m JOIN draws d ON d.entity_id = m.entity_id WHERE NOT going GROUP BY ALL),
      best AS (SELECT entity_id, k, any_value(n) AS n, min(e) AS e FROM sse GROUP BY ALL),
      modes AS (SELECT entity_id, CASE WHEN any_value(n) < 10 THEN 1 ELSE arg_min(k, e / n + 2 * k * ln(n) / n) END::INTEGER AS num_modes FROM best GROUP BY 1)"""

# -- registry and names -----------------------------------------------------------

WORDS = rf"""
bw AS (SELECT item_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i
  FROM (SELECT item_id, regexp_extract_all(text, '\p{{L}}+') AS w FROM benchmark)),
bc AS (SELECT {P.canonical('w')} AS canonical_name, item_id * 100000 + i AS o, w FROM bw),
reg AS (SELECT canonical_name, min(o) AS ord, arg_min(w, o) AS name FROM bc GROUP BY 1)"""

TRIPS = f"{P.windows(3, 3)}, {P.hits('wins', 'doc_id, window_id, sentence_id, sentence')}"
ENDS = "nms AS (SELECT DISTINCT name FROM (SELECT location_1 AS name FROM trips UNION ALL SELECT location_2 FROM trips))"

_rel_case = P.case("spatial_indicator", lx.CUE_RELATIONS)
JOINT = f"""{P.chunks()}, {P.hits('chunks', 'doc_id, chunk')},
jr AS (SELECT doc_id, chunk, ord, {_rel_case} AS relation_type, location_1 AS entity_1, location_2 AS entity_2,
    CASE WHEN contains(spatial_indicator, ' ') THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM trips
  WHERE {_rel_case} IS NOT NULL AND length(location_1) >= 2 AND length(location_2) >= 2
    AND {P.fold('location_1')} <> {P.fold('location_2')}),
je AS (SELECT doc_id, chunk, ord * 2 AS pos, entity_1 AS raw FROM jr UNION ALL SELECT doc_id, chunk, ord * 2 + 1, entity_2 FROM jr),
jc AS (SELECT *, {P.canonical('raw')} AS canon FROM je),
jn AS (SELECT *, {P.fold('canon')} AS norm FROM jc),
jf AS (SELECT doc_id, chunk, norm, arg_min(canon, pos) AS canon, arg_min(raw, pos) AS raw FROM jn GROUP BY 1, 2, 3),
jm0 AS (SELECT f.canon, f.raw, s.doc_id || '_sent_' || s.sent_idx AS sentence_id, s.text,
    unnest(list_filter(range(0, length(s.text)), lambda i: substr(lower(s.text), (i + 1)::INT, length(f.raw)) = lower(f.raw))) AS pos0
  FROM jf f JOIN sents s ON s.doc_id = f.doc_id AND s.sent_idx >= f.chunk * 4 AND s.sent_idx < f.chunk * 4 + 6),
jm AS (SELECT DISTINCT canon AS canonical_name, sentence_id, pos0 AS char_start, pos0 + length(raw) AS char_end,
    '...' || substr(text, greatest(0, pos0 - 20)::INT + 1, (least(length(text), pos0 + length(raw) + 20) - greatest(0, pos0 - 20))::INT) || '...' AS source_text
  FROM jm0)"""


def ends_with(x, tails):
    return f"regexp_matches({x}, '(?:{'|'.join(tails)})$')"


CLASS_HINT = lambda x, hint: (
    f"CASE WHEN {x} IN ({lst(nm.FICTIONAL)}) THEN 'fictional' WHEN {hint} IN ('fictional', 'real') THEN {hint} "
    f"WHEN {x} IN ({lst(nm.REAL)}) OR {ends_with(x, nm.ENDINGS)} THEN 'real' ELSE 'uncertain' END")
CLASS_WIDE = lambda x: (
    f"CASE WHEN {x} IN ({lst(nm.FICTIONAL)}) THEN 'fictional' WHEN {x} IN ({lst(nm.REAL + nm.REAL_MORE)}) "
    f"OR {ends_with(x, nm.ENDINGS + nm.ENDINGS_MORE)} OR regexp_matches({x}, '^(?:{'|'.join(nm.BEGINNINGS)})') "
    "THEN 'real' ELSE 'uncertain' END")
SCAN = lambda x: rf"(length({x}) < 3 OR (regexp_matches({x}, '\d') AND NOT regexp_matches({x}, {q(nm.ORDINAL)})) OR regexp_matches({x}, {q(nm.ODD)}))"
NOPLACE = lambda x: (rf"(length({P.strip(x)}) <= 2 OR regexp_matches(lower({P.strip(x)}), '[''’]s$') OR "
                     rf"(NOT contains({P.strip(x)}, ' ') AND regexp_matches({P.strip(x)}, '^\p{{Ll}}')))")

_empty = "(p_partkey % 10 IN (5, 6, 7, 8))"
_initcap = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"
NAMES = f"""nr AS (SELECT p_partkey, p_size,
    {pick(["", "Lake ", "the ", "Port ", "12th ", "New York", "West Egg", "Gatsby", "N.Y.", "São "], 'p_partkey')} ||
    CASE WHEN {_empty} THEN '' ELSE CASE WHEN p_partkey % 3 = 0 THEN {_initcap} ELSE p_name END END ||
    CASE WHEN {_empty} THEN '' ELSE {pick(["", "City", " Island", " River", " Harbor", "'s", " 4", " Road", " & Co", "n", " Airport"], 'p_partkey')} END AS raw
  FROM part),
nn AS (SELECT *, {P.surface_lookup(P.strip(f"regexp_replace(raw, '{P.SPACE}+', ' ', 'g')"))} AS name,
    {P.strip('lower(' + pick(["", "Real ", "FICTIONAL", "uncertain", "unknown"], 'p_size') + ')')} AS hint FROM nr)"""

# -- scoring ------------------------------------------------------------------------

_keys = lambda f: ", ".join(f"{f(c)} AS k{i}" for i, c in enumerate(("location_1", "location_2", "spatial_indicator"), 1))
_toks = lambda x: f"list_distinct(regexp_extract_all({P.fold(x)}, '[a-z0-9]+'))"
_jac = lambda a, b: (
    f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE "
    f"len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END >= 0.5")


def match_sql(lenient: bool) -> str:
    key = _toks if lenient else P.fold
    hit = " AND ".join(_jac(f"p.k{i}", f"g.k{i}") if lenient else f"p.k{i} = g.k{i}" for i in (1, 2, 3))
    return f"""RECURSIVE {P.windows(3, 3)},
{P.hits('wins', 'doc_id, window_id', 'gt', bare=True)}, {P.hits('wins', 'doc_id, window_id', 'pt')},
ann AS (SELECT doc_id, window_id, model FROM wins, (SELECT unnest(['full', 'narrow']) AS model)),
g AS (SELECT doc_id, window_id, ord + 1 AS j, {_keys(key)}, coalesce({P.infer_type('spatial_indicator')}, 'UNTYPED') AS st FROM gt),
p0 AS (SELECT 'full' AS model, * FROM pt UNION ALL
       SELECT 'narrow', * FROM pt WHERE NOT regexp_matches(location_1, '(?i)^(the|an|a) ')),
p AS (SELECT model, doc_id, window_id, row_number() OVER (PARTITION BY model, doc_id, window_id ORDER BY ord) AS i,
    {_keys(key)}, coalesce({P.infer_type('spatial_indicator')}, 'UNTYPED') AS st FROM p0),
np AS (SELECT model, doc_id, window_id, count(*) AS n FROM p GROUP BY 1, 2, 3),
cand AS (SELECT p.model, p.doc_id, p.window_id, p.i, list(g.j ORDER BY g.j) AS js FROM p JOIN g USING (doc_id, window_id)
  WHERE {hit} GROUP BY 1, 2, 3, 4),
walk AS (SELECT model, doc_id, window_id, 0::BIGINT AS i, []::BIGINT[] AS hits FROM np
  UNION ALL SELECT w.model, w.doc_id, w.window_id, w.i + 1,
    list_append(w.hits, coalesce(list_filter(c.js, lambda j: NOT list_contains(w.hits, j))[1], 0))
  FROM walk w JOIN np USING (model, doc_id, window_id) LEFT JOIN cand c
    ON c.model = w.model AND c.doc_id = w.doc_id AND c.window_id = w.window_id AND c.i = w.i + 1 WHERE w.i < np.n),
fin AS (SELECT w.* FROM walk w JOIN np USING (model, doc_id, window_id) WHERE w.i = np.n),
pm AS (SELECT p.model, p.doc_id, p.window_id, p.st, fin.hits[p.i] AS j FROM p JOIN fin USING (model, doc_id, window_id)),
gm AS (SELECT a.model, g.doc_id, g.window_id, g.st, pm.j IS NOT NULL AS hit FROM ann a JOIN g USING (doc_id, window_id)
  LEFT JOIN pm ON pm.model = a.model AND pm.doc_id = g.doc_id AND pm.window_id = g.window_id AND pm.j = g.j),
marks AS (SELECT model, st, CASE WHEN hit THEN 'tp' ELSE 'fn' END AS what FROM gm
  UNION ALL SELECT model, st, 'fp' FROM pm WHERE j = 0)"""


_prf = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS recall,
  CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0.0::DOUBLE END AS f1"""
_cnt = ", ".join(f"count(*) FILTER (WHERE what = '{w}') AS {w}" for w in ("tp", "fp", "fn"))


def overall_sql(lenient: bool) -> str:
    return f"""WITH {match_sql(lenient)}, c AS (SELECT model, {_cnt} FROM marks GROUP BY 1), s AS (SELECT *, {_prf} FROM c)
  SELECT model, tp, fp, fn, tp + fp AS n_predictions, {rnd('precision', 'recall', 'f1')} FROM s"""


def _line(lenient: bool, name: str) -> str:
    f = lambda c: f"printf('%.3f', {c})"
    return f"""SELECT model, '{name}' AS scheme, '| ' || concat_ws(' | ', model, '{name}', {f('precision')}, {f('recall')},
      {f('f1')}, tp::VARCHAR, fp::VARCHAR, fn::VARCHAR) || ' |' AS line FROM (WITH {match_sql(lenient)},
      c AS (SELECT model, {_cnt} FROM marks GROUP BY 1) SELECT *, {_prf} FROM c)"""


_cand_tokens = rf"list_filter(regexp_split_to_array(text, '{P.SPACE}+'), lambda w: w <> '')"
_gaz = f"""gaz AS (SELECT {_supp('c_custkey // 15')} AS name, c_custkey % 15 AS rank, ((c_custkey * 37) % 1600 - 800) / 10.0::DOUBLE AS lat,
    ((c_custkey * 91) % 3500 - 1750) / 10.0::DOUBLE AS lon, c_custkey % 4 = 1 AS us FROM customer)"""
_typed = f"coalesce({P.infer_type('spatial_indicator')}, '')"

SQL = {
    "p15_span_to_sentence": f"""WITH {P.windows(3, 3)}, {P.hits('wins', 'doc_id, window_id, sentence')},
      ms AS (SELECT t.doc_id, t.window_id, t.ord, position(ltrim(regexp_replace(m.m, '^[^\\p{{L}}]', '')) IN t.sentence) - 1 AS start,
          length(regexp_replace(m.m, '^[^\\p{{L}}]', '')) AS len FROM trips t JOIN trips_m m USING (doc_id, window_id, ord)),
      parts AS (SELECT k.doc_id, k.pos // 3 AS window_id, k.pos, k.doc_id || '_sent_' || k.sent_idx AS sentence_id,
          length({P.strip('replace(k.text, chr(10), chr(32))')}) AS len FROM kept k WHERE k.pos // 3 * 3 + 3 <= k.n),
      bounds AS (SELECT *, coalesce(sum(len + 1) OVER (PARTITION BY doc_id, window_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM parts),
      hit AS (SELECT ms.*, b.sentence_id, b.b, b.len AS blen, row_number() OVER (PARTITION BY ms.doc_id, ms.window_id, ms.ord
          ORDER BY CASE WHEN ms.start >= b.b AND ms.start < b.b + b.len THEN 0 ELSE 1 END, b.pos DESC) AS rn
        FROM ms JOIN bounds b ON b.doc_id = ms.doc_id AND b.window_id = ms.window_id)
      SELECT doc_id, window_id, ord, start, sentence_id, (start - b)::BIGINT AS local_start,
        (least(start + len, b + blen) - b)::BIGINT AS local_end FROM hit WHERE rn = 1""",
    "p14_token_offsets": rf"""WITH {P.SENTS},
      t AS (SELECT doc_id, sent_idx, text, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS i
        FROM (SELECT *, {_cand_tokens} AS l FROM sents)),
      g AS (SELECT doc_id, sent_idx, unnest(s) AS gap, generate_subscripts(s, 1) - 1 AS i
        FROM (SELECT doc_id, sent_idx, regexp_extract_all(text, '{P.SPACE}+') AS s FROM sents)),
      o AS (SELECT t.*, sum(length(token) + coalesce(length(gap), 0)) OVER (PARTITION BY t.doc_id, t.sent_idx ORDER BY t.i) AS upto,
          coalesce(length(gap), 0) AS gl FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.sent_idx = t.sent_idx AND g.i = t.i)
      SELECT doc_id, sent_idx, i, token, (upto - gl - length(token))::BIGINT AS char_start, (upto - gl)::BIGINT AS char_end FROM o""",
    "x01_parse_responses": f"""WITH {TRIPS} SELECT doc_id, window_id, ord, replace(upper(location_1), 'ẞ', 'SS') AS location_1, location_2,
      spatial_indicator, {_typed} AS semantic_type FROM trips WHERE window_id % 4 IN (0, 1)""",
    "x02_parse_and_validate": f"""WITH {TRIPS},
      u AS (SELECT doc_id, window_id, ord, sentence, replace(upper(location_1), 'ẞ', 'SS') AS location_1, location_2, spatial_indicator,
        {P.infer_type('spatial_indicator')} AS semantic_type FROM trips WHERE window_id % 4 <> 3),
      v AS (SELECT *, {P.fold('sentence')} AS ft, {P.fold('location_1')} AS fa, {P.fold('location_2')} AS fb,
        {P.fold('spatial_indicator')} AS fc FROM u),
      w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, window_id, fa, fc, fb ORDER BY ord) AS rn FROM v
        WHERE semantic_type IS NOT NULL AND fa <> fb AND contains(ft, fa) AND contains(ft, fb) AND contains(ft, fc)
        AND NOT list_bool_or(list_transform([{lst(lx.METAPHORS)}], lambda m: contains(ft, m) AND contains(fc || ' ' || fb, m))))
      SELECT doc_id, window_id, ord, location_1, location_2, spatial_indicator, semantic_type FROM w WHERE rn = 1""",
    "f06_joint_validate": f"""WITH r AS (SELECT o_orderkey AS k, {pick(LINE_TYPES, 'o_orderkey')} AS relation_type,
        CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE trim(o_orderpriority) END AS entity_1,
        {pick(["GPE", "LOC", "FAC", "LOC"], 'o_orderkey')} AS entity_1_type,
        {pick(["real", "fictional", "uncertain"], 'o_orderkey')} AS entity_1_class,
        CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN lower(trim(o_orderpriority))
          ELSE 'Clerk ' || o_custkey END AS entity_2,
        CASE WHEN o_orderkey % 9 = 0 THEN 0.5::DOUBLE WHEN o_orderkey % 10 = 0 THEN 0.0::DOUBLE
          ELSE round(least(1.0::DOUBLE, (o_orderkey % 150) / 100.0::DOUBLE), 3) END AS confidence,
        CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE (o_orderkey % 90)::DOUBLE END AS distance_value,
        CASE o_orderkey % 3 WHEN 0 THEN 'miles' WHEN 1 THEN 'km' END AS distance_unit FROM orders)
      SELECT k AS rid, relation_type, entity_1, entity_1_type, entity_1_class, entity_2,
        CASE WHEN entity_2 IS NOT NULL THEN 'LOC' END AS entity_2_type, CASE WHEN entity_2 IS NOT NULL THEN 'real' END AS entity_2_class,
        confidence, distance_value, distance_unit FROM r
      WHERE relation_type IN ({lst(lx.RELATION_TYPES)}) AND length(entity_1) >= 2 AND (entity_2 IS NOT NULL OR relation_type = 'on_coast')
        AND (entity_2 IS NULL OR lower(entity_1) <> lower(entity_2)) AND confidence >= 0.55""",
    "i11_joint_candidates": f"""WITH {JOINT}, live AS (SELECT doc_id, chunk FROM chunks WHERE length(sentence) % 17 <> 0),
      hint AS (SELECT *, relation_type IN ('near', 'far') AS away FROM jr)
      SELECT r.doc_id, r.chunk, r.ord, relation_type, a.canon AS entity_1, 'GPE' AS entity_1_type,
        CASE WHEN length(entity_1) % 2 = 0 THEN 'real' ELSE 'fictional' END AS entity_1_class, b.canon AS entity_2, 'LOC' AS entity_2_type,
        CASE WHEN length(entity_2) % 2 = 0 THEN 'real' ELSE 'fictional' END AS entity_2_class, confidence,
        CASE WHEN away THEN (length(entity_1) + length(entity_2))::DOUBLE END AS distance_value, CASE WHEN away THEN 'km' END AS distance_unit
      FROM hint r JOIN live l ON l.doc_id = r.doc_id AND l.chunk = r.chunk
      JOIN jn x ON x.doc_id = r.doc_id AND x.chunk = r.chunk AND x.pos = r.ord * 2
      JOIN jf a ON a.doc_id = r.doc_id AND a.chunk = r.chunk AND a.norm = x.norm
      JOIN jn y ON y.doc_id = r.doc_id AND y.chunk = r.chunk AND y.pos = r.ord * 2 + 1
      JOIN jf b ON b.doc_id = r.doc_id AND b.chunk = r.chunk AND b.norm = y.norm""",
    "i12_attempt_history": f"""WITH {P.chunks()}, n AS (SELECT doc_id, chunk, length(sentence) AS n FROM chunks),
      a AS (SELECT *, CASE WHEN n % 17 = 0 THEN 3 WHEN n % 3 = 0 THEN 2 ELSE 1 END AS k FROM n)
      SELECT doc_id, chunk, k::BIGINT AS n_attempts, round(0.05 + 0.05 * k::DOUBLE, 2) AS temperature, k > 1 AS strict, n % 17 = 0 AS failed FROM a""",
    "s28_answer_log": f"""WITH {JOINT}, c AS (SELECT doc_id, chunk, length(sentence) AS n FROM chunks),
      t AS (SELECT doc_id, chunk, count(*) AS k FROM trips GROUP BY 1, 2)
      SELECT c.doc_id, count(*) AS chunks, count(*) FILTER (WHERE n % 17 = 0) AS failed,
        sum(CASE WHEN n % 17 = 0 THEN 3 WHEN n % 3 = 0 THEN 2 ELSE 1 END)::BIGINT AS attempts,
        sum(CASE WHEN n % 17 = 0 THEN 0 ELSE coalesce(k, 0) END)::BIGINT AS relations
      FROM c LEFT JOIN t ON t.doc_id = c.doc_id AND t.chunk = c.chunk GROUP BY 1""",
    "d04_relation_candidates": f"""WITH {JOINT} SELECT r.doc_id, r.chunk, r.ord, relation_type, a.canon AS entity_1, b.canon AS entity_2, confidence
      FROM jr r JOIN jn x ON x.doc_id = r.doc_id AND x.chunk = r.chunk AND x.pos = r.ord * 2
      JOIN jf a ON a.doc_id = r.doc_id AND a.chunk = r.chunk AND a.norm = x.norm
      JOIN jn y ON y.doc_id = r.doc_id AND y.chunk = r.chunk AND y.pos = r.ord * 2 + 1
      JOIN jf b ON b.doc_id = r.doc_id AND b.chunk = r.chunk AND b.norm = y.norm""",
    "a06_entity_registry": f"""WITH {JOINT},
      e AS (SELECT canon AS canonical_name, count(DISTINCT doc_id) AS doc_count FROM jf GROUP BY 1),
      n AS (SELECT *, row_number() OVER (ORDER BY canonical_name) - 1 AS i FROM e),
      c AS (SELECT canonical_name, count(*) AS mention_count FROM jm GROUP BY 1)
      SELECT 'e_' || CASE WHEN i < 10000 THEN lpad(i::VARCHAR, 4, '0') ELSE i::VARCHAR END AS entity_id, canonical_name,
        {CLASS_HINT('canonical_name', "''")} AS type, 'LOC' AS ner_label, mention_count, doc_count FROM n JOIN c USING (canonical_name)""",
    "j08_mention_positions": f"WITH {JOINT} SELECT * FROM jm",
    "i10_clustered_registry": f"""WITH {P.SENTS},
      c0 AS (SELECT doc_id, sent_idx, text, unnest(list_distinct(regexp_extract_all(text, '(\\p{{Lu}}\\p{{L}}*(?: \\p{{Lu}}\\p{{L}}*)*)', 1))) AS s FROM sents),
      c1 AS (SELECT doc_id, sent_idx, s, unnest(list_filter(range(0, length(text)), lambda i: substr(text, (i + 1)::INT, length(s)) = s)) AS p FROM c0),
      named AS (SELECT {P.surface_lookup(P.strip(f"regexp_replace(s, '{P.SPACE}+', ' ', 'g')"))} AS canon, doc_id, sent_idx, p, p + length(s) AS e FROM c1),
      nm AS (SELECT canon, lower(canon) AS key, min((doc_id, sent_idx, p)) AS f, min((doc_id, sent_idx // 6)) AS seen FROM named GROUP BY ALL),
      keys AS (SELECT key, min((f, canon)) AS f FROM nm GROUP BY 1),
      cl AS (SELECT doc_id, sent_idx AS cluster, 0 AS pos, sent_idx // 6 AS chunk, regexp_extract(text, '^\\S+(?: \\S+)?') AS m, sent_idx FROM sents
        UNION ALL SELECT doc_id, sent_idx - 1, 1, sent_idx // 6, regexp_extract(text, '^\\S+'), sent_idx FROM sents WHERE sent_idx % 6 > 0),
      lows AS (SELECT DISTINCT lower({P.strip('m')}) AS low FROM cl),
      hit AS (SELECT low, low AS key, 0 AS level FROM lows JOIN keys ON key = low
        UNION ALL SELECT low, arg_min(key, f), 1 FROM lows JOIN keys ON length(key) >= 4 AND contains(low, key) GROUP BY low),
      met AS (SELECT cl.doc_id, cl.cluster, cl.pos, level, arg_max(canon, (f, canon)) AS canon FROM cl JOIN hit ON hit.low = lower({P.strip('m')})
        JOIN nm ON nm.key = hit.key AND nm.seen <= (cl.doc_id, cl.chunk) GROUP BY ALL),
      own AS (SELECT doc_id, cluster, arg_min(canon, (pos, level)) AS canon FROM met GROUP BY ALL),
      fresh AS (SELECT DISTINCT own.canon, cl.doc_id, cl.sent_idx, length(m) AS e FROM cl JOIN own ON own.doc_id = cl.doc_id AND own.cluster = cl.cluster
        WHERE lower({P.strip('m')}) <> lower(own.canon)
          AND NOT EXISTS (SELECT 1 FROM named n WHERE n.canon = own.canon AND n.doc_id = cl.doc_id AND n.sent_idx = cl.sent_idx AND n.p = 0 AND n.e = length(m))),
      every AS (SELECT canon, doc_id FROM named UNION ALL SELECT canon, doc_id FROM fresh),
      cnt AS (SELECT canon, count(*) AS mention_count, count(DISTINCT doc_id) AS doc_count FROM every GROUP BY 1),
      c4 AS (SELECT nm.canon AS canonical_name, mention_count, doc_count, row_number() OVER (ORDER BY f, nm.canon) - 1 AS i
        FROM nm JOIN cnt ON cnt.canon = nm.canon WHERE nm.canon NOT IN ({lst(nm.BLOCKED)}) AND NOT {SCAN('nm.canon')} AND NOT {NOPLACE('nm.canon')}
          AND (mention_count >= 2 OR nm.canon IN ({lst(nm.FICTIONAL)})))
      SELECT 'e_' || CASE WHEN i < 10000 THEN lpad(i::VARCHAR, 4, '0') ELSE i::VARCHAR END AS entity_id, canonical_name,
        {CLASS_WIDE('canonical_name')} AS type, 'LOC' AS ner_label, mention_count, doc_count FROM c4""",
    "i10_span_registry": f"""WITH {P.SENTS},
      c0 AS (SELECT doc_id, sent_idx, text, unnest(list_distinct(regexp_extract_all(text, '(\\p{{Lu}}\\p{{L}}*(?: \\p{{Lu}}\\p{{L}}*)*)', 1))) AS s FROM sents),
      c1 AS (SELECT doc_id, sent_idx, s, unnest(list_filter(range(0, length(text)), lambda i: substr(text, (i + 1)::INT, length(s)) = s)) AS p FROM c0),
      c2 AS (SELECT {P.surface_lookup(P.strip(f"regexp_replace(s, '{P.SPACE}+', ' ', 'g')"))} AS canonical_name, doc_id, sent_idx, p FROM c1),
      c3 AS (SELECT canonical_name, count(*) AS mention_count, min((doc_id, sent_idx, p)) AS f FROM c2 GROUP BY 1),
      c4 AS (SELECT *, row_number() OVER (ORDER BY f, canonical_name) - 1 AS i FROM c3 WHERE canonical_name NOT IN ({lst(nm.BLOCKED)})
        AND NOT {SCAN('canonical_name')} AND NOT {NOPLACE('canonical_name')} AND (mention_count >= 2 OR canonical_name IN ({lst(nm.FICTIONAL)})))
      SELECT 'e_' || CASE WHEN i < 10000 THEN lpad(i::VARCHAR, 4, '0') ELSE i::VARCHAR END AS entity_id, canonical_name,
        {CLASS_WIDE('canonical_name')} AS type, 'LOC' AS ner_label, mention_count FROM c4""",
    "m11_canonical_resolve": f"""WITH {TRIPS}, {ENDS}, {WORDS},
      kr AS (SELECT {P.fold('canonical_name')} AS key, canonical_name AS canonical, ord * 2 AS o FROM reg
             UNION ALL SELECT {P.fold('name')}, canonical_name, ord * 2 + 1 FROM reg),
      ks AS (SELECT key, arg_max(canonical, o) AS canonical, min(o) AS ord FROM kr GROUP BY 1),
      t AS (SELECT name, {P.fold('name')} AS key FROM nms),
      x AS (SELECT name, canonical FROM t JOIN ks USING (key)),
      y AS (SELECT t.name, arg_min(canonical, ord) AS canonical FROM t JOIN ks ON contains(ks.key, t.key) OR contains(t.key, ks.key)
            WHERE t.key NOT IN (SELECT key FROM ks) GROUP BY 1)
      SELECT * FROM x UNION ALL SELECT * FROM y""",
    "m12_match_mentions": f"""WITH {TRIPS}, {ENDS}, {WORDS},
      ks AS (SELECT lower(canonical_name) AS key, arg_max(canonical_name, ord) AS canonical, min(ord) AS ord FROM reg GROUP BY 1),
      t AS (SELECT name AS mention, lower({P.strip('name')}) AS low FROM nms),
      c AS (SELECT mention, canonical, 0 AS lv, 0 AS ord FROM t JOIN ks ON key = low
        UNION ALL SELECT mention, canonical, 1, 0 FROM t JOIN ks ON key = regexp_replace(low, '^(?:the|a|an) ', '')
        UNION ALL SELECT mention, canonical, 2, ord FROM t JOIN ks ON length(key) >= 4 AND contains(low, key))
      SELECT mention, arg_min(canonical, (lv, ord)) AS canonical FROM c GROUP BY 1""",
    "i09_coref_mentions": f"""WITH {TRIPS}, {ENDS}, {WORDS},
      ks AS (SELECT lower(canonical_name) AS key, arg_max(canonical_name, ord) AS canonical, min(ord) AS ord FROM reg GROUP BY 1),
      t AS (SELECT name AS mention, lower({P.strip('name')}) AS low FROM nms),
      c AS (SELECT mention, canonical, 0 AS lv, 0 AS ord FROM t JOIN ks ON key = low
        UNION ALL SELECT mention, canonical, 1, 0 FROM t JOIN ks ON key = regexp_replace(low, '^(?:the|a|an) ', '')
        UNION ALL SELECT mention, canonical, 2, ord FROM t JOIN ks ON length(key) >= 4 AND contains(low, key)),
      mm AS (SELECT mention, arg_min(canonical, (lv, ord)) AS canonical FROM c GROUP BY 1),
      s AS (SELECT doc_id || '_' || window_id AS window, ord * 2 AS pos, location_1 AS mention, sentence_id, ord FROM trips
        UNION ALL SELECT doc_id || '_' || window_id, ord * 2 + 1, location_2, sentence_id, ord FROM trips),
      cl AS (SELECT *, substr(regexp_replace(lower(mention), '^(the|an|a) ', ''), 1, 1) AS cluster FROM s),
      ow AS (SELECT "window", cluster, arg_min(canonical, pos) AS canonical_name FROM cl JOIN mm USING (mention) GROUP BY 1, 2),
      ex AS (SELECT DISTINCT {P.canonical('location_2')} AS canonical_name, sentence_id FROM trips WHERE spatial_indicator = 'in'),
      fr AS (SELECT cl.*, ow.canonical_name, row_number() OVER (PARTITION BY ow.canonical_name, sentence_id ORDER BY "window", cluster, pos) AS rn
        FROM cl JOIN ow USING ("window", cluster) WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.canonical_name = ow.canonical_name AND ex.sentence_id = cl.sentence_id))
      SELECT canonical_name, sentence_id, mention, ord AS char_start, ord + length(mention) AS char_end,
        '[coref→' || canonical_name || '] ...' || mention || '...' AS source_text FROM fr
      WHERE rn = 1 AND lower({P.strip('mention')}) <> lower(canonical_name)""",
    "m09_classify_names": f"""WITH {NAMES} SELECT p_partkey, name, {P.canonical('raw')} AS canonical,
      {CLASS_HINT('name', 'hint')} AS class_joint, {CLASS_WIDE('name')} AS class_wide, {SCAN('name')}::INT AS scan_error,
      {NOPLACE('name')}::INT AS not_a_place, (name NOT IN ({lst(nm.BLOCKED)}) AND NOT {SCAN('name')} AND NOT {NOPLACE('name')}
        AND (p_size % 4 >= 2 OR name IN ({lst(nm.FICTIONAL)})))::INT AS plausible FROM nn""",
    "a08_relation_dedup": f"""WITH {REL}, r AS (SELECT *, row_number() OVER w AS rn, min(rel_ord) OVER (PARTITION BY lower(entity_1), relation_type, lower(coalesce(entity_2, ''))) AS first_seen
      FROM rel WINDOW w AS (PARTITION BY lower(entity_1), relation_type, lower(coalesce(entity_2, '')) ORDER BY confidence DESC, rel_ord, relation_id))
      SELECT relation_id, relation_type, entity_1, entity_2, confidence, first_seen FROM r WHERE rn = 1""",
    "i13_graph_commit": f"""WITH {ENT}, {REL}, ok AS (SELECT canonical_name AS c FROM ent WHERE (type = 'fictional' AND mention_count >= 1)
        OR (type <> 'fictional' AND latitude IS NOT NULL AND mention_count >= 2)),
      r AS (SELECT * FROM rel WHERE entity_1 IN (SELECT c FROM ok) AND (entity_2 IS NULL OR entity_2 IN (SELECT c FROM ok))
        AND (entity_2 IS NULL OR entity_1 <> entity_2)),
      d AS (SELECT *, row_number() OVER (PARTITION BY entity_1, relation_type, coalesce(entity_2, '') ORDER BY confidence DESC, rel_ord, relation_id) AS rn FROM r)
      SELECT relation_id, relation_type, entity_1, entity_2, weight, round(1.0 - confidence, 3) AS uncertainty, distance_value, distance_unit FROM d WHERE rn = 1""",
    "a09_counts_by_type": f"WITH {REL} SELECT relation_type, extraction_method, count(*) AS n FROM rel GROUP BY 1, 2",
    "g01_project_km": f"""WITH {ENT} SELECT entity_id, round(x_km, 4) AS x, round(y_km, 4) AS y, round(40.7128 + y_km / {SCALE}, 4) AS lat,
      round(-74.006 + x_km / ({SCALE} * {COS0}), 4) AS lon FROM km WHERE x_km IS NOT NULL""",
    "a20_bounding_box": f"""WITH {ENT}, f AS (SELECT round(x_km, 4) AS x, round(y_km, 4) AS y FROM km WHERE x_km IS NOT NULL)
      SELECT 'all' AS box, round(min(x) - 30, 4) AS x_min, round(max(x) + 30, 4) AS x_max, round(min(y) - 30, 4) AS y_min, round(max(y) + 30, 4) AS y_max FROM f
      UNION ALL SELECT 'near', round(min(x) - 30, 4), round(max(x) + 30, 4), round(min(y) - 30, 4), round(max(y) + 30, 4) FROM f WHERE sqrt(x * x + y * y) <= 300""",
    "g17_geo_edges": f"WITH {GEO} SELECT * FROM geo",
    "g18_anchor_edges": f"WITH {GEO} SELECT * FROM anchor",
    "u01_augmented_counts": f"""WITH {GEO}, u AS (
        SELECT extraction_method, relation_type, weight FROM rel WHERE extraction_method NOT IN ('geographic_knowledge', 'transitive_geographic', 'anchor_geographic')
        UNION ALL SELECT extraction_method, relation_type, weight FROM geo UNION ALL SELECT 'anchor_geographic', relation_type, weight FROM anchor)
      SELECT extraction_method, relation_type, count(*) AS n, round(sum(weight), 4) AS weight FROM u GROUP BY 1, 2""",
    "m14_constraint_specs": f"WITH {SPEC} SELECT constraint_id, type, e1, e2, weight, source_relation_id, {rnd(*PARAMS)} FROM spec",
    "f15_constraint_prune": f"""WITH {SPEC} SELECT 'latent' AS part, entity_id AS id FROM latent WHERE entity_id NOT IN (SELECT entity_id FROM weak)
      UNION ALL SELECT 'constraint', constraint_id FROM spec WHERE e1 NOT IN (SELECT entity_id FROM weak)
        AND (e2 IS NULL OR e2 NOT IN (SELECT entity_id FROM weak))""",
    "a22_underconstrained": f"WITH {SPEC} SELECT * FROM weak",
    "i03_transition": f"WITH {SWEEP} SELECT entity_id, moves, chain_id::INTEGER AS chain_id, round(x, 3) AS x, round(y, 3) AS y FROM sweep",
    "a24_acceptance_windows": f"""WITH {SWEEP} SELECT chain_id::INTEGER AS chain_id, 0::INTEGER AS round, 1::INTEGER AS first_sweep, 1::INTEGER AS sweeps,
      count(*) FILTER (WHERE moves) AS tried, count(*) FILTER (WHERE won) AS won,
      round(count(*) FILTER (WHERE won) / count(*) FILTER (WHERE moves)::DOUBLE, 4) AS rate, 10.0::DOUBLE AS proposal_std FROM sweep GROUP BY 1""",
    "g05_penalties": f"WITH {ENERGY} SELECT constraint_id, type, floor(pen * 10000 + 0.5) / 10000 AS penalty, floor(weight * pen * 10000 + 0.5) / 10000 AS energy FROM en",
    "a23_total_energy": f"WITH {ENERGY} SELECT type, count(*) AS n, round(sum(weight * pen), 2) AS energy FROM en GROUP BY 1",
    "v01_constraint_graph": f"""WITH {SPEC}, o AS (SELECT *, row_number() OVER (PARTITION BY least(e1, e2), greatest(e1, e2) ORDER BY n DESC) AS rn
      FROM spec WHERE e2 IS NOT NULL) SELECT least(e1, e2) AS a, greatest(e1, e2) AS b, type, greatest(1, floor(weight * 8))::BIGINT AS width FROM o WHERE rn = 1""",
    "v01_constraint_lines": f"""WITH g AS (WITH {SPEC}, o AS (SELECT *, row_number() OVER (PARTITION BY least(e1, e2), greatest(e1, e2) ORDER BY n DESC) AS rn
      FROM spec WHERE e2 IS NOT NULL) SELECT least(e1, e2) AS a, greatest(e1, e2) AS b, type, greatest(1, floor(weight * 8))::BIGINT AS width FROM o WHERE rn = 1)
      SELECT 'graph Constraints {{' AS line UNION ALL SELECT '}}' UNION ALL
      SELECT '  "' || a || '" -- "' || b || '" [label="' || type || '", color="' || {P.case('type', TYPE_COLOR)[:-3]} ELSE '#95a5a6' END || '", penwidth=' || width || '];' FROM g""",
    "s26_geocode_cache": f"""WITH {ENT}, w AS (
        SELECT lower(canonical_name) AS key, latitude AS lat, longitude AS lon, CASE WHEN latitude IS NOT NULL THEN 0.6::DOUBLE END AS confidence, 10::BIGINT AS seen
        FROM ent WHERE type = 'real' UNION ALL
        SELECT lower(canonical_name), latitude + 1, longitude, CASE WHEN latitude IS NOT NULL THEN 0.85::DOUBLE END, 20 FROM ent WHERE type = 'real' AND ord % 3 = 0),
      c AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY key ORDER BY seen DESC) = 1)
      SELECT lower(e.canonical_name) AS key, CASE WHEN c.seen IS NULL THEN 'unknown' WHEN c.lat IS NULL AND c.seen < 15 THEN 'stale'
        WHEN c.lat IS NULL THEN 'miss' ELSE 'hit' END AS state, {rnd('c.lat', 'c.lon').replace('AS c.', 'AS ')}, c.confidence, c.seen
      FROM ent e LEFT JOIN c ON c.key = lower(e.canonical_name)""",
    "d12_geocode_rules": f"""WITH {_gaz}, u AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY NOT us, rank) AS rn,
        first_value(lat) OVER (PARTITION BY name ORDER BY rank) AS lat_first FROM gaz)
      SELECT name, lat, lon, CASE WHEN us THEN 0.85::DOUBLE ELSE 0.6::DOUBLE END AS confidence, lat_first, 0.6::DOUBLE AS conf_first FROM u WHERE rn = 1""",
    "i08_grounding_fold": f"""WITH RECURSIVE {_gaz},
      e AS (SELECT s_suppkey AS ord, s_name AS canonical_name, s_suppkey % 17 = 5 AS free FROM supplier),
      f AS (SELECT -1::BIGINT AS ord, NULL::DOUBLE AS lat, NULL::DOUBLE AS lon, NULL::DOUBLE AS confidence, 0.0::DOUBLE AS sla, 0.0::DOUBLE AS slo, 0.0::DOUBLE AS n
        UNION ALL SELECT o, la, lo, cf, sla + coalesce(la, 0), slo + coalesce(lo, 0), n + CASE WHEN la IS NULL THEN 0 ELSE 1 END FROM (
          SELECT e.ord AS o, f.sla, f.slo, f.n,
            CASE WHEN NOT e.free THEN g.lat END AS la, CASE WHEN NOT e.free THEN g.lon END AS lo,
            CASE WHEN NOT e.free AND g.lat IS NOT NULL THEN CASE WHEN f.n > 0 THEN 0.85::DOUBLE ELSE 0.6::DOUBLE END END AS cf,
            row_number() OVER (ORDER BY CASE WHEN f.n > 0 THEN {haversine('g.lat', 'g.lon', 'f.sla / f.n', 'f.slo / f.n')} ELSE g.rank END, g.rank) AS rn
          FROM f JOIN e ON e.ord = f.ord + 1 LEFT JOIN gaz g ON g.name = e.canonical_name) WHERE rn = 1)
      SELECT e.ord, e.canonical_name, CASE WHEN lat IS NULL THEN 'fictional' ELSE 'real' END AS type, lat AS latitude, lon AS longitude, confidence
      FROM e JOIN f ON f.ord = e.ord""",
    "a19_mode_count": f"WITH RECURSIVE {DRAWS}, {MODES} SELECT * FROM modes",
    "a13_posterior_moments": f"WITH {DRAWS}, {MOMENTS} SELECT entity_id, n, {rnd('mean_x', 'mean_y', 'std_x', 'std_y')} FROM mom",
    "a14_credible_ellipse": f"WITH {DRAWS}, {ELLIPSE} SELECT entity_id, {rnd('semi_major', 'semi_minor', 'angle_deg', 'center_x', 'center_y')} FROM ell",
    "a15_spatial_entropy": f"WITH {CELLS}, {ENTROPY} SELECT entity_id, {rnd('spatial_entropy')} FROM ent",
    "v02_smoothed_grid": f"WITH {SMOOTH} SELECT entity_id, cell_x, cell_y, round(mass, 6) AS mass FROM smooth",
    "v02_contour_levels": f"""WITH {SMOOTH}, m AS (SELECT entity_id, round(mass, 9) AS m FROM smooth),
      r AS (SELECT entity_id, m, sum(m) OVER (PARTITION BY entity_id ORDER BY m DESC) AS held, count(*) OVER (PARTITION BY entity_id ORDER BY m DESC) AS cells FROM m)
      SELECT entity_id, share, round(max(m), 6) AS level, min(cells) AS n_cells FROM r, (VALUES (0.5::DOUBLE), (0.95::DOUBLE)) s(share)
      WHERE held >= share - 1e-6 GROUP BY entity_id, share""",
    "v02_density_grid": f"WITH {CELLS} SELECT * FROM grid",
    "a16_gelman_rubin": f"WITH {RHAT} SELECT entity_id, {rnd('r_hat_x', 'r_hat_y')} FROM rhat",
    "a17_effective_sample_size": f"WITH {DRAWS}, {ESS} SELECT entity_id, {rnd('ess_x', 'ess_y')} FROM ess",
    "a18_constraint_satisfaction": f"WITH {SCORES} SELECT sample_id, round(score, 4) AS score FROM sc",
    "a18_satisfaction_summary": f"""WITH {SCORES} SELECT 'as-is' AS kind, round(avg(score), 4) AS mean, round(stddev_pop(score), 4) AS std FROM sc
      UNION ALL SELECT 'evaluable', round(avg(score), 4), round(stddev_pop(score), 4) FROM se""",
    "d11_thin_burnin": f"""WITH {DRAWS} SELECT chain_id, sample_id // 4 AS sample_id, count(*) AS n, round(sum(x), 4) AS x FROM draws
      WHERE (sample_id // 4 + 1) % 5 = 0 AND sample_id // 4 + 1 > 20 GROUP BY 1, 2""",
    "d10_evenly_spaced": f"""WITH {DRAWS}, c AS (SELECT max(sample_id) + 1 AS n, least(50, max(sample_id) + 1) AS m FROM draws),
      p AS (SELECT DISTINCT j * (n - 1) // greatest(1, m - 1) AS s FROM (SELECT unnest(range(0, m)) AS j, n, m FROM c))
      SELECT sample_id, entity_id, {rnd('x', 'y')} FROM draws WHERE sample_id IN (SELECT s FROM p)""",
    "v04_ensemble_lines": f"""WITH {DRAWS}, {PARTC}, n AS (SELECT max(sample_id) + 1 AS n, least(50, max(sample_id) + 1) AS m FROM draws),
      p AS (SELECT DISTINCT j * (n - 1) // greatest(1, m - 1) AS s FROM (SELECT unnest(range(0, m)) AS j, n, m FROM n)),
      lead AS (SELECT 'c_' || CASE WHEN p_partkey < 10000 THEN lpad(p_partkey::VARCHAR, 4, '0') ELSE p_partkey::VARCHAR END AS constraint_id, type, e1, e2
        FROM pc WHERE e2 IS NOT NULL AND e1 <> e2 ORDER BY length(constraint_id), constraint_id LIMIT 20),
      r AS (SELECT p.s AS sample_id, c.constraint_id, c.type, coalesce(d1.x, f1.x) AS x1, coalesce(d1.y, f1.y) AS y1, coalesce(d2.x, f2.x) AS x2,
          coalesce(d2.y, f2.y) AS y2 FROM lead c CROSS JOIN p LEFT JOIN draws d1 ON d1.sample_id = p.s AND d1.entity_id = c.e1
        LEFT JOIN draws d2 ON d2.sample_id = p.s AND d2.entity_id = c.e2 LEFT JOIN fx f1 ON f1.entity_id = c.e1 LEFT JOIN fx f2 ON f2.entity_id = c.e2)
      SELECT sample_id, constraint_id, type, {rnd('x1', 'y1', 'x2', 'y2')} FROM r WHERE x1 IS NOT NULL AND x2 IS NOT NULL""",
    "v03_map_overlay": f"""WITH {DRAWS}, {MOMENTS} SELECT entity_id, round(40.7128 + mean_y / {SCALE}, 4) AS lat,
      round(-74.006 + mean_x / ({SCALE} * {COS0}), 4) AS lon, round(sqrt(std_x * std_x + std_y * std_y), 4) AS uncertainty_km FROM mom""",
    "j12_posterior_summary": f"""WITH RECURSIVE {RHAT}, {CELLS.replace(DRAWS + ',', '')}, {ENTROPY}, {MOMENTS}, {ELLIPSE}, {ESS}, {PARTC}, {MODES},
      sub AS (SELECT * FROM draws), {scores('', 'sc')}
      SELECT entity_id, 'Point ' || entity_id AS name, {rnd('mean_x', 'mean_y', 'std_x', 'std_y', 'semi_major', 'semi_minor')},
        round(angle_deg, 2) AS angle_deg, {rnd('center_x', 'center_y', 'spatial_entropy', 'r_hat_x', 'r_hat_y')}, num_modes,
        round(ess_x, 1) AS ess_x, round(ess_y, 1) AS ess_y,
        (SELECT round(avg(score), 4) FROM sc) AS constraint_satisfaction_mean, (SELECT round(stddev_pop(score), 4) FROM sc) AS constraint_satisfaction_std
      FROM mom JOIN ell USING (entity_id) JOIN ent USING (entity_id) JOIN rhat USING (entity_id) JOIN ess USING (entity_id) JOIN modes USING (entity_id)""",
    "i07_sample_energies": f"""WITH {DRAWS}, {PARTC}, ids AS (SELECT DISTINCT sample_id FROM draws),
      r AS (SELECT s.sample_id, c.*, coalesce(d1.x, f1.x) AS x1, coalesce(d1.y, f1.y) AS y1, coalesce(d2.x, f2.x) AS x2, coalesce(d2.y, f2.y) AS y2
        FROM ids s CROSS JOIN pc c LEFT JOIN draws d1 ON d1.sample_id = s.sample_id AND d1.entity_id = c.e1
        LEFT JOIN draws d2 ON d2.sample_id = s.sample_id AND d2.entity_id = c.e2
        LEFT JOIN fx f1 ON f1.entity_id = c.e1 LEFT JOIN fx f2 ON f2.entity_id = c.e2
        WHERE c.type IN ({lst(INFERABLE)}) AND (c.e1 LIKE 'v%' OR c.e2 LIKE 'v%'))
      SELECT sample_id, round(sum({penalty(True)}), 2) AS energy FROM r WHERE x1 IS NOT NULL AND x2 IS NOT NULL GROUP BY 1""",
    "a10_score_strict": overall_sql(False),
    "a10_score_lenient": overall_sql(True),
    "a11_score_per_type": f"""WITH {match_sql(True)}, c AS (SELECT model, st AS semantic_type, {_cnt} FROM marks GROUP BY 1, 2), s AS (SELECT *, {_prf} FROM c)
      SELECT model, semantic_type, tp, fp, fn, {rnd('precision', 'recall', 'f1')} FROM s""",
    "a12_score_outcomes": f"""WITH {match_sql(True)}, gc AS (SELECT DISTINCT doc_id, window_id, true AS g FROM g)
      SELECT a.model, count(*) FILTER (WHERE gc.g IS NULL AND np.n IS NULL) AS correct_empty_tp,
        count(*) FILTER (WHERE gc.g AND np.n IS NULL) AS missed_empty, count(*) FILTER (WHERE gc.g IS NULL AND np.n > 0) AS halluc_on_empty
      FROM ann a LEFT JOIN gc USING (doc_id, window_id) LEFT JOIN np USING (model, doc_id, window_id) GROUP BY 1""",
    "s21_type_markdown": f"""WITH {match_sql(True)}, c AS (SELECT model, st AS semantic_type, {_cnt} FROM marks GROUP BY 1, 2), s AS (SELECT *, {_prf} FROM c)
      SELECT model, semantic_type, '| ' || concat_ws(' | ', model, semantic_type, printf('%.3f', precision), printf('%.3f', recall), printf('%.3f', f1),
        tp::VARCHAR, fp::VARCHAR, fn::VARCHAR) || ' |' AS line FROM s""",
    "s21_score_markdown": f"{_line(False, 'strict')} UNION ALL {_line(True, 'lenient')}",
    "t04_progress_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "d08_recent_feed": "SELECT event_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 8",
    "d09_rolling_eta": """WITH m AS (SELECT avg(value) AS avg_s FROM (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 20)),
      d AS (SELECT count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS done, count(*) FILTER (WHERE event_type = 'error') AS errors,
        count(*) FILTER (WHERE event_type = 'purchase') AS relations FROM events),
      x AS (SELECT *, (total - done) * avg_s AS eta_s FROM d, m),
      y AS (SELECT *, floor(eta_s)::BIGINT AS s FROM x)
      SELECT total, done, errors, relations, round(avg_s, 4) AS avg_s, round(60.0 / avg_s, 4) AS rate_min, round(eta_s, 2) AS eta_s,
        CASE WHEN s >= 360000 THEN (s // 3600) || ':' WHEN s >= 3600 THEN lpad((s // 3600)::VARCHAR, 2, '0') || ':' ELSE '' END || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS eta,
        floor(relations / (done / total))::BIGINT AS projected FROM y""",
    "a25_window_stats": f"""WITH {TRIPS}, c AS (SELECT doc_id, window_id, count(*) AS n FROM trips GROUP BY 1, 2)
      SELECT (SELECT count(*) FROM wins) AS windows, count(*) AS windows_with_relations, sum(n)::BIGINT AS relations, 0::BIGINT AS errors FROM c""",
    "f16_resume_pending": f"WITH {P.windows(3, 3)} SELECT doc_id, window_id FROM wins WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
}
SQL["x03_parse_joint"] = f"SELECT * FROM ({SQL['f06_joint_validate']}) WHERE rid % 4 IN (0, 1)"
