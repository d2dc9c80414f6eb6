"""The same queries in SQL, written independently on the dense definitions where they are small."""

from __future__ import annotations

# Views of the tables, as chains of common table expressions.

NATION_LINES = """
lines AS (
  SELECT CAST(c_nationkey AS VARCHAR) o, CAST(s_nationkey AS VARCHAR) d, l_quantity f,
         o_orderpriority p, CAST(o_orderdate AS DATE) dt, l_returnflag, l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""

NATION_ZONES = """
z AS (
  SELECT CAST(n_nationkey AS VARCHAR) zone, CAST(10 * (n_nationkey % 5) AS DOUBLE) x,
         CAST(10 * (n_nationkey // 5) AS DOUBLE) y, CAST(100 AS DOUBLE) area,
         CAST(coalesce(b.n, 0) AS DOUBLE) pop, CAST(1 + coalesce(s.n, 0) AS DOUBLE) m,
         'g' || CAST(n_regionkey AS VARCHAR) grp
  FROM nation
  LEFT JOIN (SELECT c_nationkey k, count(*) n FROM customer GROUP BY 1) b ON b.k = n_nationkey
  LEFT JOIN (SELECT s_nationkey k, count(*) n FROM supplier GROUP BY 1) s ON s.k = n_nationkey)"""

FINE_LINES = """
size AS (SELECT count(*) n, CAST(ceil(sqrt(count(*))) AS BIGINT) w FROM supplier),
lines AS (
  SELECT CAST(o_custkey % n AS VARCHAR) o, CAST((o_custkey % n + n + (CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END)
    * ((l_suppkey % n) // (CASE l_partkey % (CASE WHEN l_returnflag = 'R' THEN 8 ELSE 6 END) WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4
      WHEN 3 THEN 8 WHEN 4 THEN 16 WHEN 5 THEN 32 WHEN 6 THEN 64 ELSE 128 END))) % n AS VARCHAR) d, l_quantity f, l_returnflag p
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey, size)"""

FINE_ZONES = """
z AS (
  SELECT CAST(s_suppkey % n AS VARCHAR) zone, s_suppkey % n k,
         CAST(2 * ((s_suppkey % n) % w) AS DOUBLE) x, CAST(2 * ((s_suppkey % n) // w) AS DOUBLE) y,
         CAST(4 AS DOUBLE) area, CAST(1 + coalesce(b.c, 0) AS DOUBLE) pop,
         CAST(1 + coalesce(q.c, 0) + (s_suppkey % n) % 7 AS DOUBLE) m,
         'g_' || CAST(((s_suppkey % n) % w) // 2 AS VARCHAR) || '_' || CAST(((s_suppkey % n) // w) // 2 AS VARCHAR) grp
  FROM supplier CROSS JOIN size
  LEFT JOIN (SELECT c_custkey % n k, count(*) c FROM customer, size GROUP BY 1) b ON b.k = s_suppkey % n
  LEFT JOIN (SELECT p_partkey % n k, count(*) c FROM part, size GROUP BY 1) q ON q.k = s_suppkey % n)"""

CELLS = """
cells AS (SELECT p, o, d, sum(f) f FROM lines GROUP BY p, o, d)"""

PAIRS = """
pairs AS (
  SELECT a.zone o, b.zone d, a.m mo, b.m md, a.pop po, b.pop pd,
         CASE WHEN a.zone = b.zone THEN sqrt(a.area / pi())
              ELSE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) END dist
  FROM z a, z b)"""


def targets_and_reference(reference: str) -> str:
    return f"""
t AS (SELECT * FROM cells WHERE p <> '{reference}'),
r AS (SELECT o, d, f FROM cells WHERE p = '{reference}'),
keys AS (SELECT DISTINCT p FROM t)"""


NATION = f"{NATION_LINES},{NATION_ZONES},{CELLS},{PAIRS},{targets_and_reference('1-URGENT')}"
FINE = f"{FINE_LINES},{FINE_ZONES},{CELLS},{PAIRS},{targets_and_reference('A')}"

# Dense cells of (target, reference) and of (target, scaled reference, scaled transpose).

DENSE = """
dense AS (
  SELECT keys.p, pairs.o, pairs.d, dist, coalesce(t.f, 0) t, coalesce(r.f, 0) r, coalesce(rt.f, 0) rt
  FROM keys CROSS JOIN pairs
  LEFT JOIN t ON t.p = keys.p AND t.o = pairs.o AND t.d = pairs.d
  LEFT JOIN r ON r.o = pairs.o AND r.d = pairs.d
  LEFT JOIN r rt ON rt.o = pairs.d AND rt.d = pairs.o)"""

PLAIN_AB = "ab AS (SELECT p, o, d, dist, t a, r b FROM dense)"

SCALED = """
sums AS (SELECT p, sum(t) st, sum(r) sr, sum(CASE WHEN o = d THEN t ELSE 0 END) tr FROM dense GROUP BY p),
ab AS (
  SELECT dense.p, o, d, dist, t a, st / sr * r b, st / sr * rt bt,
         sum(t) OVER (PARTITION BY dense.p, o) * sum(t) OVER (PARTITION BY dense.p, d) / st ind
  FROM dense JOIN sums ON sums.p = dense.p)"""


def scores(keys: str = "p") -> str:
    """One CTE of pair scores from dense cells ``ab`` with the given key columns."""
    return f"""
big AS (SELECT {keys}, max(greatest(a, b)) v, count(*) n2 FROM ab GROUP BY {keys}),
edge AS (SELECT *, greatest(v / 1e6, 1e-12) lo FROM big),
sized AS (
  SELECT {keys}, side, CASE WHEN c < lo THEN 0 ELSE least(19, CAST(floor(
    (log10(c) - log10(lo)) / (log10(v) - log10(lo)) * 19) AS INT) + 1) END bin
  FROM (SELECT {keys}, 'a' side, a c FROM ab UNION ALL SELECT {keys}, 'b', b FROM ab)
  JOIN edge USING ({keys}) WHERE v > 0),
shares AS (
  SELECT {keys}, bin, sum(CASE WHEN side = 'a' THEN 1 ELSE 0 END) / CAST(any_value(n2) AS DOUBLE) pa,
         sum(CASE WHEN side = 'b' THEN 1 ELSE 0 END) / CAST(any_value(n2) AS DOUBLE) pb
  FROM sized JOIN big USING ({keys}) GROUP BY {keys}, bin),
js AS (
  SELECT {keys}, 0.5 * sum(CASE WHEN pa > 0 THEN pa * ln(pa / greatest((pa + pb) / 2, 1e-12)) ELSE 0 END)
       + 0.5 * sum(CASE WHEN pb > 0 THEN pb * ln(pb / greatest((pa + pb) / 2, 1e-12)) ELSE 0 END) jsd
  FROM shares GROUP BY {keys}),
hist AS (
  SELECT {keys}, CASE WHEN dist < 0.5 THEN 0 WHEN dist < 2 THEN 1 WHEN dist < 10 THEN 2 WHEN dist < 50 THEN 3 ELSE 4 END band,
         sum(a) ha, sum(b) hb FROM ab GROUP BY ALL),
lens AS (SELECT {keys}, 2 * sum(least(ha, hb)) / (sum(ha) + sum(hb)) cpcd FROM hist GROUP BY {keys}),
corr AS (
  SELECT {keys}, CASE WHEN count(*) >= 2 AND stddev_pop(ln(1 + a)) >= 1e-12 AND stddev_pop(ln(1 + b)) >= 1e-12
         THEN covar_pop(ln(1 + a), ln(1 + b)) / (stddev_pop(ln(1 + a)) * stddev_pop(ln(1 + b))) END r
  FROM ab WHERE a + b > 0 GROUP BY {keys}),
sc AS (
  SELECT {keys}, 2 * sum(least(a, b)) / (sum(a) + sum(b)) cpc,
         2.0 * sum(CASE WHEN a > 0 AND b > 0 THEN 1 ELSE 0 END)
           / (sum(CASE WHEN a > 0 THEN 1 ELSE 0 END) + sum(CASE WHEN b > 0 THEN 1 ELSE 0 END)) cpl,
         sqrt(avg((a - b) * (a - b))) / avg(a) nrmse
  FROM ab GROUP BY {keys}),
score AS (
  SELECT * FROM sc LEFT JOIN lens USING ({keys}) LEFT JOIN corr USING ({keys}) LEFT JOIN js USING ({keys}))"""


PAIR_COLUMNS = """round(cpc, 6) "CPC", round(cpl, 6) "CPL", round(r * r, 6) "R2", round(r, 6) pearson_r,
  round(nrmse, 6) "NRMSE", round(coalesce(jsd, 0), 6) "JSD", round(cpcd, 6) "CPCd" """


def overlap_scores(keys: str = "p") -> str:
    """Overlap with the reference: ``score`` plus transpose and independence, from SCALED cells."""
    return f"""{scores(keys)},
more AS (
  SELECT {keys}, 2 * sum(least(a, bt)) / (sum(a) + sum(bt)) cpc_rt,
         2 * sum(least(a, ind)) / (sum(a) + sum(ind)) cpc_ind FROM ab GROUP BY {keys})"""


OVERLAP_COLUMNS = """round(st / sr, 6) "lambda", round(tr / st, 6) "h_intra_T", round(cpc, 6) "CPC_R",
  round(cpc_rt, 6) "CPC_RT", round(cpc_rt - cpc, 6) "Delta", round(cpl, 6) "CPL", round(cpcd, 6) "CPCd",
  round(r * r, 6) "R2", round(nrmse, 6) "NRMSE", round(coalesce(jsd, 0), 6) "JSD",
  round(cpc_ind, 6) "CPC_indep", round(cpc_rt, 6) "CPC_RT_full", false skip"""


def nation(select: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join([NATION, *ctes]) + " " + select


def fine(select: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join([FINE, *ctes]) + " " + select


NATIONS = "'nations' study_area, p \"partition\""
GRID = "'grid' study_area, p \"partition\""

# Emission of probabilities ``prob(o, d, p_ij)`` onto the outflows of the fine targets.

OUTFLOWS = "outs AS (SELECT p, o, sum(f) osum FROM t GROUP BY p, o)"
EMIT = f"""SELECT 'grid' study_area, outs.p "partition", prob.o origin, prob.d destination,
  round(osum * w / sw, 6) flow
FROM (SELECT o, d, w, sum(w) OVER (PARTITION BY o) sw FROM weight) prob JOIN outs ON outs.o = prob.o"""


def emitted(weight: str) -> str:
    return fine(EMIT, OUTFLOWS, f"weight AS (SELECT o, d, {weight} w FROM pairs)")


DISK = """
disk AS (
  SELECT o, d, mo, md, po, pd,
         sum(pd) OVER (PARTITION BY o ORDER BY dist RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - pd s
  FROM pairs WHERE o <> d)"""
RADIATION = f"""{DISK},
own AS (SELECT o, sum(CASE WHEN o = d THEN f ELSE 0 END) / sum(f) h FROM r GROUP BY o),
weight AS (
  SELECT o, d, po * pd / ((po + s) * (po + pd + s)) w FROM disk
  UNION ALL
  SELECT zone, zone, coalesce(own.h, (SELECT sum(CASE WHEN o = d THEN f ELSE 0 END) / sum(f) FROM r))
  FROM z LEFT JOIN own ON own.o = z.zone)"""

BLOCKS = "blocks AS (SELECT zone, CAST(x / 2 AS BIGINT) % 5 block FROM z)"
TRAIN = f"""{BLOCKS},
train AS (SELECT f.block fold, b.zone o FROM blocks b, (SELECT DISTINCT block FROM blocks) f WHERE b.block <> f.block)"""

# Vendor rows.

TRIPS_A = """
ev AS (
  SELECT *, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'signup') prev FROM events),
a AS (
  SELECT CAST(user_id % 25 AS VARCHAR) origen, CAST((event_id * 7 + user_id) % 25 AS VARCHAR) destino,
    strftime(ts, '%Y%m%d') date, CAST(ts AS DATE) AS cday, CAST(hour(ts) AS BIGINT) hora,
    CASE prev WHEN 'signup' THEN 'casa' WHEN 'purchase' THEN 'trabajo_estudio' WHEN 'click' THEN 'frecuente'
      WHEN 'view' THEN 'no_frecuente' ELSE 'home' END actividad_origen,
    CASE event_type WHEN 'signup' THEN 'casa' WHEN 'purchase' THEN 'trabajo_estudio' WHEN 'click' THEN 'frecuente'
      WHEN 'view' THEN ' No_Frecuente ' ELSE 'work_or_study' END actividad_destino,
    CASE WHEN event_id % 4 = 0 THEN 'true' WHEN event_id % 4 = 1 THEN '0' WHEN event_id % 4 = 2 THEN 'no' END estudio,
    CASE WHEN event_id % 97 = 0 THEN 0 ELSE round(value) END flow,
    CASE WHEN event_id % 97 = 0 THEN 'bad' ELSE CAST(round(value) AS VARCHAR) END n_trips,
    CASE hour(ts) WHEN 7 THEN 'AM' WHEN 8 THEN 'AM' WHEN 9 THEN 'AM' WHEN 16 THEN 'PM' WHEN 17 THEN 'PM'
      WHEN 18 THEN 'PM' WHEN 19 THEN 'PM' WHEN 20 THEN 'night' WHEN 21 THEN 'night' WHEN 22 THEN 'night'
      WHEN 23 THEN 'night' ELSE CASE WHEN hour(ts) < 7 THEN 'overnight' ELSE 'interpeak' END END AS prd
  FROM ev)"""
PURPOSE = """CASE lower(trim(actividad_destino)) WHEN 'casa' THEN 'home' WHEN 'home' THEN 'home'
  WHEN 'trabajo_estudio' THEN 'work' WHEN 'work_or_study' THEN 'work' ELSE 'other' END"""
ACTIVITY = """CASE lower(trim(actividad_destino)) WHEN 'casa' THEN 'home' WHEN 'trabajo_estudio' THEN 'work_or_study'
  WHEN 'frecuente' THEN 'frequent_activity' WHEN 'no_frecuente' THEN 'infrequent_activity'
  ELSE lower(trim(actividad_destino)) END"""
TRIPS_B = NATION_LINES + """,
b AS (
  SELECT o, d, f, CASE l_returnflag WHEN 'A' THEN 'lavoro' WHEN 'N' THEN 'Studio' ELSE 'rientri a casa' END motivo,
    CASE l_linenumber % 4 WHEN 0 THEN 'Mattina' WHEN 1 THEN '07-10' WHEN 2 THEN '17-20' ELSE 'sera' END fascia
  FROM lines)"""


def vendor_a(select: str) -> str:
    return f"WITH {TRIPS_A} {select}"


def row_sums_of(*laws: str) -> str:
    """Every origin with outflow emits to every zone, and no row sum is missed."""
    named = ", ".join(f"('{x}')" for x in laws)
    return fine(
        f"SELECT {GRID}, 0 fold, law_model, count(*) origins, CAST(count(*) * (SELECT count(*) FROM z) AS BIGINT) cells, CAST(0 AS BIGINT) missed "
        f"FROM outs CROSS JOIN (VALUES {named}) laws(law_model) GROUP BY p, law_model",
        OUTFLOWS,
    )


def ipf_cycles(cycles: int) -> str:
    """Unrolled row and column fits on the dense seed, then the exact row rescale."""
    steps = [
        """x0 AS (SELECT keys.p, pairs.o, pairs.d, coalesce(r.f, 0) + 1e-12 x FROM keys CROSS JOIN pairs
           LEFT JOIN r ON r.o = pairs.o AND r.d = pairs.d)""",
        "ins AS (SELECT p, d, sum(f) dsum FROM t GROUP BY p, d)",
        """lay AS (SELECT x0.p, x0.o, x0.d, x0.x, coalesce(osum, 0) osum, coalesce(dsum, 0) dsum FROM x0
           LEFT JOIN outs ON outs.p = x0.p AND outs.o = x0.o LEFT JOIN ins ON ins.p = x0.p AND ins.d = x0.d)""",
    ]
    last = "lay"
    for k in range(1, cycles + 1):
        steps.append(
            f"row{k} AS (SELECT p, o, d, osum, dsum, CASE WHEN s > 0 THEN x * osum / s ELSE 0 END x FROM "
            f"(SELECT *, sum(x) OVER (PARTITION BY p, o) s FROM {last}))"
        )
        steps.append(
            f"col{k} AS (SELECT p, o, d, osum, dsum, CASE WHEN s > 0 THEN x * dsum / s ELSE 0 END x FROM "
            f"(SELECT *, sum(x) OVER (PARTITION BY p, d) s FROM row{k}))"
        )
        last = f"col{k}"
    return fine(
        f"SELECT {GRID}, o origin, d destination, round(x * osum / s, 4) flow FROM "
        f"(SELECT *, sum(x) OVER (PARTITION BY p, o) s FROM {last}) WHERE osum > 0",
        OUTFLOWS, *steps,
    )


def loglik(law: str, betas: list[float], rows: str, keys: str, label: str) -> str:
    f = "pow(greatest(dist, 1e-12), -beta)" if law == "power" else "exp(-beta * dist)"
    grid = ", ".join(f"(CAST({b} AS DOUBLE))" for b in betas)
    joined = ", ".join(f"{rows}.{k}" for k in keys.split(", ") if k) + (", " if keys else "")
    return fine(
        f"SELECT {label}, beta, round(sum(f * ln(least(greatest(w / sw, 1e-300), 1.0))), 3) log_likelihood "
        f"FROM (SELECT {joined} prob.beta, {rows}.f, w, sw FROM {rows} JOIN prob ON prob.o = {rows}.o AND prob.d = {rows}.d) "
        "GROUP BY ALL",
        TRAIN,
        f"grid(beta) AS (VALUES {grid})",
        f"prob AS (SELECT beta, o, d, w, sum(w) OVER (PARTITION BY beta, o) sw FROM (SELECT beta, o, d, md * {f} w FROM pairs, grid))",
        "t0 AS (SELECT t.*, fold FROM t JOIN train ON train.o = t.o)",
    )


def bisection(keys: str, starts: str, flows: str, joined: str) -> tuple[str, ...]:
    """CTE ``beta(keys, law, beta)``: 45 bisections of the likelihood's slope per key and law.

    ``starts`` lists the keys, ``flows`` (keys without fold, o, d, f) and ``joined`` the condition that
    ties an origin's flow to a key.
    """
    own = ", ".join(f"b.{k}" for k in keys.split(", "))
    flow_keys = "".join(f"{k}, " for k in keys.split(", ") if k != "fold")
    return (
        "gp AS (SELECT o, d, md, 'power' law, ln(greatest(dist, 1e-12)) g FROM pairs "
        "UNION ALL SELECT o, d, md, 'exp', dist FROM pairs)",
        f"og AS (SELECT {flow_keys} law, q.o, sum(f) osum, sum(f * g) rg FROM {flows} q JOIN gp ON gp.o = q.o AND gp.d = q.d GROUP BY ALL)",
        f"bis AS (SELECT * FROM (SELECT {keys}, law, lo, hi, 0 step FROM ({starts}) s, "
        "(VALUES ('power', CAST(0.1 AS DOUBLE), CAST(3.0 AS DOUBLE)), ('exp', CAST(0.01 AS DOUBLE), CAST(2.0 AS DOUBLE))) v(law, lo, hi)) "
        f"UNION ALL SELECT {keys}, law, CASE WHEN slope > 0 THEN (lo + hi) / 2 ELSE lo END, "
        f"CASE WHEN slope > 0 THEN hi ELSE (lo + hi) / 2 END, step + 1 FROM (SELECT {keys}, law, lo, hi, step, "
        f"sum(osum * wg / sw - rg) slope FROM (SELECT {own}, b.law, lo, hi, step, gp.o, any_value(osum) osum, any_value(rg) rg, "
        "sum(md * exp(-(lo + hi) / 2 * g)) sw, sum(md * exp(-(lo + hi) / 2 * g) * g) wg "
        f"FROM bis b JOIN gp ON gp.law = b.law JOIN og ON og.law = b.law AND og.o = gp.o {joined} "
        "WHERE step < 45 GROUP BY ALL) GROUP BY ALL))",
        f"beta AS (SELECT {keys}, law, (lo + hi) / 2 beta FROM bis WHERE step = 45)",
    )


def condition_s_sql(columns: str, from_: str = "score JOIN more USING (p) JOIN sums USING (p)") -> str:
    return f"SELECT {columns} FROM {from_}"


COARSE = f"""{NATION_LINES},{NATION_ZONES},
cells AS (SELECT p, a.grp o, b.grp d, sum(f) f FROM lines JOIN z a ON a.zone = o JOIN z b ON b.zone = d GROUP BY ALL),
pairs AS (SELECT a.grp o, b.grp d, CAST(NULL AS DOUBLE) dist FROM (SELECT DISTINCT grp FROM z) a, (SELECT DISTINCT grp FROM z) b),
{targets_and_reference('1-URGENT')},{DENSE},{SCALED},{overlap_scores()}"""

FLOW_COLUMNS = "o origin, d destination, f flow"

def plain_laws(train: str) -> str:
    """Mean scores over folds of the fitted power law, 1/d and radiation, for training origins ``train(fold, o)``."""
    return fine(
        """SELECT 'grid' study_area, p target, law_model, round(avg(cpc), 6) "CPC", round(avg(cpl), 6) "CPL",
          round(avg(cpcd), 6) "CPCd", round(avg(r * r), 6) "R2", round(avg(nrmse), 6) "NRMSE", round(avg(coalesce(jsd, 0)), 6) "JSD"
          FROM score GROUP BY p, law_model""",
        OUTFLOWS,
        RADIATION.replace("weight AS", "rad AS"),
        train,
        *bisection("fold", "SELECT DISTINCT fold FROM train", "r", "JOIN train ON train.fold = b.fold AND train.o = gp.o"),
        """stays AS (
          SELECT q.fold, z.zone o, CASE WHEN train.o IS NOT NULL AND own.h IS NOT NULL THEN own.h ELSE
            (SELECT sum(CASE WHEN o = d THEN f ELSE 0 END) / sum(f) FROM r) END stay
          FROM (SELECT DISTINCT fold FROM train) q CROSS JOIN z
          LEFT JOIN train ON train.fold = q.fold AND train.o = z.zone LEFT JOIN own ON own.o = z.zone)""",
        """laws AS (
          SELECT fold, 'Gravity_power' law_model, o, d, md * pow(greatest(dist, 1e-12), -beta) w FROM pairs, beta WHERE law = 'power'
          UNION ALL SELECT fold, 'ClosedFormGravity', o, d, md / greatest(dist, 1e-12) FROM pairs, (SELECT DISTINCT fold FROM train)
          UNION ALL SELECT fold, 'Radiation', rad.o, d, CASE WHEN rad.o = d THEN stay ELSE w END FROM rad JOIN stays ON stays.o = rad.o)""",
        """hat AS (
          SELECT outs.p, fold, law_model, l.o, l.d, osum * w / sw f
          FROM (SELECT *, sum(w) OVER (PARTITION BY fold, law_model, o) sw FROM laws) l JOIN outs ON outs.o = l.o)""",
        """ab AS (
          SELECT k.p, k.fold, k.law_model, pairs.o, pairs.d, dist, coalesce(hat.f, 0) a, coalesce(t.f, 0) b
          FROM (SELECT DISTINCT p, fold, law_model FROM hat) k CROSS JOIN pairs
          LEFT JOIN hat ON hat.p = k.p AND hat.fold = k.fold AND hat.law_model = k.law_model AND hat.o = pairs.o AND hat.d = pairs.d
          LEFT JOIN t ON t.p = k.p AND t.o = pairs.o AND t.d = pairs.d)""",
        scores("p, fold, law_model"),
    )


AGREEMENT = f"""
nat AS (SELECT p, cpc x, cpc_rt - cpc dx FROM score JOIN more USING (p)),
czells AS (SELECT p, a.grp o, b.grp d, sum(f) f FROM cells JOIN z a ON a.zone = o JOIN z b ON b.zone = d GROUP BY ALL),
ct AS (SELECT * FROM czells WHERE p <> '1-URGENT'),
cr AS (SELECT o, d, f FROM czells WHERE p = '1-URGENT'),
csum AS (SELECT p, sum(f) st, (SELECT sum(f) FROM cr) sr FROM ct GROUP BY p),
cab AS (
  SELECT k.p, g.o, g.d, coalesce(ct.f, 0) a, st / sr * coalesce(cr.f, 0) b, st / sr * coalesce(ctr.f, 0) bt
  FROM csum k CROSS JOIN (SELECT DISTINCT a.grp o, b.grp d FROM z a, z b) g
  LEFT JOIN ct ON ct.p = k.p AND ct.o = g.o AND ct.d = g.d
  LEFT JOIN cr ON cr.o = g.o AND cr.d = g.d LEFT JOIN cr ctr ON ctr.o = g.d AND ctr.d = g.o),
coa AS (
  SELECT p, 2 * sum(least(a, b)) / (sum(a) + sum(b)) y,
         2 * sum(least(a, bt)) / (sum(a) + sum(bt)) - 2 * sum(least(a, b)) / (sum(a) + sum(b)) dy FROM cab GROUP BY p),
ranked AS (
  SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 rx,
         rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 ry, sign(dx) = sign(dy) same
  FROM nat JOIN coa USING (p))"""

MASK_SIZES = """
SELECT 'grid' study_area, fold, mask, CAST(CASE mask
  WHEN '1pct_edges' THEN least(greatest(floor(0.01 * n * n), 1), kept * n)
  WHEN '10pct_edges' THEN least(greatest(floor(0.10 * n * n), 1), kept * n)
  ELSE greatest(floor(0.10 * n), 1) * greatest(floor(0.10 * n), 1) END AS BIGINT) revealed
FROM (SELECT fold, count(*) kept FROM train GROUP BY fold), size,
  (VALUES ('1pct_edges'), ('10pct_edges'), ('10pct_zones')) v(mask)"""



def far_seeds(count: int) -> str:
    """Farthest-point seeds where hops are king moves on the grid, one CTE per seed."""
    steps = ["s0 AS (SELECT zone, k, x, y FROM z ORDER BY k LIMIT 1)", "u0 AS (SELECT *, 0 seed_no FROM s0)"]
    for i in range(1, count):
        steps.append(
            f"s{i} AS (SELECT z.zone, z.k, z.x, z.y FROM z, u{i - 1} u WHERE z.k NOT IN (SELECT k FROM u{i - 1}) "
            "GROUP BY ALL ORDER BY min(greatest(abs(z.x - u.x), abs(z.y - u.y))) DESC, z.k LIMIT 1)"
        )
        steps.append(f"u{i} AS (SELECT * FROM u{i - 1} UNION ALL SELECT *, {i} FROM s{i})")
    return fine(f"SELECT 'grid' study_area, seed_no, zone \"zone\" FROM u{count - 1}", *steps)


NEAR = "abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 AND a.zone <> b.zone"

SQL: dict[str, str] = {
    "read_raw": "SELECT event_type, count(*) n, round(sum(value), 2) total FROM events GROUP BY event_type",
    "partitions_round_trip": nation(
        f"SELECT {NATIONS}, o origin, d destination, sum(f) flow, count(*) n FROM lines GROUP BY p, o, d"
    ),
    "adjacency_round_trip": fine(f"SELECT 'grid' study_area, a.zone src, b.zone dst FROM z a JOIN z b ON {NEAR}"),
    "mapping_round_trip": fine("SELECT 'grid' study_area, zone \"zone\", grp \"group\" FROM z"),
    "blocks_round_trip": nation(
        "SELECT 'nations' study_area, f.block fold, b.zone \"zone\", CASE WHEN b.block = f.block THEN 'test' ELSE 'train' END role "
        "FROM nb b, (SELECT DISTINCT block FROM nb) f",
        "nb AS (SELECT zone, CAST(x / 10 AS INTEGER) block FROM z)",
    ),
    "scores_round_trip": nation(f'SELECT {NATIONS}, round(cpc, 6) "CPC" FROM score', DENSE, PLAIN_AB, scores()),
    "contiguous_merge_connected": fine(
        "SELECT 'grid' study_area, v.k realisation, n // 2 n_blocks, n // 2 n_connected FROM size, (VALUES (0), (1), (2)) v(k)"
    ),
    "flow_schema": vendor_a(
        "SELECT origen origin, destino destination, CASE WHEN abs(flow) < 1e-6 THEN 0 ELSE flow END flow, "
        "'raw' \"partition\", date FROM a"
    ),
    "partition_filter": nation(
        f"SELECT {NATIONS}, {FLOW_COLUMNS}, dt date FROM lines WHERE p = '2-HIGH'"
    ),
    "od_matrix_sparse": fine(f"SELECT {GRID}, {FLOW_COLUMNS} FROM cells"),
    "od_matrix_dense": fine(
        "SELECT 'grid' study_area, k.p \"partition\", pairs.o origin, pairs.d destination, coalesce(f, 0) flow "
        "FROM (SELECT DISTINCT p FROM cells) k CROSS JOIN pairs "
        "LEFT JOIN cells ON cells.p = k.p AND cells.o = pairs.o AND cells.d = pairs.d"
    ),
    "matrix_to_flows": fine(f"SELECT {GRID}, {FLOW_COLUMNS} FROM cells WHERE f <> 0"),
    "zone_clip": nation(
        f"SELECT {NATIONS}, dt date, o origin, d destination, sum(f) flow FROM lines "
        "WHERE o IN (SELECT zone FROM z WHERE grp IN ('g0', 'g1', 'g2')) "
        "AND d IN (SELECT zone FROM z WHERE grp IN ('g0', 'g1', 'g2')) GROUP BY ALL"
    ),
    "totals": nation(f"SELECT {NATIONS}, sum(f) total FROM lines GROUP BY ALL"),
    "od_margins": fine(
        "SELECT 'grid' study_area, coalesce(a.p, b.p) \"partition\", coalesce(o, d) \"zone\", "
        "coalesce(osum, 0) out_sum, coalesce(dsum, 0) in_sum "
        "FROM (SELECT p, o, sum(f) osum FROM lines GROUP BY ALL) a "
        "FULL JOIN (SELECT p, d, sum(f) dsum FROM lines GROUP BY ALL) b ON a.p = b.p AND a.o = b.d"
    ),
    "h_intra": nation(
        f"SELECT {NATIONS}, round(sum(CASE WHEN o = d THEN f ELSE 0 END) / sum(f), 6) h_intra FROM lines GROUP BY p"
    ),
    "inclusion": nation(
        "SELECT 'nations' study_area, n n_zones, round(h, 6) h_intra, n >= 25 AND h <= 0.7 included FROM "
        "(SELECT count(*) n FROM z), (SELECT sum(CASE WHEN o = d THEN f ELSE 0 END) / sum(f) h FROM lines)"
    ),
    "zone_distances": fine(
        "SELECT 'grid' study_area, o origin, d destination, round(dist, 6) distance FROM pairs"
    ),
    "length_band": fine(
        f"SELECT {GRID}, CASE WHEN dist < 0.5 THEN NULL WHEN dist < 2 THEN '0.5-2' WHEN dist < 10 THEN '2-10' "
        "WHEN dist < 50 THEN '10-50' ELSE '>50' END band, sum(f) flow, count(*) cells "
        "FROM cells JOIN pairs USING (o, d) GROUP BY ALL"
    ),
    "length_band_cells": fine(
        f"SELECT {GRID}, {FLOW_COLUMNS} FROM cells JOIN pairs USING (o, d) WHERE dist >= 2 AND dist < 10"
    ),
    "transpose": nation(f"SELECT {NATIONS}, d origin, o destination, f flow FROM cells"),
    "dissolve": fine(
        f"SELECT {GRID}, a.grp origin, b.grp destination, sum(f) flow "
        "FROM cells JOIN z a ON a.zone = o JOIN z b ON b.zone = d GROUP BY ALL"
    ),
    "cpc": nation(f'SELECT {NATIONS}, round(cpc, 6) "CPC" FROM score', DENSE, PLAIN_AB, scores()),
    "cpl": nation(f'SELECT {NATIONS}, round(cpl, 6) "CPL" FROM score', DENSE, PLAIN_AB, scores()),
    "length_histogram": nation(
        f"SELECT {NATIONS}, band length_bin, ha mass_a, hb mass_b FROM hist WHERE ha + hb > 0",
        DENSE, PLAIN_AB, scores(),
    ),
    "cpcd": nation(f'SELECT {NATIONS}, round(cpcd, 6) "CPCd" FROM score', DENSE, PLAIN_AB, scores()),
    "pearson_r2_log": nation(
        f'SELECT {NATIONS}, round(r, 6) pearson_r, round(r * r, 6) "R2" FROM score', DENSE, PLAIN_AB, scores()
    ),
    "nrmse": nation(f'SELECT {NATIONS}, round(nrmse, 6) "NRMSE" FROM score', DENSE, PLAIN_AB, scores()),
    "jsd": nation(f'SELECT {NATIONS}, round(jsd, 6) "JSD" FROM score', DENSE, PLAIN_AB, scores()),
    "delta_cpc": nation(
        f'SELECT {NATIONS}, round(st / sr, 6) "lambda", round(cpc, 6) "CPC_R", round(cpc_rt, 6) "CPC_RT", '
        'round(cpc_rt - cpc, 6) "Delta" FROM score JOIN more USING (p) JOIN sums USING (p)',
        DENSE, SCALED, overlap_scores(),
    ),
    "independence": nation(f"SELECT {NATIONS}, o origin, d destination, round(ind, 6) flow FROM ab", DENSE, SCALED),
    "score_pair": fine(f"SELECT {GRID}, {PAIR_COLUMNS} FROM score", DENSE, PLAIN_AB, scores()),
    "condition_s_scores": nation(
        condition_s_sql(f"{NATIONS}, {OVERLAP_COLUMNS}"), DENSE, SCALED, overlap_scores()
    ),
    "condition_s_fine": fine(condition_s_sql(f"{GRID}, {OVERLAP_COLUMNS}"), DENSE, SCALED, overlap_scores()),
    "day_scores": "WITH " + ",".join([
        NATION_LINES, NATION_ZONES, PAIRS,
        "dcells AS (SELECT p, dt, o, d, sum(f) f FROM lines GROUP BY ALL)",
        """dense AS (
          SELECT k.p, k.dt, pairs.o, pairs.d, dist, coalesce(t.f, 0) t, coalesce(r.f, 0) r, coalesce(rt.f, 0) rt
          FROM (SELECT DISTINCT p, dt FROM dcells WHERE p <> '1-URGENT' AND dt IN (SELECT dt FROM dcells WHERE p = '1-URGENT')) k CROSS JOIN pairs
          LEFT JOIN dcells t ON t.p = k.p AND t.dt = k.dt AND t.o = pairs.o AND t.d = pairs.d
          LEFT JOIN dcells r ON r.p = '1-URGENT' AND r.dt = k.dt AND r.o = pairs.o AND r.d = pairs.d
          LEFT JOIN dcells rt ON rt.p = '1-URGENT' AND rt.dt = k.dt AND rt.o = pairs.d AND rt.d = pairs.o)""",
        """sums AS (SELECT p, dt, sum(t) st, sum(r) sr, sum(CASE WHEN o = d THEN t ELSE 0 END) tr FROM dense GROUP BY p, dt)""",
        """ab AS (
          SELECT p, dt, o, d, dist, t a, st / sr * r b, st / sr * rt bt,
                 sum(t) OVER (PARTITION BY p, dt, o) * sum(t) OVER (PARTITION BY p, dt, d) / st ind
          FROM dense JOIN sums USING (p, dt))""",
        overlap_scores("p, dt"),
    ]) + f" SELECT {NATIONS}, dt date, {OVERLAP_COLUMNS.replace(', 6)', ', 9)')} FROM score JOIN more USING (p, dt) JOIN sums USING (p, dt) "
    f"UNION ALL SELECT DISTINCT {NATIONS}, dt, {', '.join(['CAST(NULL AS DOUBLE)'] * OVERLAP_COLUMNS.count('round('))}, true FROM dcells "
    "WHERE p <> '1-URGENT' AND dt NOT IN (SELECT dt FROM dcells WHERE p = '1-URGENT')",
    "day_bootstrap_means": nation(
        f"SELECT {NATIONS}, CAST(count(*) AS INTEGER) n_days, round(avg(\"CPC_R\"), 6) \"mean_CPC_R\", round(avg(lam), 6) \"mean_lambda\" "
        "FROM (SELECT t.p, t.dt, st / sr lam, CASE WHEN sr > 0 THEN sum(CASE WHEN rf > 0 THEN least(f, st / sr * rf) ELSE 0 END) / any_value(st) END \"CPC_R\" FROM "
        "(SELECT *, sum(f) OVER (PARTITION BY p, dt) st FROM dt_cells WHERE p <> '1-URGENT') t "
        "LEFT JOIN (SELECT dt, o, d, f rf FROM dt_cells WHERE p = '1-URGENT') r ON r.dt = t.dt AND r.o = t.o AND r.d = t.d "
        "LEFT JOIN (SELECT dt, sum(f) sr FROM dt_cells WHERE p = '1-URGENT' GROUP BY dt) w ON w.dt = t.dt GROUP BY t.p, t.dt, st, sr) GROUP BY p",
        "dt_cells AS (SELECT p, dt, o, d, sum(f) f FROM lines GROUP BY ALL)",
    ),
    "split_half": nation(
        f"SELECT {NATIONS}, round(2 * sum(least(a, b * sa / sb)) / (2 * any_value(sa)), 6) \"split_half_CPC\" "
        "FROM (SELECT *, sum(a) OVER (PARTITION BY p) sa, sum(b) OVER (PARTITION BY p) sb FROM halves) GROUP BY p",
        "days AS (SELECT DISTINCT p, dt y FROM lines)",
        "ranked AS (SELECT p, y, row_number() OVER (PARTITION BY p ORDER BY y) k, "
        "count(*) OVER (PARTITION BY p) // 2 h FROM days)",
        "halves AS (SELECT p, o, d, sum(CASE WHEN k <= h THEN f ELSE 0 END) a, "
        "sum(CASE WHEN k > h AND k <= 2 * h THEN f ELSE 0 END) b "
        "FROM (SELECT p, dt y, o, d, f FROM lines) JOIN ranked USING (p, y) GROUP BY p, o, d)",
    ),
    "activity_norm": vendor_a(f"SELECT {ACTIVITY} activity, count(*) n FROM a GROUP BY 1"),
    "purpose_period_label": vendor_a(f"SELECT {PURPOSE} || '|' || prd \"label\", count(*) n FROM a GROUP BY 1"),
    "weekday_am_filter": vendor_a(
        "SELECT origen origin, destino destination, date, hora \"hour\", actividad_origen activity_origin, "
        "actividad_destino activity_destination, estudio estudio_destino_posible, n_trips FROM a "
        "WHERE hora IN (7, 8, 9) AND isodow(cday) <= 5"
    ),
    "study_flag": vendor_a(
        "SELECT estudio estudio_destino_posible, coalesce(estudio = 'true', false) is_study, count(*) n FROM a GROUP BY ALL"
    ),
    "product_a_long": vendor_a(
        "SELECT origen origin, destino destination, CASE WHEN abs(flow) < 1e-6 THEN 0 ELSE flow END flow, "
        "'all_trips' \"partition\", cday date FROM a"
    ),
    "reference_r_a": vendor_a(
        "SELECT origen origin, destino destination, sum(flow) flow, "
        "CASE WHEN estudio = 'true' THEN 'study_AM' ELSE 'R_HBW_AM' END \"partition\", cday date FROM a "
        "WHERE hora IN (7, 8, 9) AND isodow(cday) <= 5 AND actividad_origen IN ('casa', 'home') "
        f"AND {ACTIVITY} = 'work_or_study' GROUP BY ALL"
    ),
    "purpose_time_cuts": vendor_a(
        f"SELECT origen origin, destino destination, sum(flow) flow, {PURPOSE} || '|' || prd \"partition\", "
        "cday date FROM a GROUP BY ALL"
    ),
    "purpose_and_day_cuts": vendor_a(
        f"SELECT {PURPOSE} || '|' || prd \"partition\", origen origin, destino destination, sum(flow) flow FROM a "
        "GROUP BY ALL UNION ALL SELECT CASE WHEN isodow(cday) <= 5 THEN 'weekday' ELSE 'weekend' END, "
        "origen, destino, sum(flow) FROM a GROUP BY ALL"
    ),
    "product_b_long": f"WITH {TRIPS_B} SELECT {FLOW_COLUMNS}, 'all_trips' \"partition\", CAST(NULL AS DATE) date FROM b",
    "morning_match": f"WITH {TRIPS_B} SELECT fascia \"FASCIA_ORARIA\", fascia <> 'sera' morning, "
    "fascia IN ('Mattina', '07-10') listed, count(*) n FROM b GROUP BY ALL",
    "reference_r_b": f"WITH {TRIPS_B} SELECT o origin, d destination, sum(f) flow, "
    "CASE motivo WHEN 'lavoro' THEN 'R_HBW_AM' ELSE 'study_heldout' END \"partition\" FROM b "
    "WHERE motivo = 'Studio' OR (motivo = 'lavoro' AND fascia <> 'sera') GROUP BY ALL",
    "row_probabilities": fine(
        "SELECT 'grid' study_area, o origin, d destination, round(w / sum(w) OVER (PARTITION BY o), 8) p "
        "FROM (SELECT o, d, md / dist w FROM pairs)"
    ),
    "row_softmax": fine(
        "SELECT 'grid' study_area, o origin, d destination, round(e / sum(e) OVER (PARTITION BY o), 8) p "
        "FROM (SELECT o, d, exp(-dist / 4) e FROM pairs)"
    ),
    "gravity_power_emit": emitted("md / dist"),
    "gravity_exp_emit": emitted("md * exp(-0.5 * dist)"),
    "closed_form_emit": emitted("md * exp(-dist / 3) / (1 + dist)"),
    "net_fallback_emit": emitted("greatest(pd, 1e-6) / greatest(dist, 1e-6)"),
    "radiation_disk": fine(
        "SELECT 'grid' study_area, o origin, d destination, s disk_mass FROM disk", DISK
    ),
    "radiation_emit": fine(EMIT, OUTFLOWS, RADIATION),
    "radiation_folds": fine(
        "SELECT 'grid' study_area, fold, zone origin, u.d destination, "
        "round(CASE WHEN u.d = zone THEN stay ELSE u.w END / (stay + off), 6) p FROM ("
        "SELECT f.fold, z.zone, CASE WHEN train.o IS NOT NULL AND own.h IS NOT NULL THEN own.h ELSE "
        "(SELECT sum(CASE WHEN o = d THEN f ELSE 0 END) / sum(f) FROM r) END stay, off "
        "FROM (SELECT DISTINCT fold FROM train) f CROSS JOIN z LEFT JOIN train ON train.fold = f.fold AND train.o = z.zone "
        "LEFT JOIN own ON own.o = z.zone "
        "JOIN (SELECT o, sum(w) off FROM weight WHERE o <> d GROUP BY o) q ON q.o = z.zone) "
        "JOIN weight u ON u.o = zone",
        RADIATION, TRAIN,
    ),
    "production_check": fine(
        f"SELECT {GRID}, count(*) origins, CAST(0 AS BIGINT) bad FROM outs GROUP BY p", OUTFLOWS
    ),
    "condition_g_score": fine(
        f"SELECT {GRID}, {PAIR_COLUMNS} FROM score",
        OUTFLOWS,
        "weight AS (SELECT o, d, md / dist w FROM pairs)",
        "hat AS (SELECT outs.p, x.o, x.d, osum * w / sw f FROM "
        "(SELECT *, sum(w) OVER (PARTITION BY o) sw FROM weight) x JOIN outs ON outs.o = x.o)",
        "ab AS (SELECT keys.p, pairs.o, pairs.d, dist, coalesce(hat.f, 0) a, coalesce(t.f, 0) b FROM keys CROSS JOIN pairs "
        "LEFT JOIN hat ON hat.p = keys.p AND hat.o = pairs.o AND hat.d = pairs.d "
        "LEFT JOIN t ON t.p = keys.p AND t.o = pairs.o AND t.d = pairs.d)",
        scores(),
    ),
    "learned_row_sums": row_sums_of(
        "meta-Gravity", "neuroGravity_zeroshot", "neuroGravity_1pct_edges", "neuroGravity_10pct_edges", "neuroGravity_10pct_zones"
    ),
    "forest_row_sums": row_sums_of("RandomForest"),
    "generator_mechanism": nation(
        f"SELECT {NATIONS}, 0 fold, law_model, true scored FROM (SELECT DISTINCT p FROM t) CROSS JOIN (VALUES ('Gravity_power'), ('Gravity_exp'), "
        "('Radiation'), ('Oracle'), ('meta-Gravity'), ('IPF_G-row'), ('IPF_G-row-traincol'), ('ClosedFormGravity'), ('DeepGravity'), ('RandomForest'), "
        "('neuroGravity_zeroshot'), ('neuroGravity_1pct_edges'), ('neuroGravity_10pct_edges'), ('neuroGravity_10pct_zones')) laws(law_model)"
    ),
    "gravity_loglik_grid": loglik(
        "power", [0.1, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0], "r", "", "'grid' study_area"
    ),
    "gravity_loglik_exp_grid": loglik("exp", [0.01, 0.1, 0.5], "t0", "p, fold", f"{GRID}, fold"),
    "gravity_fit": fine(
        "SELECT 'grid' study_area, fold, law, round(beta, 4) beta, true settled FROM beta",
        TRAIN,
        *bisection("fold", "SELECT DISTINCT fold FROM train", "r", "JOIN train ON train.fold = b.fold AND train.o = gp.o"),
    ),
    "oracle_gravity": fine(
        f"SELECT {GRID.replace('p ', 'outs.p ')}, 0 fold, 'power' law, x.o origin, x.d destination, round(osum * w / sw, 6) flow "
        "FROM (SELECT *, sum(w) OVER (PARTITION BY p, o) sw FROM (SELECT p, o, d, md * pow(greatest(dist, 1e-12), -beta) w "
        "FROM pairs, beta WHERE law = 'power')) x JOIN outs ON outs.p = x.p AND outs.o = x.o",
        OUTFLOWS,
        *bisection("p", "SELECT p FROM keys", "t", "AND og.p = b.p"),
    ),
    "ipf_fixed_cycles": ipf_cycles(3),
    "ipf_train_columns": fine(
        "SELECT 'grid' study_area, q.fold, osum.p \"partition\", z.zone destination, "
        "round(osum.s * coalesce(c, 0) / whole, 6) in_sum FROM (SELECT fold, sum(f) whole FROM r JOIN train USING (o) GROUP BY fold) q "
        "CROSS JOIN z CROSS JOIN (SELECT p, sum(f) s FROM t GROUP BY p) osum "
        "LEFT JOIN (SELECT fold, d, sum(f) c FROM r JOIN train USING (o) GROUP BY fold, d) k ON k.fold = q.fold AND k.d = z.zone",
        TRAIN,
    ),
    "origin_holdout_sizes": fine(
        "SELECT 'grid' study_area, role, n FROM (SELECT 'test' role, n // 5 n FROM size UNION ALL SELECT 'train', n - n // 5 FROM size)"
    ),
    "weighted_draw_counts": fine(
        f"SELECT {GRID}, o origin, CAST(greatest(floor(sum(f)), 1) AS BIGINT) draws FROM cells WHERE f > 0 GROUP BY p, o"
    ),
    "capped_destination_counts": fine(
        "SELECT 'grid' study_area, zone origin, CAST(greatest(least(40, n), coalesce(c, 0)) AS BIGINT) kept, "
        "CAST(coalesce(c, 0) AS BIGINT) with_flow FROM z CROSS JOIN size "
        "LEFT JOIN (SELECT o, count(*) c FROM r WHERE f > 0 GROUP BY o) q ON q.o = zone"
    ),
    "reveal_mask_sizes": fine(MASK_SIZES, TRAIN),
    "queen_degrees": fine(
        f"SELECT 'grid' study_area, a.zone \"zone\", count(*) degree FROM z a JOIN z b ON {NEAR} GROUP BY a.zone"
    ),
    "bfs_hops": fine(
        "SELECT 'grid' study_area, zone \"zone\", CAST(min(hops) AS INTEGER) hops FROM walk GROUP BY zone",
        f"near AS (SELECT a.zone src, b.zone dst FROM z a JOIN z b ON {NEAR})",
        "walk AS (SELECT '0' zone, 0 hops UNION SELECT dst, hops + 1 FROM walk JOIN near ON src = zone "
        "WHERE hops < (SELECT w FROM size))",
    ),
    "fps_seeds": far_seeds(5),
    "block_quality": "SELECT 'grid' study_area, CAST(5 AS BIGINT) n_blocks, "
    "CAST(CASE WHEN count(*) % 5 = 0 THEN 0 ELSE 1 END AS BIGINT) size_spread FROM supplier",
    "folds": fine(
        "SELECT 'grid' study_area, f.block fold, b.zone \"zone\", CASE WHEN b.block = f.block THEN 'test' ELSE 'train' END role "
        "FROM blocks b, (SELECT DISTINCT block FROM blocks) f",
        BLOCKS,
    ),
    "size_guard": "SELECT 'grid' study_area, count(*) n_zones, count(*) >= 80 mechanism_ok FROM supplier "
    "UNION ALL SELECT 'nations', count(*), count(*) >= 80 FROM nation",
    "contiguous_merge_sizes": fine(
        "SELECT 'grid' study_area, v.k realisation, p \"partition\", sum(f) total, any_value(n // 2) \"groups\" "
        "FROM lines, size, (VALUES (0), (1), (2)) v(k) GROUP BY v.k, p"
    ),
    "condition_s_coarse": f"WITH {COARSE} " + condition_s_sql(
        f"{NATIONS}, " + OVERLAP_COLUMNS.replace("round(cpcd, 6)", "CAST(NULL AS DOUBLE)")
    ),
    "scale_spearman": nation(
        "SELECT 'nations' study_area, round(covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)), 6) \"spearman_CPC\", "
        "round(avg(CASE WHEN same THEN 1.0 ELSE 0.0 END), 6) frac_delta_sign_kept FROM ranked",
        DENSE, SCALED, overlap_scores(), AGREEMENT,
    ),
    "report_table1": nation(
        "SELECT 'nations' study_area, 'orders' product, n \"N\", round(h, 6) h_intra, days, 'priority' attributes_present FROM "
        "(SELECT count(*) n FROM z), (SELECT sum(CASE WHEN o = d THEN f ELSE 0 END) / sum(f) h, count(DISTINCT dt) AS days FROM lines)"
    ),
    "report_table2": nation(
        condition_s_sql(
            f'{NATIONS}, round(st / sr, 6) "lambda", round(cpc, 6) "CPC_T_lambdaR", round(cpc_rt, 6) "CPC_T_lambdaRT", '
            'round(cpc_rt - cpc, 6) "Delta", round(cpl, 6) "CPL", round(cpcd, 6) "CPCd", round(r * r, 6) "R2", '
            'round(nrmse, 6) "NRMSE", round(coalesce(jsd, 0), 6) "JSD"'
        ),
        DENSE, SCALED, overlap_scores(),
    ),
    "report_table3": "WITH " + ",".join([
        NATION_LINES.replace("lines AS", "raw AS"),
        "lines AS (SELECT o, d, f, CASE WHEN p = '1-URGENT' THEN p WHEN isodow(dt) <= 5 THEN 'weekday' ELSE 'weekend' END p FROM raw)",
        NATION_ZONES, CELLS, PAIRS, targets_and_reference("1-URGENT"), DENSE, SCALED, overlap_scores(),
    ]) + " " + condition_s_sql(
        f'{NATIONS}, round(st / sr, 6) "lambda", round(cpc, 6) "CPC_T_lambdaR", round(cpc_rt - cpc, 6) "Delta", '
        'round(cpl, 6) "CPL", round(cpcd, 6) "CPCd", round(r * r, 6) "R2", round(nrmse, 6) "NRMSE", '
        'round(coalesce(jsd, 0), 6) "JSD"'
    ),
    "report_table4": "WITH " + ",".join([
        FINE_LINES, FINE_ZONES, PAIRS,
        """banded AS (
          SELECT CASE WHEN dist < 2 THEN '0.5-2' WHEN dist < 10 THEN '2-10' WHEN dist < 50 THEN '10-50' ELSE '>50' END band,
                 lines.p, lines.o, lines.d, f FROM lines JOIN pairs ON pairs.o = lines.o AND pairs.d = lines.d WHERE dist >= 0.5)""",
        "t AS (SELECT band p, o, d, sum(f) f FROM banded WHERE p <> 'A' GROUP BY ALL)",
        "rb AS (SELECT band p, o, d, sum(f) f FROM banded WHERE p = 'A' GROUP BY ALL)",
        """dense AS (
          SELECT k.p, pairs.o, pairs.d, dist, coalesce(t.f, 0) t, coalesce(r.f, 0) r, coalesce(rt.f, 0) rt
          FROM (SELECT DISTINCT p FROM t) k CROSS JOIN pairs
          LEFT JOIN t ON t.p = k.p AND t.o = pairs.o AND t.d = pairs.d
          LEFT JOIN rb r ON r.p = k.p AND r.o = pairs.o AND r.d = pairs.d
          LEFT JOIN rb rt ON rt.p = k.p AND rt.o = pairs.d AND rt.d = pairs.o)""",
        SCALED, overlap_scores(),
    ]) + " SELECT 'grid' study_area, p band, round(cpc, 6) \"CPC\", round(cpl, 6) \"CPL\", round(cpcd, 6) \"CPCd\", "
    'round(r * r, 6) "R2", round(nrmse, 6) "NRMSE", round(coalesce(jsd, 0), 6) "JSD" FROM score',
    "report_table5": "WITH " + ",".join([
        TRIPS_A, NATION_ZONES, PAIRS,
        f"t AS (SELECT {ACTIVITY} p, origen o, destino d, sum(flow) f FROM a GROUP BY ALL)",
        "r AS (SELECT origen o, destino d, sum(flow) f FROM a WHERE prd = 'AM' GROUP BY ALL)",
        "keys AS (SELECT DISTINCT p FROM t)", DENSE, SCALED, overlap_scores(),
    ]) + " " + condition_s_sql(
        f'{NATIONS}, round(cpc, 6) "CPC", round(cpc_rt - cpc, 6) "Delta", round(cpl, 6) "CPL", round(cpcd, 6) "CPCd", '
        'round(r * r, 6) "R2", round(nrmse, 6) "NRMSE", round(coalesce(jsd, 0), 6) "JSD"'
    ),
    "report_table6": plain_laws(TRAIN),
    "report_table7": plain_laws("train AS (SELECT 0 fold, zone o FROM z)"),
    "report_table8": nation(
        "SELECT 'nations' study_area, 'regions' scale_layer, "
        "round(covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)), 6) \"spearman_CPC\", "
        "round(avg(CASE WHEN same THEN 1.0 ELSE 0.0 END), 6) frac_delta_sign_kept FROM ranked",
        DENSE, SCALED, overlap_scores(), AGREEMENT,
    ),
}
