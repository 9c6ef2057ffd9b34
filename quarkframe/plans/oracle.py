"""Independent SQL (DuckDB dialect, ANSI where possible) for every query.

The oracle works on the *flat* tables: an event is an ``orders`` row, its
particles are ``lineitem`` rows joined by key, pairs are a self-join on the
event key, leading objects come from ``row_number()``. It shares nothing with
the Spark plans except the fixed constants (mapping formulas, masses,
histogram ranges), which are spliced in with ``repr`` so both engines see
bit-identical literals.
"""

from __future__ import annotations

from ..functions import kinematics as K
from ..functions.histogram import Bin, nan_bin
from ..functions.rounding import EXACT
from .benchmark import CANDIDATE_BINS, PAIR_BINS, PAIR_MASS2_WIDE


def _f(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


MM = _f(K.MUON_MASS * K.MUON_MASS)

PARTICLES = f"""
p AS (
  SELECT l_orderkey AS evt,
         CASE WHEN l_returnflag = 'A' THEN 1 ELSE -1 END AS qx3,
         CAST(l_extendedprice / {_f(1000.0)} AS FLOAT) AS pt,
         CAST((l_suppkey % 97 - 48) / {_f(20.0)} + {_f(0.013)} AS FLOAT) AS eta,
         CAST((l_partkey % 127 - 63) / {_f(20.0)} + {_f(0.017)} AS FLOAT) AS phi,
         CAST(l_tax AS FLOAT) AS mass,
         CAST(l_discount AS FLOAT) AS vx, CAST(l_tax AS FLOAT) AS vy, CAST(l_quantity AS FLOAT) AS vz,
         -13 * (CASE WHEN l_returnflag = 'A' THEN 1 ELSE -1 END) AS pdfId,
         1 AS status,
         CAST(l_suppkey % 4 AS INTEGER) AS kind
  FROM lineitem
  WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
),
ev AS (
  SELECT o.o_orderkey AS evt, COUNT(p.evt) AS n
  FROM orders o LEFT JOIN p ON p.evt = o.o_orderkey
  GROUP BY o.o_orderkey
)"""

# four-vector of one particle (same operation order as functions.kinematics.p4)
P4 = f"""
v AS (
  SELECT evt, pt, eta, phi, px, py, pz,
         sqrt(px * px + py * py + pz * pz + {MM}) AS e
  FROM (
    SELECT evt, pt, eta, phi,
           abs(CAST(pt AS DOUBLE)) * cos(CAST(phi AS DOUBLE)) AS px,
           abs(CAST(pt AS DOUBLE)) * sin(CAST(phi AS DOUBLE)) AS py,
           abs(CAST(pt AS DOUBLE)) / tan({_f(2.0)} * atan(exp(-CAST(eta AS DOUBLE)))) AS pz
    FROM p
  ) q
)"""


def pair_derived(prefix: str = "") -> str:
    e, px, py, pz = (f"{prefix}{c}" for c in ("e", "px", "py", "pz"))
    mass2 = f"({e} * {e} - {px} * {px} - {py} * {py} - {pz} * {pz})"
    pt = f"sqrt(CAST({px} * {px} + {py} * {py} AS DOUBLE))"
    quotient = lambda a, b: f"CAST(CAST(CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) AS FLOAT) AS DOUBLE)"
    phi = f"(CASE WHEN {px} = 0 THEN {_f(K.PHI_AT_ZERO_PX)} ELSE atan({quotient(py, px)}) END)"
    num, den = f"({e} + {pz})", f"({e} - {pz})"
    q = quotient(num, den)
    eta = (f"(CASE WHEN {den} = 0 THEN (CASE WHEN {num} > 0 THEN CAST('inf' AS DOUBLE) "
           f"WHEN {num} < 0 THEN CAST('-inf' AS DOUBLE) ELSE CAST('nan' AS DOUBLE) END) "
           f"WHEN {q} = 0 THEN CAST('-inf' AS DOUBLE) "
           f"WHEN {q} < 0 THEN CAST('nan' AS DOUBLE) "
           f"ELSE {_f(0.5)} * ln({q}) END)")
    return f"{mass2} AS mass2, {pt} AS pt, {phi} AS phi, {eta} AS eta"


def bin_sql(x: str, b: Bin) -> str:
    x = f"CAST({x} AS DOUBLE)"
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN isnan({x}) THEN {nan_bin(b.n)} "
            f"WHEN {x} < {_f(b.lo)} THEN -1 WHEN {x} >= {_f(b.hi)} THEN {b.n} "
            f"ELSE CAST(floor({_f(b.n)} * ({x} - {_f(b.lo)}) / {_f(float(b.hi) - float(b.lo))}) AS INTEGER) END")


def edges_sql(b: Bin) -> str:
    w = _f((float(b.hi) - float(b.lo)) / float(b.n))
    lo = (f"CASE WHEN bin = -1 THEN NULL WHEN bin = {b.n} THEN {_f(b.hi)} WHEN bin = {nan_bin(b.n)} THEN NULL "
          f"ELSE round({_f(b.lo)} + bin * {w}, 6) END")
    hi = (f"CASE WHEN bin = -1 THEN {_f(b.lo)} WHEN bin >= {b.n} THEN NULL "
          f"ELSE round({_f(b.lo)} + (bin + 1) * {w}, 6) END")
    return f"{lo} AS lo, {hi} AS hi"


def bundle_sql(source: str, bins: list[Bin]) -> str:
    """Histogram table from a relation ``source`` holding the bin inputs."""
    parts = []
    for b in bins:
        parts.append(
            f"SELECT '{b.label}' AS label, bin, {edges_sql(b)}, CAST(COUNT(*) AS BIGINT) AS n FROM "
            f"(SELECT {bin_sql(b.value, b)} AS bin FROM {source}) t WHERE bin IS NOT NULL GROUP BY bin")
    return "\nUNION ALL\n".join(parts)


def fround(x: str, digits: int) -> str:
    """Same rounding as functions.rounding (floor(x*10^d + 0.5)/10^d below EXACT/10^d)."""
    s = _f(10.0 ** digits)
    v = f"CAST({x} AS DOUBLE)"
    return f"(CASE WHEN abs({v}) < {_f(EXACT / 10 ** digits)} THEN floor({v} * {s} + {_f(0.5)}) / {s} ELSE {v} END)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


PAIRS = f"""
pairs AS (
  SELECT a.evt, CAST(a.e + b.e AS FLOAT) AS e, CAST(a.px + b.px AS FLOAT) AS px,
         CAST(a.py + b.py AS FLOAT) AS py, CAST(a.pz + b.pz AS FLOAT) AS pz
  FROM v a JOIN v b ON a.evt = b.evt
  WHERE a.evt IN (SELECT evt FROM ev WHERE n >= 2)
),
pq AS (SELECT evt, e, px, py, pz, {pair_derived()} FROM pairs)"""

# top-2 muons by raw pt (ties by eta, phi) per event with >= 2 muons
TOP2 = f"""
ranked AS (
  SELECT v.*, row_number() OVER (PARTITION BY evt ORDER BY pt DESC, eta DESC, phi DESC) AS rn
  FROM v WHERE evt IN (SELECT evt FROM ev WHERE n >= 2)
),
top2 AS (
  SELECT a.evt, CAST(a.e + b.e AS FLOAT) AS e, CAST(a.px + b.px AS FLOAT) AS px,
         CAST(a.py + b.py AS FLOAT) AS py, CAST(a.pz + b.pz AS FLOAT) AS pz
  FROM ranked a JOIN ranked b ON a.evt = b.evt AND a.rn = 1 AND b.rn = 2
),
t2 AS (SELECT evt, e, px, py, pz, {pair_derived()} FROM top2)"""


def _sums(cols: list[str], src: str, where: str) -> str:
    s = ", ".join(f"round(SUM(CAST({c} AS DOUBLE)), 3) AS sum_{c}" for c in cols)
    return f"SELECT {s} FROM {src} WHERE {where}"


BASE = with_(PARTICLES)
BASE_V = with_(PARTICLES, P4)

SQL: dict[str, str] = {
    "b1_count_events": "SELECT COUNT(*) AS n_events FROM orders",
    "b2_count_pt": BASE + "SELECT COUNT(*) AS n_pt FROM p",
    "b2_sum_pt_lt10": BASE + _sums(["pt"], "p", "pt < 10"),
    "b3_sum_triple_eta_neg": BASE + _sums(["pt", "eta", "phi"], "p", "eta < 0"),
    "b3_sum_triple_phi_pos": BASE + _sums(["pt", "eta", "phi"], "p", "phi > 0"),
    "b3_sum_sqrt_pt": BASE + "SELECT round(SUM(sqrt(CAST(pt AS DOUBLE))), 3) AS sum_sqrt_pt FROM p WHERE phi > 0",
    "b3_describe_sqrt_pt": BASE + (
        "SELECT COUNT(s) AS n, round(AVG(s), 6) AS mean, round(STDDEV_SAMP(s), 6) AS stddev, "
        "round(MIN(s), 6) AS min, round(MAX(s), 6) AS max "
        "FROM (SELECT sqrt(CAST(pt AS DOUBLE)) AS s FROM p WHERE phi > 0) t"),
    "b4_count_events": "SELECT COUNT(*) AS n_events FROM orders",
    "b4_count_n_gt2": BASE + "SELECT COUNT(*) AS n_events FROM ev WHERE n > 2",
    "b4_count_n_eq1": BASE + "SELECT COUNT(*) AS n_events FROM ev WHERE n = 1",
    "b4_count_n_eq2": BASE + "SELECT COUNT(*) AS n_events FROM ev WHERE n = 2",
    "b4_size_histogram": BASE + (
        "SELECT CAST(n AS INTEGER) AS n_muons, COUNT(*) AS n_events FROM ev GROUP BY n"),
    "b4_sum_of_group_counts": BASE + (
        "SELECT CAST(SUM(c) AS BIGINT) AS n_events FROM (SELECT COUNT(*) AS c FROM ev GROUP BY n) t"),
    "b4_count_particles_eq2": BASE + (
        "SELECT COUNT(*) AS n_particles FROM p WHERE evt IN (SELECT evt FROM ev WHERE n = 2)"),
    "b4_max_pt_particle": BASE + (
        "SELECT evt, qx3, pt, eta, phi, mass, pdfId, status FROM p "
        "WHERE evt IN (SELECT evt FROM ev WHERE n = 2) "
        "ORDER BY pt DESC, eta DESC, phi DESC, evt DESC LIMIT 1"),
    "b4_foreach_eq2": BASE + (
        f"SELECT evt, pt, {fround('CAST(pt AS DOUBLE) * CAST(pt AS DOUBLE)', 4)} AS pt_sq FROM p "
        "WHERE evt IN (SELECT evt FROM ev WHERE n = 2)"),
    "b4_cut_particles": BASE + (
        f"SELECT evt, pt, eta, {fround('CAST(pt AS DOUBLE) * CAST(pt AS DOUBLE)', 4)} AS pt_sq FROM p "
        f"WHERE evt IN (SELECT evt FROM ev WHERE n = 2) AND pt > {_f(10.0)} AND eta < {_f(2.4)}"),
    "b4_max_pair_mass2": with_(PARTICLES, P4, TOP2) + f"SELECT {fround('MAX(mass2)', 4)} AS max_mass2 FROM t2",
    "b4_top2_pair_products": with_(PARTICLES, P4, TOP2) + (
        f"SELECT evt, {fround('e', 4)} AS e, {fround('mass2', 4)} AS mass2, "
        f"{fround('mass2 * e', 2)} AS mass_e FROM t2"),
    "b5_count_events": "SELECT COUNT(*) AS n_events FROM orders",
    "b5_muon_bundle_gt0": BASE + bundle_sql("p", CANDIDATE_BINS),
    "b5_muon_bundle_eq2": BASE + bundle_sql("(SELECT * FROM p WHERE evt IN (SELECT evt FROM ev WHERE n = 2))",
                                             CANDIDATE_BINS),
    "b5_pair_bundle": with_(PARTICLES, P4, PAIRS) + bundle_sql("pq", PAIR_BINS),
    "b6_muon_bundle": BASE + bundle_sql("p", CANDIDATE_BINS),
    "b6_pair_bundle": with_(PARTICLES, P4, PAIRS) + bundle_sql("pq", PAIR_BINS),
    "pair_mass2_wide": with_(PARTICLES, P4, PAIRS) + bundle_sql("pq", [PAIR_MASS2_WIDE]),
}
SQL["b5_count_eq2"] = SQL["b4_count_n_eq2"]
SQL["b5_group_count_sum"] = SQL["b4_sum_of_group_counts"]


# ------------------------------------------------------------------ examples

def higgs_sql(a: str, b: str) -> str:
    """Two-muon mass of the Higgs example (same operation order as Spark)."""
    def comps(x):
        pt, eta, phi = (f"CAST({x}.{c} AS DOUBLE)" for c in ("pt", "eta", "phi"))
        return f"({pt} * cos({phi}))", f"({pt} * sin({phi}))", f"({pt} * sinh({eta}))"
    px1, py1, pz1 = comps(a)
    px2, py2, pz2 = comps(b)
    m2 = _f(K.HIGGS_MUON_MASS * K.HIGGS_MUON_MASS)
    en1 = f"({px1} * {px1} + {py1} * {py1} + {pz1} * {pz1} + {m2})"
    en2 = f"({px2} * {px2} + {py2} * {py2} + {pz2} * {pz2} + {m2})"
    s = (f"(({en1} + {en2}) * ({en1} + {en2}) - ({px1} + {px2}) * ({px1} + {px2}) "
         f"- ({py1} + {py2}) * ({py1} + {py2}) - ({pz1} + {pz2}) * ({pz1} + {pz2}))")
    return f"(CASE WHEN {s} >= 0 THEN sqrt({s}) WHEN {s} < 0 THEN CAST('nan' AS DOUBLE) END)"


# first elements in stored order (eta, phi, pt descending) of all, electrons, photons
RANKS = "\n," .join(f"""
{name} AS (SELECT evt, pt, eta, phi, row_number() OVER (PARTITION BY evt ORDER BY eta DESC, phi DESC, pt DESC) AS rn
       FROM p{where})""" for name, where in (("rm", ""), ("re", " WHERE kind = 1"), ("rg", " WHERE kind = 0")))

HIGGS = f"""
h AS (
  SELECT e1.evt, e1.pt AS electron_pt, m1.pt AS muon_pt, m1.phi AS muon_phi, m1.eta AS muon_eta,
         CASE WHEN m2.evt IS NULL THEN NULL ELSE {higgs_sql("m1", "m2")} END AS dimuon_mass
  FROM re e1
  LEFT JOIN rm m1 ON m1.evt = e1.evt AND m1.rn = 1
  LEFT JOIN rm m2 ON m2.evt = e1.evt AND m2.rn = 2
  WHERE e1.rn = 1
)"""

_COLL_KIND = {"photons": 0, "electrons": 1, "jets": 2, "met": 3}
_STRIPPED = {"qx3": "qx3", "pt": "pt", "eta": "eta", "phi": "phi", "mass": "mass", "x": "vx", "y": "vy", "z": "vz",
             "pdfId": "pdfId", "status": "status"}
STRIP_SUMMARY = BASE + (
    "SELECT evt, CAST(COUNT(*) AS INTEGER) AS n_muons, "
    + ", ".join(f"CAST(COUNT(CASE WHEN kind = {k} THEN 1 END) AS INTEGER) AS n_{c}" for c, k in _COLL_KIND.items())
    + ", " + ", ".join(f"{fround(f'SUM(CAST({c} AS DOUBLE))', 3)} AS sum_{n}_muons" for n, c in _STRIPPED.items())
    + ", " + ", ".join(
        f"{fround(f'COALESCE(SUM(CASE WHEN kind = {k} THEN CAST(pt AS DOUBLE) END), 0)', 3)} AS sum_pt_{c}"
        for c, k in _COLL_KIND.items())
    + " FROM p WHERE evt IN (SELECT evt FROM ev WHERE n >= 2) GROUP BY evt")

from .examples import HIGGS_RANGES, PHOTON_RANGES  # noqa: E402

SQL.update({
    "reduction_pairs": with_(PARTICLES, P4, PAIRS) + (
        "SELECT evt, " + ", ".join(f"{fround(c, 4)} AS {c}" for c in
                                   ("e", "px", "py", "pz", "mass2", "pt", "phi", "eta")) + " FROM pq"),
    "reduction_job": with_(PARTICLES, P4, PAIRS) + bundle_sql("pq", PAIR_BINS),
    "strip_events": STRIP_SUMMARY,
    "sink_parquet_roundtrip": STRIP_SUMMARY,
    "sink_hist_json": SQL["b6_muon_bundle"],
    "higgs_lead_bundle": with_(PARTICLES, RANKS, HIGGS) + bundle_sql(
        "h", [Bin(k, *HIGGS_RANGES[k], k) for k in HIGGS_RANGES]),
    "photon_lead_bundle": with_(PARTICLES, RANKS) + bundle_sql(
        "(SELECT * FROM rg WHERE rn = 1)", [Bin(k, *PHOTON_RANGES[k], k) for k in PHOTON_RANGES]),
    "lead_pair_mass": with_(PARTICLES, P4, TOP2) + (
        "SELECT a.evt, " + fround(higgs_sql("a", "b"), 4) + " AS higgs_mass, "
        + fround("sqrt(greatest((a.e + b.e) * (a.e + b.e) - (a.px + b.px) * (a.px + b.px) "
                 "- (a.py + b.py) * (a.py + b.py) - (a.pz + b.pz) * (a.pz + b.pz), 0))", 6) + " AS inv_mass "
        "FROM ranked a JOIN ranked b ON a.evt = b.evt AND a.rn = 1 AND b.rn = 2"),
    "aod_path_sum_pt_lt10": SQL["b2_sum_pt_lt10"],
})


# ------------------------------------------------------------------ metrics

from ..operators.metrics import FIXED_EXECUTORS, FIXED_THREADS, SERIES, TOTALS  # noqa: E402

_MS = "date_diff('millisecond', TIMESTAMP '1970-01-01 00:00:00', CAST({c} AS TIMESTAMP))"

MTABLES = f"""
jobs AS (
  SELECT 'tables' AS run, o_orderkey AS job_id, o_orderpriority AS group_id,
         {_MS.format(c="o_orderdate")} AS start_ms,
         {_MS.format(c="o_orderdate")} + CAST(floor(o_totalprice) AS BIGINT) AS end_ms,
         CASE WHEN o_custkey % 2 = 0 THEN 14 ELSE 7 END AS n_exec,
         CASE WHEN o_custkey % 3 = 0 THEN 70 ELSE 35 END AS n_thread
  FROM orders
),
tasks AS (
  SELECT l_orderkey AS job_id, CAST(l_linenumber AS BIGINT) AS stage_id, l_partkey AS task_id,
         CAST(l_suppkey AS VARCHAR) AS executor_id,
         CAST(floor(l_extendedprice) AS BIGINT) AS duration,
         {_MS.format(c="l_shipdate")} AS launch,
         {_MS.format(c="l_shipdate")} + CAST(floor(l_extendedprice) AS BIGINT) AS finish,
         CAST(floor(l_discount * 100) AS BIGINT) AS getting_result,
         CAST(floor(CAST(floor(l_extendedprice) AS BIGINT) * (1 - l_tax)) AS BIGINT) AS run_ms,
         CAST(floor(CAST(floor(l_extendedprice) AS BIGINT) * (1 - l_discount) * {_f(1e6)}) AS BIGINT) AS cpu_ns,
         CAST(floor(l_tax * CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS gc_ms,
         CAST(floor(l_quantity) AS BIGINT) AS deser_ms,
         CAST(floor(l_quantity * (1 - l_discount) * {_f(1e6)}) AS BIGINT) AS deser_cpu_ns,
         CAST(l_linenumber AS BIGINT) AS ser_ms
  FROM lineitem
),
stages AS (
  SELECT s.job_id, s.stage_id, s.num_tasks,
         j.start_ms + 1000 * s.stage_id AS submission,
         j.start_ms + 1000 * s.stage_id + s.q AS completion
  FROM (SELECT l_orderkey AS job_id, CAST(l_linenumber AS BIGINT) AS stage_id,
               CAST(COUNT(*) AS INTEGER) AS num_tasks, CAST(floor(SUM(l_quantity)) AS BIGINT) AS q
        FROM lineitem GROUP BY l_orderkey, l_linenumber) s
  JOIN jobs j ON j.job_id = s.job_id
),
sub AS (
  SELECT 'threads' AS subset, * FROM jobs WHERE group_id <> '' AND n_exec = {FIXED_EXECUTORS}
  UNION ALL
  SELECT 'executors' AS subset, * FROM jobs WHERE group_id <> '' AND n_thread = {FIXED_THREADS}
),
jt AS (
  SELECT job_id, {", ".join(f"CAST(SUM({c}) AS DOUBLE) AS {c}" for c in sorted({c for c, _ in TOTALS.values()}))}
  FROM tasks GROUP BY job_id
),
so AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY job_id ORDER BY stage_id) - 1 AS INTEGER) AS ordinal FROM stages
)"""

_SERIES_SQL = {
    "duration": ("duration", 1e3), "finish_launch": ("(finish - launch)", 1e3),
    "getting_result": ("getting_result", 1e3), "exe_run": ("run_ms", 1e3), "cpu": ("cpu_ns", 1e9),
    "deser_cpu": ("deser_cpu_ns", 1e9), "deser": ("deser_ms", 1e3), "gc": ("gc_ms", 1e3),
}
assert list(_SERIES_SQL) == list(SERIES)

_MW = with_(MTABLES)
SQL.update({
    "k_job_time": _MW + (
        "SELECT run, subset, group_id, job_id, n_exec * n_thread AS parallelism, "
        "round((end_ms - start_ms) / 1000.0, 3) AS seconds FROM sub"),
    "k_cpu_efficiency": _MW + (
        "SELECT run, subset, group_id, sub.job_id, n_exec * n_thread AS parallelism, "
        f"round((cpu_ns / {_f(1e9)}) / NULLIF(duration / {_f(1e3)}, 0), 6) AS cpu_eff "
        "FROM sub LEFT JOIN jt ON jt.job_id = sub.job_id"),
    "k_totals": _MW + (
        "SELECT run, subset, group_id, sub.job_id, n_exec * n_thread AS parallelism, "
        + ", ".join(f"round(COALESCE({c}, 0) / {_f(d)}, 6) AS {name}" for name, (c, d) in TOTALS.items())
        + " FROM sub LEFT JOIN jt ON jt.job_id = sub.job_id"),
    "k_stage_time_by_ordinal": _MW + (
        "SELECT run, subset, group_id, sub.job_id, n_exec * n_thread AS parallelism, ordinal, stage_id, "
        "round((completion - submission) / 1000.0, 3) AS seconds FROM sub JOIN so ON so.job_id = sub.job_id"),
    "k_task_series": _MW + "\nUNION ALL\n".join(
        f"SELECT sub.run, group_id, t.job_id, n_exec, n_thread, ordinal, executor_id, t.task_id, '{name}' AS series, "
        f"{fround(f'CAST({expr} AS DOUBLE) / {_f(d)}', 6)} AS seconds "
        "FROM tasks t JOIN sub ON sub.job_id = t.job_id AND sub.subset = 'executors' "
        "JOIN so ON so.job_id = t.job_id AND so.stage_id = t.stage_id"
        for name, (expr, d) in _SERIES_SQL.items()),
    "k_stage_summary": _MW + (
        "SELECT j.run, j.group_id, s.job_id, s.stage_id, CAST(0 AS BIGINT) AS attempt, "
        "'stage-' || CAST(s.stage_id AS VARCHAR) AS name, CAST(c.n_stages AS INTEGER) AS n_stages, s.num_tasks, "
        "COALESCE(o.n_tasks, 0) AS n_tasks FROM stages s JOIN jobs j ON j.job_id = s.job_id "
        "JOIN (SELECT job_id, COUNT(*) AS n_stages FROM stages GROUP BY job_id) c ON c.job_id = s.job_id "
        "LEFT JOIN (SELECT job_id, stage_id, COUNT(*) AS n_tasks FROM tasks GROUP BY job_id, stage_id) o "
        "ON o.job_id = s.job_id AND o.stage_id = s.stage_id"),
    "k_stage_totals": _MW + (
        "SELECT 'tables' AS run, job_id, stage_id, COUNT(*) AS n_tasks, "
        + ", ".join(f"round(CAST(SUM({c}) AS DOUBLE) / {_f(d)}, 6) AS {name}" for name, (c, d) in TOTALS.items())
        + " FROM tasks GROUP BY job_id, stage_id"),
})

# the same reports read back from event logs: runs by label, some jobs without
# group (dropped by the sweeps) or without completion time (-1)
_LW = with_(MTABLES, f"""
ljobs AS (
  SELECT CAST(j.n_exec AS VARCHAR) || '_' || CAST(j.n_thread AS VARCHAR) || '__tables' AS run, j.job_id,
         CASE WHEN o.o_custkey % 7 = 0 THEN '' ELSE j.group_id END AS group_id, j.start_ms,
         CASE WHEN o.o_custkey % 11 = 0 THEN -1 ELSE j.end_ms END AS end_ms, j.n_exec, j.n_thread
  FROM jobs j JOIN orders o ON o.o_orderkey = j.job_id
),
lsub AS (
  SELECT 'threads' AS subset, * FROM ljobs WHERE group_id <> '' AND n_exec = {FIXED_EXECUTORS}
  UNION ALL
  SELECT 'executors' AS subset, * FROM ljobs WHERE group_id <> '' AND n_thread = {FIXED_THREADS}
)""")
SQL.update({
    "k_log_job_time": _LW + (
        "SELECT run, subset, group_id, job_id, n_exec * n_thread AS parallelism, "
        "round((end_ms - start_ms) / 1000.0, 3) AS seconds FROM lsub"),
    "k_log_totals": _LW + (
        "SELECT run, subset, group_id, lsub.job_id, n_exec * n_thread AS parallelism, "
        + ", ".join(f"round(COALESCE({c}, 0) / {_f(d)}, 6) AS {name}" for name, (c, d) in TOTALS.items())
        + " FROM lsub LEFT JOIN jt ON jt.job_id = lsub.job_id"),
    "k_log_stage_summary": _LW + (
        "SELECT j.run, j.group_id, s.job_id, 8 * s.job_id + s.stage_id AS stage_id, CAST(0 AS BIGINT) AS attempt, "
        "'stage-' || CAST(s.stage_id AS VARCHAR) AS name, CAST(c.n_stages AS INTEGER) AS n_stages, s.num_tasks, "
        "CAST(s.num_tasks AS BIGINT) AS n_tasks FROM stages s JOIN ljobs j ON j.job_id = s.job_id "
        "JOIN (SELECT job_id, COUNT(*) AS n_stages FROM stages GROUP BY job_id) c ON c.job_id = s.job_id"),
})

# read back from nested metrics files: runs by label, nothing missing
_RUN = "CAST(n_exec AS VARCHAR) || '_' || CAST(n_thread AS VARCHAR) || '__tables' AS run"
SQL["k_json_totals"] = SQL["k_totals"].replace("SELECT run, subset", f"SELECT {_RUN}, subset")
SQL["k_json_stage_summary"] = SQL["k_stage_summary"].replace("SELECT j.run, ", f"SELECT {_RUN}, ")

# a merged bundle: every regular bin of each definition, zero or not, and the flow rows in use
_GRID = "\nUNION ALL\n".join(
    f"SELECT '{b.label}' AS label, CAST(bin AS INTEGER) AS bin, {edges_sql(b)} FROM range({b.n}) g(bin)" for b in CANDIDATE_BINS)
SQL["hist_merge"] = (
    f"WITH filled AS ({BASE}{bundle_sql('p', CANDIDATE_BINS)}), grid AS ({_GRID}) "
    "SELECT grid.label, grid.bin, grid.lo, grid.hi, COALESCE(f.n, 0) AS n FROM grid "
    "LEFT JOIN filled f ON f.label = grid.label AND f.bin = grid.bin UNION ALL "
    "SELECT label, bin, lo, hi, n FROM filled f "
    "WHERE NOT EXISTS (SELECT 1 FROM grid WHERE grid.label = f.label AND grid.bin = f.bin)")
SQL["preview_pairs"] = with_(PARTICLES, P4, PAIRS) + (
    "SELECT evt, " + ", ".join(f"{fround(c, 4)} AS {c}" for c in ("e", "px", "py", "pz"))
    + " FROM (SELECT evt, e, px, py, pz FROM pairs ORDER BY evt, e, px, py, pz LIMIT 20) t")
