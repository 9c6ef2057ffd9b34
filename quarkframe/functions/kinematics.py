"""Kinematics as Spark SQL expressions (all JVM-side, codegen-friendly).

Inputs are SQL expression strings -- column names or paths such as
``"a.pt"`` or ``"get(muons, 0).eta"`` -- and every function returns one
``Column`` built from a single SQL expression, so building a query costs one
round trip to the JVM per quantity rather than one per arithmetic node.

Semantics follow the reference definitions, including its quirks, which are
kept on purpose so that results agree:

* ``pair_mass2`` is the *squared* mass of the pair (no square root).
* ``pair_phi`` uses ``atan(py/px)`` (range +-pi/2) and a fixed value when
  ``px == 0``; ``pair_phi_atan2`` is the full-range alternative.
* ``pair_eta`` is the rapidity ``0.5*ln((e+pz)/(e-pz))``; the zero and
  negative-argument cases map to +-inf / NaN like IEEE arithmetic would,
  instead of Spark's NULL, so such pairs land in the histogram flows.
* The four-vector uses ``abs(pt)``; polar angle from ``2*atan(exp(-eta))``.

Four-vectors are computed in double precision; the pair record holds their
sums as float, and its mass^2, pt, phi and rapidity mix float products and
quotients with double functions, as the reference's record does. So rows read
back from a stored pair table give the same derived values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for identical results.
MUON_MASS = 0.10565836727619171      # mass used when building pair candidates
HIGGS_MUON_MASS = 0.105658367        # mass used by the two-muon Higgs formula
PHI_AT_ZERO_PX = -3.14 / 2           # phi of a pair whose px is exactly zero


def d(x: float) -> str:
    """Double literal that parses back to exactly ``x``."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def _dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


# ------------------------------------------------------------ SQL text builders

def p4_sql(pt: str, eta: str, phi: str, mass: float = MUON_MASS) -> str:
    """SQL struct(e, px, py, pz) of a candidate from (pt, eta, phi)."""
    apt = f"abs({_dbl(pt)})"
    px = f"({apt} * cos({_dbl(phi)}))"
    py = f"({apt} * sin({_dbl(phi)}))"
    pz = f"({apt} / tan({d(2.0)} * atan(exp(-{_dbl(eta)}))))"
    e = f"sqrt({px} * {px} + {py} * {py} + {pz} * {pz} + {d(mass * mass)})"
    return f"named_struct('e', {e}, 'px', {px}, 'py', {py}, 'pz', {pz})"


def p4_add_sql(a: str, b: str) -> str:
    """Sum in double precision."""
    return "named_struct(" + ", ".join(f"'{k}', ({a}).{k} + ({b}).{k}" for k in ("e", "px", "py", "pz")) + ")"


def pair_sql(a: str, b: str) -> str:
    """The pair record: the four sums, stored as float."""
    return "named_struct(" + ", ".join(f"'{k}', CAST(({a}).{k} + ({b}).{k} AS FLOAT)"
                                       for k in ("e", "px", "py", "pz")) + ")"


def mass2_sql(v: str) -> str:
    return f"({v}.e * {v}.e - {v}.px * {v}.px - {v}.py * {v}.py - {v}.pz * {v}.pz)"


def pt_sql(v: str) -> str:
    return f"sqrt({v}.px * {v}.px + {v}.py * {v}.py)"


def _quotient(num: str, den: str) -> str:
    """Float quotient: Spark divides floats as doubles; rounding that result
    to float is the correctly rounded float quotient."""
    return f"CAST({num} / {den} AS FLOAT)"


def phi_sql(v: str) -> str:
    return f"(CASE WHEN {v}.px = 0 THEN {d(PHI_AT_ZERO_PX)} ELSE atan({_quotient(f'{v}.py', f'{v}.px')}) END)"


def eta_sql(v: str) -> str:
    num, den = f"({v}.e + {v}.pz)", f"({v}.e - {v}.pz)"
    q = _quotient(num, den)
    inf, ninf, nan = "CAST('Infinity' AS DOUBLE)", "CAST('-Infinity' AS DOUBLE)", "CAST('NaN' AS DOUBLE)"
    return (f"(CASE WHEN {den} = 0 THEN (CASE WHEN {num} > 0 THEN {inf} WHEN {num} < 0 THEN {ninf} "
            f"ELSE {nan} END) WHEN {q} = 0 THEN {ninf} WHEN {q} < 0 THEN {nan} "
            f"ELSE {d(0.5)} * ln({q}) END)")


def higgs_mass_sql(a: str, b: str) -> str:
    """a, b: SQL structs with pt, eta, phi (the two muons)."""
    def comps(x):
        pt, eta, phi = (_dbl(f"{x}.{c}") for c in ("pt", "eta", "phi"))
        return f"({pt} * cos({phi}))", f"({pt} * sin({phi}))", f"({pt} * sinh({eta}))"

    px1, py1, pz1 = comps(a)
    px2, py2, pz2 = comps(b)
    m2 = d(HIGGS_MUON_MASS * HIGGS_MUON_MASS)
    en1 = f"({px1} * {px1} + {py1} * {py1} + {pz1} * {pz1} + {m2})"
    en2 = f"({px2} * {px2} + {py2} * {py2} + {pz2} * {pz2} + {m2})"
    s = (f"(({en1} + {en2}) * ({en1} + {en2}) - ({px1} + {px2}) * ({px1} + {px2}) "
         f"- ({py1} + {py2}) * ({py1} + {py2}) - ({pz1} + {pz2}) * ({pz1} + {pz2}))")
    return f"(CASE WHEN {s} >= 0 THEN sqrt({s}) WHEN {s} < 0 THEN CAST('NaN' AS DOUBLE) END)"


# ------------------------------------------------------------------- Columns

def p4(pt: str, eta: str, phi: str, mass: float = MUON_MASS) -> Column:
    """Four-vector struct(e, px, py, pz) of a candidate from (pt, eta, phi)."""
    return F.expr(p4_sql(pt, eta, phi, mass))


def pair_record(a: str, b: str) -> Column:
    """Pair struct(e, px, py, pz) of floats from two four-vectors (SQL texts)."""
    return F.expr(pair_sql(a, b))


def pair_mass2(v: str) -> Column:
    return F.expr(mass2_sql(v))


def pair_mass(v: str) -> Column:
    """Proper invariant mass: sqrt of the (clamped) squared mass."""
    return F.expr(f"sqrt(greatest({mass2_sql(v)}, {d(0.0)}))")


def pair_pt(v: str) -> Column:
    return F.expr(pt_sql(v))


def pair_phi(v: str) -> Column:
    return F.expr(phi_sql(v))


def pair_phi_atan2(v: str) -> Column:
    return F.expr(f"atan2({v}.py, {v}.px)")


def pair_eta(v: str) -> Column:
    """Rapidity 0.5*ln((e+pz)/(e-pz)) with IEEE results at the edges."""
    return F.expr(eta_sql(v))


def higgs_dimuon_mass(a: str, b: str) -> Column:
    """Two-muon mass exactly as the Higgs example defines it.

    ``a``/``b`` are SQL structs with ``pt, eta, phi``. The reference's
    "energy" is ``p^2 + m^2`` without a square root; the result is kept as
    defined so histograms agree. ``invariant_mass`` is the physically correct
    variant. A missing muon (NULL) gives NULL.
    """
    return F.expr(higgs_mass_sql(a, b))


def invariant_mass(a: str, b: str, mass: float = MUON_MASS) -> Column:
    """Correct two-body invariant mass of two (pt, eta, phi) structs."""
    v = p4_add_sql(p4_sql(f"{a}.pt", f"{a}.eta", f"{a}.phi", mass),
                   p4_sql(f"{b}.pt", f"{b}.eta", f"{b}.phi", mass))
    return F.expr(f"sqrt(greatest({mass2_sql('(' + v + ')')}, {d(0.0)}))")
