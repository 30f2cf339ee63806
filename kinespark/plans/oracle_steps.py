"""SQL of solves and filters: closed solutions of small systems, and recursive queries that go through a trace step by step.

The ways differ from the operators' on purpose: eigenvectors by squaring a matrix again and again, systems by
determinants, rotations by quaternions, and Kalman updates one scalar measurement after the other, which is the same
as all at once where their noises are independent.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from kinespark.operators.filters import LEGACY, RelativeFilter
from kinespark.plans.oracle import W, X, S, product, observed, cols, cross, dot, mat, poly, r, rs, times, vec

SQL: dict[str, str] = {}
Q = lambda name: [f"{name}{c}" for c in W]
QUAT = ", ".join(f"{r(f'{c} * sg')} AS {c}" for c in Q("q"))


def qmul(a: Sequence[str], b: Sequence[str]) -> list[str]:
    (w, x, y, z), (s, i, j, k) = a, b
    return [f"({w}*{s} - {x}*{i} - {y}*{j} - {z}*{k})", f"({w}*{i} + {x}*{s} + {y}*{k} - {z}*{j})", f"({w}*{j} - {x}*{k} + {y}*{s} + {z}*{i})", f"({w}*{k} + {x}*{j} - {y}*{i} + {z}*{s})"]


def unit(names: Sequence[str]) -> list[str]:
    return [f"({n} / sqrt({dot(names, names)}))" for n in names]


def stages(source: str, *steps: str) -> str:
    """SELECT *, step FROM (...) for each step in turn; one that begins with REPLACE gives columns anew."""
    for s in steps:
        source = f"(SELECT * {s} FROM {source})" if s.startswith("REPLACE ") else f"(SELECT *, {s} FROM {source})"
    return source


# --- eigenvectors: the squares of a matrix tend to the outer product of its main one ---


def main_vector(name: str, source: str, n: int, keys: str = "trial") -> str:
    """Tables {name}_p and {name}: e{i}{j}, i <= j, the outer product of the main eigenvector of a{i}{j}, shifted to be positive."""
    at = lambda p, i, j: f"{p}{min(i, j)}{max(i, j)}"
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    size = lambda p: "sqrt(" + " + ".join(f"{at(p, i, j)}*{at(p, i, j)}" for i in range(n) for j in range(n)) + ")"
    first = ", ".join(f"a{i}{j} {f'+ {size('a')}' if i == j else ''} AS e{i}{j}" for i, j in pairs)
    square = cols(["(" + " + ".join(f"{at('e', i, k)}*{at('e', k, j)}" for k in range(n)) + ")" for i, j in pairs], [f"b{i}{j}" for i, j in pairs])
    scaled = cols([f"b{i}{j} / ({' + '.join(f'b{k}{k}' for k in range(n))})" for i, j in pairs], [f"e{i}{j}" for i, j in pairs])
    return f"""{name}_p AS (SELECT {keys}, 0 AS k, {first} FROM {source} UNION ALL
  SELECT {keys}, k + 1, {scaled} FROM (SELECT {keys}, k, {square} FROM {name}_p WHERE k < 45)), {name} AS (SELECT * FROM {name}_p WHERE k = 45)"""


def davenport(name: str, sums: str) -> str:
    """Tables up to {name}: the unit quaternion's outer product for the best rotation of sums h0..h8 (p c', row by row)."""
    h = lambda i, j: f"h{3 * i + j}"
    cells = {"a00": "h0 + h4 + h8", "a01": f"{h(2, 1)} - {h(1, 2)}", "a02": f"{h(0, 2)} - {h(2, 0)}", "a03": f"{h(1, 0)} - {h(0, 1)}"}
    for i in range(3):
        for j in range(i, 3):
            cells[f"a{i + 1}{j + 1}"] = f"{h(i, j)} + {h(j, i)}" + (" - (h0 + h4 + h8)" if i == j else "")
    return f"{name}_k AS (SELECT trial, {cols(list(cells.values()), list(cells))} FROM {sums}), " + main_vector(name, f"{name}_k", 4)


#: The rotation of a unit quaternion's outer product.
OUTER = ["e00+e11-e22-e33", "2e0*(e12-e03)", "2e0*(e13+e02)", "2e0*(e12+e03)", "e00-e11+e22-e33", "2e0*(e23-e01)", "2e0*(e13-e02)", "2e0*(e23+e01)", "e00-e11-e22+e33"]
_R9 = cols([r(e) for e in OUTER], [f"r{k}" for k in range(9)])


def _outer_sums(pairs: Sequence[tuple[Sequence[str], Sequence[str]]]) -> str:
    return ", ".join("sum(" + " + ".join(f"{p[i]}*{c[j]}" for p, c in pairs) + f") AS h{3 * i + j}" for i in range(3) for j in range(3))


SQL["wahba_rotation"] = f"WITH RECURSIVE {S}, h AS (SELECT trial, {_outer_sums([(vec('gp'), vec('gc'))])} FROM s GROUP BY 1), {davenport('v', 'h')} SELECT trial, {_R9} FROM v"
_units = [(unit(vec(a)), unit(vec(b))) for a, b in (("gp", "gc"), ("mp", "mc"))]
SQL["wahba_of_all"] = f"WITH RECURSIVE {S}, h AS (SELECT trial, {_outer_sums(_units)} FROM s GROUP BY 1), {davenport('v', 'h')} SELECT trial, {_R9} FROM v"

_w = "WINDOW w AS (PARTITION BY trial ORDER BY i)"
_turned = f"nx AS (SELECT *, {cols([f'lead({c}) OVER w' for c in Q('qp')], Q('n'))} FROM s {_w}), " + (
    f"tn AS (SELECT *, {cols(qmul(['qpw', '-qpx', '-qpy', '-qpz'], Q('n')), Q('d'))} FROM nx), "
    f"ln AS (SELECT *, sqrt({dot(vec('d'), vec('d'))}) AS dn FROM tn), "
    f"om AS (SELECT *, {cols([f'sign(dw) * 2e0 * atan2(dn, abs(dw)) / dn * d{x} / 0.01e0' for x in X], vec('wg'))} FROM ln), "
    f"wf AS (SELECT *, {cols([f'coalesce(wg{x}, lag(wg{x}) OVER w)' for x in X], vec('ww'))} FROM om {_w})"
)
SQL["align_world"] = f"""WITH RECURSIVE {S}, {_turned}, h AS (SELECT trial, {_outer_sums([(vec('ww'), vec('gp'))])} FROM wf GROUP BY 1), {davenport('v', 'h')},
  o AS (SELECT trial, sqrt(e00) AS ow, e01 / sqrt(e00) AS ox, e02 / sqrt(e00) AS oy, e03 / sqrt(e00) AS oz FROM v)
  SELECT trial, i, {cols([r(e) for e in qmul(Q('qp'), Q('o'))], Q('q'))} FROM s JOIN o USING (trial)"""

# --- small systems by determinants ---


def det3(m: Sequence[str]) -> str:
    a, b, c, d, e, f, g, h, i = m
    return f"(({a})*(({e})*({i})-({f})*({h})) - ({b})*(({d})*({i})-({f})*({g})) + ({c})*(({d})*({h})-({e})*({g})))"


def cramer(m: Sequence[str], b: Sequence[str]) -> list[str]:
    swap = lambda k: [b[j // 3] if j % 3 == k else m[j] for j in range(9)]
    return [f"({det3(swap(k))} / {det3(m)})" for k in range(3)]


_mq = lambda q: cols(mat(q), [f"{q}{k}" for k in range(9)])
_p9, _c9 = [f"qp{k}" for k in range(9)], [f"qc{k}" for k in range(9)]
_d = [f"(pp{x} - pc{x})" for x in X]
_m9, _s9 = [f"m{k}" for k in range(9)], [f"s{k}" for k in range(9)]
# n op - M oc = bp and -M' op + n oc = bc: the first gives op, the second a system of three for oc
_gram = lambda i, j: "(" + " + ".join(f"m{3 * k + i}*m{3 * k + j}" for k in range(3)) + ")"
_centre = f"""mm AS (SELECT *, {_mq('qp')}, {_mq('qc')} FROM s),
jm AS (SELECT trial, count(*) AS n, {", ".join(f"sum({e}) AS m{k}" for k, e in enumerate(product(_p9, _c9, flip_a=True)))},
  {", ".join(f"-sum({e}) AS bp{x}" for x, e in zip(X, times(_p9, _d, True), strict=True))}, {", ".join(f"sum({e}) AS bc{x}" for x, e in zip(X, times(_c9, _d, True), strict=True))} FROM mm GROUP BY 1),
js AS (SELECT *, {cols([f"{'n*n' if i == j else '0e0'} - {_gram(i, j)}" for i in range(3) for j in range(3)], _s9)}, {cols([f"n*bc{x} + {e}" for x, e in zip(X, times(_m9, vec('bp'), True), strict=True)], vec('rh'))} FROM jm),
jc AS (SELECT *, {cols(cramer(_s9, vec('rh')), vec('oc'))} FROM js),
jo AS (SELECT trial, n, {cols([f"(bp{x} + {e}) / n" for x, e in zip(X, times(_m9, vec('oc')), strict=True)], vec('op'))}, {", ".join(vec('oc'))} FROM jc)"""
SQL["joint_centre"] = f"WITH {S}, {_centre} SELECT trial, n, {rs([*vec('op'), *vec('oc')])} FROM jo"
_left = [f"pc{x} + {b} - pp{x} - {a}" for x, a, b in zip(X, times(_p9, vec("op")), times(_c9, vec("oc")), strict=True)]
SQL["joint_centre_error"] = f"WITH {S}, {_centre}, le AS (SELECT trial, i, {cols(_left, vec('e'))} FROM mm JOIN jo USING (trial)) SELECT trial, i, {rs(vec('e'))}, {r(f'sqrt({dot(vec("e"), vec("e"))})')} AS error FROM le"
_cov = [f"covar_samp(mp{a}, mp{b})" for a in X for b in X]
SQL["sphere_fit"] = f"""WITH {S}, l AS (SELECT *, {dot(vec('mp'), vec('mp'))} AS l2 FROM s),
  k AS (SELECT trial, avg(l2) AS al, {", ".join(f"avg(mp{x}) AS a{x}, covar_samp(mp{x}, l2) AS h{x}" for x in X)}, {cols(_cov, _m9)} FROM l GROUP BY 1),
  c AS (SELECT *, {cols([f"{e} / 2e0" for e in cramer(_m9, vec('h'))], vec('c'))} FROM k)
  SELECT trial, {rs(vec('c'))}, {r(f'sqrt(greatest(0e0, al - 2e0 * {dot(vec("a"), vec("c"))} + {dot(vec("c"), vec("c"))}))')} AS radius FROM c"""
_axis = lambda k: f"CASE big WHEN 0 THEN e0{k} WHEN 1 THEN e{min(1, k)}{max(1, k)} ELSE e{k}2 END / sqrt(greatest(e00, e11, e22))"
_rel = product(_p9, _c9, flip_a=True)
_aligned = ", ".join(f"covar_samp(sd * u{X[i]}, sd * u{X[j]}) AS a{i}{j}" for i in range(3) for j in range(i, 3))
# the child's axes are the parent's turned round, so both have the same covariance
SQL["primary_axis"] = f"""WITH RECURSIVE {S}, mm AS (SELECT *, {_mq('qp')}, {_mq('qc')} FROM s),
  ax AS (SELECT trial, i, {_rel[7]} - {_rel[5]} AS vx, {_rel[2]} - {_rel[6]} AS vy, {_rel[3]} - {_rel[1]} AS vz FROM mm), un AS (SELECT trial, i, {cols(unit(vec('v')), vec('u'))} FROM ax),
  fi AS (SELECT *, {cols([f'first_value(u{x}) OVER w' for x in X], vec('f'))} FROM un {_w}), al AS (SELECT *, CASE WHEN {dot(vec('u'), vec('f'))} < 0 THEN -1e0 ELSE 1e0 END AS sd FROM fi),
  cv AS (SELECT trial, {_aligned} FROM al GROUP BY 1), {main_vector('v', 'cv', 3)}, b AS (SELECT *, CASE WHEN e00 >= e11 AND e00 >= e22 THEN 0 WHEN e11 >= e22 THEN 1 ELSE 2 END AS big FROM v)
  SELECT trial, {", ".join(f"{r(_axis(k))} AS {s}{x}" for s in ("jp", "jc") for k, x in enumerate(X))} FROM b"""

# --- step by step ---


def turn(g: str, dt: str, out: str) -> list[str]:
    """Two steps that make the quaternion {out}* of a turn by {g}* during dt."""
    half = f"{out}_n * {dt} / 2e0"
    return [f"sqrt({dot(vec(g), vec(g))}) AS {out}_n", cols([f"cos({half})", *[f"CASE WHEN {out}_n = 0 THEN 0e0 ELSE {g}{x} / {out}_n * sin({half}) END" for x in X]], Q(out))]


SQL["integrate_rotations"] = f"""WITH RECURSIVE {S}, inp AS MATERIALIZED (SELECT trial, i, t, lead(t) OVER w - t AS dt, {", ".join(f"lead(gp{x}) OVER w AS g{x}" for x in X)} FROM s {_w}),
  f AS (SELECT trial, i, 1e0 AS qw, 0e0 AS qx, 0e0 AS qy, 0e0 AS qz FROM inp WHERE i = 0 UNION ALL
    SELECT trial, i + 1, {cols(unit(Q('z')), Q('q'))} FROM {stages("(SELECT * FROM f JOIN inp USING (trial, i) WHERE dt IS NOT NULL)", *turn('g', 'dt', 'd'), cols(qmul(Q('q'), Q('d')), Q('z')))})
  SELECT trial, i, {r('t')} AS t, {QUAT} FROM (SELECT *, CASE WHEN qw < 0 THEN -1e0 ELSE 1e0 END AS sg FROM f JOIN inp USING (trial, i))"""


def ahrs(name: str, steps: Sequence[str], new: Sequence[str], keep: Sequence[tuple[str, str]] = (), warm_up: int = 2000) -> str:
    """Recursive query of a filter on the parent's traces. Its steps read q*, g*, a*, m* (of unit length) and dt, and `new` is
    the next rotation before it is brought to unit length. keep: more of the state, by name and start (from the first sample)."""
    start = ", ".join(f"{e} AS {n}" for n, e in keep)
    kept = ", ".join(f"new_{n} AS {n}" for n, _ in keep)
    inp = f"inp AS MATERIALIZED (SELECT trial, i, t, (max(t) OVER z - min(t) OVER z) / (count(*) OVER z - 1) AS dt, {cols(vec('gp'), vec('g'))}, {cols(unit(vec('ap')), vec('a'))}, {cols(unit(vec('mp')), vec('m'))}, {cols(Q('qp'), Q('s'))} FROM s WINDOW z AS (PARTITION BY trial))"
    row = f"(SELECT f.*, k < 0 AS still, inp.* EXCLUDE (trial, gx, gy, gz), {cols([f'CASE WHEN k < 0 THEN 0e0 ELSE g{x} END' for x in X], vec('g'))} FROM f JOIN inp ON inp.trial = f.trial AND inp.i = greatest(k, 0))"
    return f"""WITH RECURSIVE {S}, {inp}, f AS (SELECT trial, {-warm_up} AS k, {cols(Q('s'), Q('q'))}{', ' * bool(keep)}{start} FROM inp WHERE i = 0 UNION ALL
  SELECT trial, k + 1, {cols(unit(Q('z')), Q('q'))}{', ' * bool(keep)}{kept} FROM {stages(row, *steps, cols(new, Q('z')))})
  SELECT f.trial, 'parent' AS segment, '{name}' AS filter, i, {r('t')} AS t, {rs(Q('q'))} FROM f JOIN inp ON inp.trial = f.trial AND inp.i = f.k - 1"""


_rate = lambda g: qmul(Q("q"), ["0e0", *g])
_moved = lambda g: [f"q{c} + 0.5e0 * dt * {e}" for c, e in zip(W, _rate(g), strict=True)]
SQL["angular_rate"] = ahrs("angular rate", [], _moved(vec("g")))
_R = [f"r{k}" for k in range(9)]
_flat = [cols(mat("q"), _R), cols(times(_R, vec("m")), vec("h")), "sqrt(hx*hx + hy*hy) AS bx, hz AS bz"]
_b = ["bx", "0e0", "bz"]
SQL["mahony"] = ahrs("mahony", [*_flat, cols(times(_R, _b, True), vec("e")), cols([f"{a} + {b}" for a, b in zip(cross(vec("a"), _R[6:]), cross(vec("m"), vec("e")), strict=True)], vec("c"))], _moved([f"(g{x} + c{x})" for x in X]))


def slopes(world: Sequence[str]) -> list[list[str]]:
    """Slopes of R' u by the quaternion's w, x, y, z, where R' u = (w^2 - v.v) u + 2 (v.u) v - 2 w (v x u)."""
    v_, d, c = vec("q"), dot(vec("q"), world), cross(vec("q"), world)
    out = [[f"(2e0*(qw*{world[i]} - {c[i]}))"] for i in range(3)]
    u = world
    skew = [["0e0", f"-{u[2]}", u[1]], [u[2], "0e0", f"-{u[0]}"], [f"-{u[1]}", u[0], "0e0"]]
    for i in range(3):
        for j in range(3):
            out[i].append(f"(2e0*({d if i == j else '0e0'} + {v_[i]}*{u[j]} - {u[i]}*{v_[j]} + qw*({skew[i][j]})))")
    return out


# Madgwick's gradient: slopes of half the squared distance. His forms of R' u take 1 - 2y^2 - 2z^2 and the like for the squares
# on the diagonal, so that their slopes differ by those of w^2 + x^2 + y^2 + z^2, which is 1.
_up = ["0e0", "0e0", "1e0"]
_less = lambda u: [[f"({s} - 2e0*q{W[k]}*{u[i]})" for k, s in enumerate(row)] for i, row in enumerate(slopes(u))]
_off = [f"({e}) - {s}" for e, s in zip([*times(_R, _up, True), *times(_R, _b, True)], [*vec("a"), *vec("m")], strict=True)]
_grad = [" + ".join(f"d{i}*{row[k]}" for i, row in enumerate([*_less(_up), *_less(_b)])) for k in range(4)]
#: Not among the queries' SQL: after some hundred steps without motion his steps of fixed length go round the least point, and
#: whatever differs in the last digit grows. Tests compare shorter warm-ups.
MADGWICK = ("madgwick", [*_flat, cols(_off, [f"d{i}" for i in range(6)]), cols(_grad, Q("j"))], [f"({m}) - dt * {e}" for m, e in zip(_moved(vec("g")), unit(Q("j")), strict=True)])

# --- Kalman filters ---


def scalar_updates(measured: Sequence[tuple[str, str, str]], n: int) -> list[str]:
    """Updates of list `n` and matrix `cov` by one (residual, row of slopes, variance) after the other; the residual's slope
    is the row's, so a correction x leaves residual + row.x."""
    out = [f"list_value({', '.join(['0e0'] * n)}) AS x0, cov AS p0"]
    for k, (e, h, v) in enumerate(measured):
        out += [
            f"list_transform(p{k}, lambda w: list_dot_product(w, {h})) AS ph{k}",
            f"list_dot_product({h}, ph{k}) + {v} AS v{k}, {e} + list_dot_product({h}, x{k}) AS e{k}",
            f"list_transform(x{k}, lambda w, i: w - ph{k}[i] * e{k} / v{k}) AS x{k + 1}, list_transform(p{k}, lambda w, i: list_transform(w, lambda z, j: z - ph{k}[i] * ph{k}[j] / v{k})) AS p{k + 1}",
        ]
    return out


def turned(t: str, p: str) -> str:
    """T P T' of a matrix T and a symmetric P."""
    return f"list_transform(list_transform({t}, lambda a: list_transform({p}, lambda b: list_dot_product(a, b))), lambda a: list_transform({t}, lambda b: list_dot_product(a, b)))"


def matrix(rows: Sequence[Sequence[str]]) -> str:
    return "[" + ", ".join("[" + ", ".join(f"({e})::DOUBLE" for e in row) + "]" for row in rows) + "]"


def blocks(a: str, b: str) -> str:
    o = ["0e0"] * 3
    ma, mb = mat(a), mat(b)
    return matrix([*[[*ma[3 * k : 3 * k + 3], *o] for k in range(3)], *[[*o, *mb[3 * k : 3 * k + 3]] for k in range(3)]])


EYE = lambda n: matrix([[f"{float(i == j)}e0" for j in range(n)] for i in range(n)])


def relative(settings: RelativeFilter, inp: str, member: str) -> str:
    """Recursive query of the relative filter; inp has trial, the member, i, t, gp gc ap ac mp mc, qp qc."""
    deviation = lambda s: [float(x) for x in settings.variance(s)]
    g = [*deviation(settings.gyro), *deviation(settings.gyro_c)]
    rp, rc = [f"rp{k}" for k in range(9)], [f"rc{k}" for k in range(9)]
    steps = [*turn("gp", "dt", "up"), *turn("gc", "dt", "uc"), cols(qmul(Q("p"), Q("up")), Q("zp")), cols(qmul(Q("c"), Q("uc")), Q("zc")), cols([*unit(Q("zp")), *unit(Q("zc"))], [*Q("yp"), *Q("yc")])]
    steps += [cols([*mat("yp"), *mat("yc")], [*rp, *rc]), f"{blocks('up', 'uc')} AS t1", f"{turned('t1', 'old')} AS c1"]
    steps += [f"list_transform(c1, lambda w, i: list_transform(w, lambda z, j: z + CASE WHEN i = j THEN dt * dt * ({g}::DOUBLE[])[i] ELSE 0e0 END)) AS cov"]
    measured = []

    def directions(p: list[str], c: list[str], variance: float, k: int) -> None:
        for i in range(3):
            a, b = rp[3 * i : 3 * i + 3], rc[3 * i : 3 * i + 3]
            row = [f"-({e})" for e in cross(a, p)] + cross(b, c)
            steps.append(f"{matrix([row])}[1] AS h{k}_{i}")
            measured.append((f"({dot(a, p)} - {dot(b, c)})", f"h{k}_{i}", repr(variance)))

    for k, (m, sp, sc) in enumerate(zip("am", settings.sensors, settings.sensors_c, strict=True)):
        both = {*deviation(sp), *deviation(sc)}
        assert len(both) == 1, "noises of one size in all directions are independent in the world"
        steps.append(cols([f"CASE WHEN {m}{s}x = 0 AND {m}{s}y = 0 AND {m}{s}z = 0 THEN 0e0 ELSE {e} END" for s in "pc" for e in unit(vec(f"{m}{s}"))], [f"n{m}{s}{x}" for s in "pc" for x in X]))
        directions(vec(f"n{m}p"), vec(f"n{m}c"), 2 * both.pop(), k)
    if settings.joint:
        ap, ac = [f"{x!r}" for x in settings.axis_p], [f"{x!r}" for x in settings.axis_c]
        if settings.joint == "1dof":
            directions(ap, ac, deviation(np.broadcast_to(settings.joint_std, 3))[0], 9)
        else:
            steps.append(cols([*times(rp, ap), *times(rc, ac)], [*vec("wp"), *vec("wc")]))
            turning = cross(vec("wc"), vec("wp"))
            steps.append(f"{matrix([[*turning, *[f'-({e})' for e in turning]]])}[1] AS h9")
            measured.append((f"({dot(vec('wp'), vec('wc'))} - sin({settings.angle!r}))", "h9", repr(float(settings.variance(np.atleast_1d(settings.joint_std)[0])))))
    steps += scalar_updates(measured, 6)
    last = len(measured)
    steps += [cols([f"x{last}[{k}]" for k in range(1, 7)], [*vec("dp"), *vec("dc")]), *turn("dp", "1e0", "vp"), *turn("dc", "1e0", "vc"), cols([*qmul(Q("yp"), Q("vp")), *qmul(Q("yc"), Q("vc"))], [*Q("kp"), *Q("kc")])]
    steps += [f"{blocks('vp', 'vc')} AS t2"]
    row = f"(SELECT f.*, inp.* EXCLUDE (trial, {member}) FROM f JOIN inp ON inp.trial = f.trial AND inp.{member} = f.{member} AND inp.i = f.k)"
    out = qmul(["pw", "-px", "-py", "-pz"], Q("c"))
    return f"""{inp}, f AS (SELECT trial, {member}, 0 AS k, {cols(Q('qp'), Q('p'))}, {cols(Q('qc'), Q('c'))}, {EYE(6)} AS old FROM inp WHERE i = 0 UNION ALL
  SELECT trial, {member}, k + 1, {cols([*unit(Q('kp')), *unit(Q('kc'))], [*Q('p'), *Q('c')])}, {turned('t2', f'p{last}')} FROM {stages(row, *steps)}),
  o AS (SELECT f.trial, f.{member}, inp.i, inp.t, {cols(out, Q('q'))} FROM f JOIN inp ON inp.trial = f.trial AND inp.{member} = f.{member} AND inp.i = f.k - 1)
  SELECT trial, {{shown}}, i, {r('t')} AS t, {QUAT} FROM (SELECT *, CASE WHEN qw < 0 THEN -1e0 ELSE 1e0 END AS sg FROM o)"""


_plain = "inp AS MATERIALIZED (SELECT *, 'joint' AS joint, 0.01e0 AS dt FROM s)"
for _name, _settings in {
    "ekf_legacy": LEGACY,
    "ekf_hinge": RelativeFilter(joint="1dof", axis_p=(0, 0, 1), axis_c=(0, 0, 1), joint_std=(0.1, 0.1, 0.1)),
    "ekf_biaxial": RelativeFilter(joint="2dof", axis_p=(0, 0, 1), axis_c=(1, 0, 0), angle=0.2, joint_std=0.1),
}.items():
    SQL[_name] = f"WITH RECURSIVE {S}, " + relative(_settings, _plain, "joint").replace("{shown}", "joint")

# samples of the conditions: accelerations at the joint's centre, and how well they tell the rotation apart
_alpha, _steps = "s", []
for _side in "pc":
    for _x in X:
        _steps.append(f"al{_side}{_x} AS (SELECT * EXCLUDE (b1, b2) FROM {poly(_alpha, 'trial', f'g{_side}{_x}', f'al{_side}{_x}')})")
        _alpha = f"al{_side}{_x}"
_at = [
    f"{a} + {b} + {c}"
    for s in "pc"
    for a, b, c in zip(vec(f"a{s}"), cross(vec(f"al{s}"), vec(f"o{s}")), cross(vec(f"g{s}"), cross(vec(f"g{s}"), vec(f"o{s}"))), strict=True)
]
_seen = f"""{", ".join(_steps)}, {_centre}, pr AS (SELECT l.*, {cols(_at, [*vec('bp'), *vec('bc')])} FROM {_alpha} l JOIN jo USING (trial)),
  d AS (SELECT *, {observed('p', 'b')}, {observed('c', 'b')} FROM pr {_w}),
  ob AS (SELECT *, coalesce(least({", ".join(f"sqrt({dot(cross(vec(f'b{s}'), vec(f'd{s}')), cross(vec(f'b{s}'), vec(f'd{s}')))})" for s in "pc")}), 0e0) AS seen FROM d)"""


def _samples(conditions: Sequence[str]) -> str:
    kinds = ", ".join(f"('{c}')" for c in conditions)
    acc = [f"CASE WHEN condition = 'unprojected' THEN a{s}{x} ELSE b{s}{x} END" for s in "pc" for x in X]
    mag = [f"CASE WHEN condition = 'mag off' OR condition = 'mag adapt' AND seen > 150 THEN 0e0 ELSE m{s}{x} END" for s in "pc" for x in X]
    names = [f"{c}{s}{x}" for c in "am" for s in "pc" for x in X]
    rest = ", ".join([*vec("gp"), *vec("gc"), *Q("qp"), *Q("qc")])
    return f"{_seen}, inp AS MATERIALIZED (SELECT trial, condition, i, t, 0.01e0 AS dt, {rest}, {cols([*acc, *mag], names)} FROM ob, (VALUES {kinds}) AS v(condition))"


for _name, _kinds in {"ekf_mag_on": ["mag on"], "ekf_mag_off": ["mag off"], "ekf_mag_adapt": ["mag adapt"], "ekf_unprojected": ["unprojected"], "ekf_all_conditions": ["mag on", "mag off", "mag adapt", "unprojected"]}.items():
    SQL[_name] = f"WITH RECURSIVE {S}, " + relative(RelativeFilter(), _samples(_kinds), "condition").replace("{shown}", "'joint' AS joint, condition")

# the quaternion filter: gyro as input, the directions of gravity and of the first field measured
_om = [["0e0", "-gx", "-gy", "-gz"], ["gx", "0e0", "gz", "-gy"], ["gy", "-gz", "0e0", "gx"], ["gz", "gy", "-gx", "0e0"]]
_trans = [[f"{float(i == j)}e0 + 0.5e0 * dt * ({e})" for j, e in enumerate(row)] for i, row in enumerate(_om)]
_lift = [["-qx", "-qy", "-qz"], ["qw", "-qz", "qy"], ["qz", "qw", "-qx"], ["-qy", "qx", "qw"]]
_ekf = [f"{matrix(_trans)} AS t1, {matrix(_lift)} AS l1", f"{turned('t1', 'old')} AS c1", "list_transform(c1, lambda w, i: list_transform(w, lambda z, j: z + 0.0001e0 * dt * dt / 4e0 * list_dot_product(l1[i], l1[j]))) AS cov"]
_ekf += [cols([" + ".join(f"({e}) * q{c}" for e, c in zip(row, W, strict=True)) for row in _trans], Q("y"))]
_fields = [f"f{k}" for k in range(3)]


def _predicted() -> list[str]:
    """The measurement at the predicted rotation, whose columns take the place of the old one's."""
    rows = [*slopes(_up), *slopes(_fields)]
    made = [cols(mat("q"), _R)] + [f"{matrix([[f'-({e})' for e in row]])}[1] AS h{i}" for i, row in enumerate(rows)]
    seen = zip([*vec("a"), *vec("m")], [*times(_R, _up, True), *times(_R, _fields, True)], strict=True)
    return made + scalar_updates([(f"({a} - {b})", f"h{i}", "0.0025e0") for i, (a, b) in enumerate(seen)], 4)


_first_m = times(mat("s"), vec("m"))
SQL["ahrs_ekf"] = ahrs(
    "ekf",
    [*_ekf, f"REPLACE ({cols(unit(Q('y')), Q('q'))})", *_predicted(), "p6 AS new_old, f0 AS new_f0, f1 AS new_f1, f2 AS new_f2"],
    [f"q{c} + x6[{k}]" for k, c in enumerate(W, start=1)],
    [("old", EYE(4)), ("f0", f"sqrt({_first_m[0]}*{_first_m[0]} + {_first_m[1]}*{_first_m[1]})"), ("f1", "0e0"), ("f2", _first_m[2])],
)
