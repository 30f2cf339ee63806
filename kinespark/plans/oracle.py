"""The queries' meaning in SQL, for DuckDB, written from the definitions and not from the plans.

Rotations go by matrices here and by quaternions there; ranks, quantiles and moments are DuckDB's own.
"""

from __future__ import annotations

from collections.abc import Sequence

from kinespark.operators.joints import JOINT_LABELS, JOINTS, MARKER_NAMES, SEGMENT_LABELS
from kinespark.plans.queries import OTHERS
from kinespark.plans.views import METHODS, QUATERNIONS, VECTORS

X, W = "xyz", "wxyz"


def r(e: str, n: int = 6) -> str:
    return f"round({e}, {n}) + 0.0"


def rs(names: Sequence[str], n: int = 6, table: str = "") -> str:
    return ", ".join(f"{r(table + c, n)} AS {c}" for c in names)


def vec(name: str) -> list[str]:
    return [f"{name}{c}" for c in X]


def dot(a: Sequence[str], b: Sequence[str]) -> str:
    return "(" + " + ".join(f"({x})*({y})" for x, y in zip(a, b, strict=True)) + ")"


def cross(a: Sequence[str], b: Sequence[str]) -> list[str]:
    return [f"(({a[i]})*({b[j]}) - ({a[j]})*({b[i]}))" for i, j in ((1, 2), (2, 0), (0, 1))]


def mat(q: str) -> list[str]:
    """Rotation matrix of a unit quaternion's columns, row by row."""
    w, x, y, z = (f"{q}{c}" for c in W)
    return [
        f"({w}*{w}+{x}*{x}-{y}*{y}-{z}*{z})", f"(2e0*({x}*{y}-{w}*{z}))", f"(2e0*({x}*{z}+{w}*{y}))",
        f"(2e0*({x}*{y}+{w}*{z}))", f"({w}*{w}-{x}*{x}+{y}*{y}-{z}*{z})", f"(2e0*({y}*{z}-{w}*{x}))",
        f"(2e0*({x}*{z}-{w}*{y}))", f"(2e0*({y}*{z}+{w}*{x}))", f"({w}*{w}-{x}*{x}-{y}*{y}+{z}*{z})",
    ]


def times(m: Sequence[str], u: Sequence[str], back: bool = False) -> list[str]:
    rows = [m[k::3] for k in range(3)] if back else [m[3 * k : 3 * k + 3] for k in range(3)]
    return [dot(row, u) for row in rows]


def cols(values: Sequence[str], names: Sequence[str]) -> str:
    return ", ".join(f"{e} AS {n}" for e, n in zip(values, names, strict=True))


_raw = ", ".join(f"embedding[{k + j}]::DOUBLE AS {name}{c}" for name, k in VECTORS.items() for j, c in enumerate(X))
_rawq = ", ".join(f"embedding[{k + j}]::DOUBLE AS r{name}{c}" for name, k in QUATERNIONS.items() for j, c in enumerate(W))
_q = ", ".join(f"r{name}{c}/sqrt({' + '.join(f'r{name}{d}*r{name}{d}' for d in W)}) AS {name}{c}" for name in QUATERNIONS for c in W)
_all = [n for name in VECTORS for n in vec(name)]
_quats = [f"{q}{c}" for q in QUATERNIONS for c in W]

#: Common table of a joint's samples.
S = f"""s AS (SELECT *, {_q}, i * 0.01e0 AS t FROM (
  SELECT label AS trial, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, {_raw}, {_rawq} FROM embeddings))"""

#: Users' series.
E = """e AS (SELECT user_id, i, value, i * 0.01e0 AS t FROM (
  SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events))"""


def _method(name: str, k: int) -> str:
    return f"SELECT trial, i, '{name}' AS method, " + ", ".join(f"embedding[{k + j}]::DOUBLE AS r{c}" for j, c in enumerate(X)) + " FROM n"


#: Long table of methods, joined with the truth, and unpivoted errors.
M = "n AS (SELECT label AS trial, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, embedding FROM embeddings), long AS (" + " UNION ALL ".join(_method(m, k) for m, k in METHODS.items()) + "),"
M += """ both_ AS (SELECT a.trial, a.i, a.method, a.rx, a.ry, a.rz, b.rx AS mx, b.ry AS my, b.rz AS mz FROM long a JOIN long b USING (trial, i)
  WHERE a.method <> 'Marker' AND b.method = 'Marker'),
errors AS (
  SELECT trial, i, method, 'X' AS axis, rx - mx AS error FROM both_ UNION ALL SELECT trial, i, method, 'Y', ry - my FROM both_
  UNION ALL SELECT trial, i, method, 'Z', rz - mz FROM both_
  UNION ALL SELECT trial, i, method, 'MAG', sqrt((rx-mx)*(rx-mx) + (ry-my)*(ry-my) + (rz-mz)*(rz-mz)) FROM both_)"""

#: RMSE by joint, method and axis.
R = M + ", rm AS (SELECT trial::VARCHAR AS joint_name, method, axis, sqrt(avg(error*error)) AS v FROM errors GROUP BY ALL)"
_in = ", ".join(f"'{m}'" for m in OTHERS)
_wide = ", ".join(f"""avg(v) FILTER (method = '{m}') AS "{m}" """ for m in OTHERS)
BLOCKS = R + f", wide AS (SELECT joint_name || '_' || axis AS block_id, {_wide} FROM rm GROUP BY ALL)"

SQL: dict[str, str] = {}
SQL["sensor_view"] = f"WITH {S} SELECT trial, i, {r('t')} AS t, {rs(_all)}, {rs(_quats)} FROM s"
SQL["slice_trace"] = f"""WITH {E} SELECT user_id, (i - 5) // 4 AS i, {r('t')} AS t, {r('value')} AS value
  FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM e) WHERE i >= 5 AND i < n - 3 AND (i - 5) % 4 = 0"""
SQL["tail_trim"] = f"""WITH {E}, c AS (SELECT user_id, count(*) AS n FROM e GROUP BY 1), l AS (SELECT least(min(n), 60) AS k FROM c)
  SELECT e.user_id, i - (n - k) AS i, {r('value')} AS value FROM e JOIN c USING (user_id), l WHERE i >= n - k"""
SQL["re_zero"] = f"WITH {E} SELECT user_id, i, {r('t - min(t) OVER (PARTITION BY user_id)')} AS t, {r('value')} AS value FROM (SELECT user_id, i, value, t + user_id * 0.5e0 AS t FROM e)"
SQL["sample_frequency"] = f"WITH {E} SELECT user_id, {r('1e0 / avg(d)')} AS frequency FROM (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY i) AS d FROM e) GROUP BY 1"
SQL["common_length"] = f"WITH {E} SELECT min(n) AS length FROM (SELECT count(*) AS n FROM e GROUP BY user_id)"
SQL["trace_equal"] = f"WITH {S} SELECT trial, bool_and(trial % 2 = 0 OR (gpx = gcx AND gpy = gcy AND gpz = gcz)) AS equal FROM s GROUP BY 1"
SQL["allclose"] = f"""WITH {S} SELECT trial, bool_and(abs(gpx - o) <= 1e-6 + 1e-5 * abs(o)) AS close
  FROM (SELECT trial, gpx, gpx + CASE WHEN trial % 2 = 0 THEN 1e-8 ELSE 1e-3 END AS o FROM s) GROUP BY 1"""
SQL["trace_diff"] = f"WITH {S} SELECT trial, i, {r('t')} AS t, " + ", ".join(f"{r(f'{c}p{x} - {c}c{x}')} AS {c}{x}" for c in "gam" for x in X) + " FROM s"


def product(a: Sequence[str], b: Sequence[str], flip_a: bool = False, flip_b: bool = False) -> list[str]:
    """Matrix product of 3 x 3 cells, either side transposed if asked for."""
    at = lambda m, i, j, f: m[3 * j + i] if f else m[3 * i + j]
    return ["(" + " + ".join(f"{at(a, i, k, flip_a)}*{at(b, k, j, flip_b)}" for k in range(3)) + ")" for i in range(3) for j in range(3)]


_cells = [f"r{k}" for k in range(9)]
_mq = lambda q: cols(mat(q), [f"{q}{k}" for k in range(9)])
_two = f"{S}, m AS (SELECT *, {_mq('qp')}, {_mq('qc')} FROM s)"
_p9, _c9 = [f"qp{k}" for k in range(9)], [f"qc{k}" for k in range(9)]
SQL["world_diff"] = f"WITH {_two} SELECT trial, i, " + ", ".join(f"{r(f'pp{x} - pc{x}')} AS p{x}" for x in X) + ", " + ", ".join(f"{r(e)} AS r{k}" for k, e in enumerate(product(_p9, _c9, flip_b=True))) + " FROM m"
_turn = ["0e0", "-1e0", "0e0", "1e0", "0e0", "0e0", "0e0", "0e0", "1e0"]
SQL["rigid_transform"] = f"WITH {_two} SELECT trial, i, {r('1 - ppy')} AS px, {r('2 + ppx')} AS py, {r('3 + ppz')} AS pz, " + ", ".join(f"{r(e)} AS r{k}" for k, e in enumerate(product(_turn, _p9))) + " FROM m"
SQL["world_frame_rotate"] = f"WITH {_two} SELECT trial, i, " + ", ".join(f"{r(e)} AS {c}{x}" for c in "gam" for x, e in zip(X, times(_p9, vec(f"{c}p")), strict=True)) + " FROM m"
SQL["right_rotate"] = f"WITH {_two} SELECT trial, i, " + ", ".join(f"{r(e)} AS g{x}" for x, e in zip(X, times(_p9, vec("gp"), True), strict=True)) + " FROM m"
_rel = product(_p9, _c9, flip_a=True)
_trace = f"({_rel[0]} + {_rel[4]} + {_rel[8]})"
_cosine = f"greatest(-1e0, least(1e0, ({_trace} - 1e0) / 2e0))"
SQL["rotvec_error"] = f"WITH {_two} SELECT trial, i, {r(f'degrees(acos({_cosine}))')} AS error_deg FROM m"
SQL["marker_truth"] = f"WITH {_two} SELECT trial, i, " + ", ".join(f"{r(e)} AS r{k}" for k, e in enumerate(_rel)) + " FROM m"
SQL["joint_rotvec"] = f"""WITH {_two}, k AS (SELECT trial, i, acos({_cosine}) AS a, {cols(_rel, _cells)} FROM m)
  SELECT trial, i, {r('a / (2e0 * sin(a)) * (r7 - r5)')} AS rx, {r('a / (2e0 * sin(a)) * (r2 - r6)')} AS ry, {r('a / (2e0 * sin(a)) * (r3 - r1)')} AS rz FROM k"""
_na, _nb = f"sqrt({dot(vec('gp'), vec('gp'))})", f"sqrt({dot(vec('gc'), vec('gc'))})"
SQL["gyro_angle_error"] = f"WITH {S} SELECT trial, i, {r(f'acos(greatest(-1e0, least(1e0, {dot(vec("gp"), vec("gc"))} / ({_na} * {_nb}))))')} AS angle FROM s"


def observed(s: str, acc: str = "a") -> str:
    d = [f"({acc}{s}{x} - lag({acc}{s}{x}) OVER w)" for x in X]
    da = [f"({a} + {b})" for a, b in zip(d, cross(vec(f"g{s}"), vec(f"{acc}{s}")), strict=True)]
    return cols(da, [f"d{s}{x}" for x in X])


_obs = f"""{S}, d AS (SELECT *, {observed('p')}, {observed('c')} FROM s WINDOW w AS (PARTITION BY trial ORDER BY i)),
o AS (SELECT *, {cols(cross(vec('ap'), vec('dp')), vec('op'))}, {cols(cross(vec('ac'), vec('dc')), vec('oc'))} FROM d),
ob AS (SELECT *, coalesce(sqrt({dot(vec('op'), vec('op'))}), 0e0) AS obp, coalesce(sqrt({dot(vec('oc'), vec('oc'))}), 0e0) AS obc FROM o)"""
_masked = ", ".join(f"{r(f'CASE WHEN least(obp, obc) > 0.03e0 THEN 0e0 ELSE {m}{x} END')} AS {m}{x}" for m in ("mp", "mc") for x in X)
SQL["observability"] = f"WITH {_obs} SELECT trial, i, {r('least(obp, obc)')} AS observability, {_masked} FROM ob"
_case = lambda pairs, c: "CASE " + " ".join(f"WHEN {c} = '{a}' THEN '{b}'" for a, b in pairs) + f" ELSE {c} END"
_seg = lambda c: "CASE " + " ".join(f"WHEN contains({c}, '{a}') THEN '{b}'" for a, b in SEGMENT_LABELS.items()) + " ELSE 'Unknown' END"


def _depth(segment: str) -> int:
    above = {c: p for p, c in JOINTS.values()}
    n = 0
    while segment in above:
        segment, n = above[segment], n + 1
    return n


_joint_rows = ", ".join(f"('{j}', '{p}', '{c}', {k}, {_depth(c)})" for k, (j, (p, c)) in enumerate(JOINTS.items()))
_dim = f"dim AS (SELECT * FROM (VALUES {_joint_rows}) AS v(joint, parent, child, ordinal, depth))"
SQL["joint_catalogue"] = f"WITH {_dim} SELECT joint, {_case(JOINT_LABELS.items(), 'joint')} AS label, {_seg('parent')} AS parent, {_seg('child')} AS child, ordinal, depth FROM dim"
_names = ", ".join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate(MARKER_NAMES.items()))
SQL["plate_pairing"] = f"""WITH v AS (SELECT * FROM (VALUES {_names}) AS t(position, segment, mapped)), tr AS (SELECT DISTINCT label AS trial FROM embeddings)
  SELECT trial, segment, CASE WHEN trial % 2 = 0 THEN mapped ELSE segment END AS world FROM tr, v WHERE trial <> 3 OR segment <> 'torso_imu'"""
SQL["segment_lookup"] = f"""WITH v AS (SELECT * FROM (VALUES {_names}) AS t(position, segment, mapped)), tr AS (SELECT DISTINCT label AS trial FROM embeddings),
  k AS (SELECT * FROM (VALUES ('femur'), ('tibia_l'), ('head')) AS t(part))
  SELECT trial, part, arg_min(segment || '_' || trial, position) AS name FROM tr, v, k WHERE contains(segment || '_' || trial, part) GROUP BY ALL"""

# the chain: matrices of all joints and the pelvis, multiplied downwards
_quat_at = {**{j: 1 + 4 * k for k, j in enumerate(JOINTS)}, "pelvis_imu": 1 + 4 * len(JOINTS)}
_rawc = ", ".join(f"embedding[{k + j}]::DOUBLE AS r{name}_{c}" for name, k in _quat_at.items() for j, c in enumerate(W))
_unitc = ", ".join(f"r{name}_{c}/sqrt({' + '.join(f'r{name}_{d}*r{name}_{d}' for d in W)}) AS {name}_{c}" for name in _quat_at for c in W)
_matc = ", ".join(cols(mat(f"{name}_"), [f"{name}_m{k}" for k in range(9)]) for name in _quat_at)
_chain = f"c0 AS (SELECT label AS trial, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, {_rawc} FROM embeddings), c1 AS (SELECT trial, i, {_unitc} FROM c0), c2 AS (SELECT trial, i, {_matc} FROM c1)"
for _k, (_j, (_p, _c)) in enumerate(JOINTS.items()):
    _chain += f", c{_k + 3} AS (SELECT *, {cols(product([f'{_p}_m{x}' for x in range(9)], [f'{_j}_m{x}' for x in range(9)]), [f'{_c}_m{x}' for x in range(9)])} FROM c{_k + 2})"
_last = f"c{len(JOINTS) + 2}"
SQL["kinematic_chain"] = f"WITH {_chain} " + " UNION ALL ".join(f"SELECT trial, i, '{s}' AS segment, " + ", ".join(f"{r(f'{s}_m{k}', 5)} AS r{k}" for k in range(9)) + f" FROM {_last}" for s in ["pelvis_imu", *[c for _, c in JOINTS.values()]])

_pairs_ = [(c, a, b) for c, a, b in (("g", "gp", "gc"), ("a", "ap", "ac"))]
SQL["sensor_agreement"] = f"WITH {S} SELECT trial, " + ", ".join(
    f"{r('sqrt(avg(' + ' + '.join(f'({a}{x}-{b}{x})*({a}{x}-{b}{x})' for x in X) + '))')} AS {c}_rmsd, " + ", ".join(f"{r(f'corr({a}{x}, {b}{x})')} AS {c}_r_{x}" for x in X) + f", {r(f'corr(sqrt({dot(vec(a), vec(a))}), sqrt({dot(vec(b), vec(b))}))')} AS {c}_r_norm"
    for c, a, b in _pairs_
) + " FROM s GROUP BY 1"
SQL["sensor_bias"] = f"WITH {S} SELECT trial, " + ", ".join(f"{r(f'avg({c}p{x} - {c}c{x})')} AS {c}{x}" for c in "gam" for x in X) + " FROM s GROUP BY 1"
SQL["project_mag"] = f"WITH {S} SELECT trial, i, " + ", ".join(f"{r(f'mp{x} + 0.4e0 * (mc{x} - mp{x})')} AS m{x}" for x in X) + " FROM s"

_unit = lambda a, b, n: cols([f"({a}{x} - {b}{x}) / sqrt({' + '.join(f'({a}{y}-{b}{y})*({a}{y}-{b}{y})' for y in X)})" for x in X], vec(n))
_norm = lambda a, n: cols([f"{a}{x} / sqrt({dot(vec(a), vec(a))})" for x in X], vec(n))
SQL["marker_frames"] = f"""WITH {S}, k AS (SELECT trial, i, {", ".join(f"{s}{x} AS {m}{x}" for m, s in zip("odxy", ("gp", "ap", "gc", "ac"), strict=True) for x in X)} FROM s),
u AS (SELECT *, {_unit('x', 'd', 'ua')}, {_unit('o', 'y', 'ub')}, {_unit('o', 'x', 'va')}, {_unit('y', 'd', 'vb')} FROM k),
h AS (SELECT *, {cols([f'(ua{x} + ub{x}) / 2e0' for x in X], vec('hx'))}, {cols([f'(va{x} + vb{x}) / 2e0' for x in X], vec('hy'))} FROM u),
f AS (SELECT *, {_norm('hx', 'fx')}, {_norm('hy', 'fy')} FROM h), g AS (SELECT *, {cols(cross(vec('fx'), vec('fy')), vec('gz'))} FROM f),
z AS (SELECT *, {_norm('gz', 'fz')} FROM g), y AS (SELECT *, {cols(cross(vec('fz'), vec('fx')), vec('fw'))} FROM z)
SELECT trial, i, {", ".join(f"{r(f'(o{x} + d{x} + x{x} + y{x}) / 4e0')} AS p{x}" for x in X)}, {", ".join(f"{r(f'{a}{x}')} AS r{3 * k + j}" for k, x in enumerate(X) for j, a in enumerate(('fx', 'fw', 'fz')))} FROM y"""

# --- derivatives ---
_ew = "WINDOW w AS (PARTITION BY user_id ORDER BY i)"
SQL["central_diff"] = f"""WITH {E}, d AS (SELECT user_id, i, (lead(value) OVER w - lag(value) OVER w) / (lead(t) OVER w - lag(t) OVER w) AS d FROM e {_ew})
  SELECT user_id, i, {r('coalesce(d, lead(d) OVER w, lag(d) OVER w)')} AS extended, {r('coalesce(d, 0e0)')} AS zeroed FROM d {_ew}"""
SQL["forward_diff"] = f"""WITH {E}, d AS (SELECT user_id, i, (lead(value) OVER w - value) / (lead(t) OVER w - t) AS d FROM e {_ew})
  SELECT user_id, i, {r('coalesce(d, lag(d) OVER w)')} AS extended, {r('coalesce(d, 0e0)')} AS zeroed FROM d {_ew}"""


def poly(source: str, keys: str, value: str, out: str) -> str:
    """Second-order fits over ten rows with a step of 0.01: linear and quadratic parts of each run, averaged at each row."""
    u = [j - 4.5 for j in range(10)]
    lead = lambda j: value if j == 0 else f"lead({value}, {j}) OVER w"
    b1 = "(" + " + ".join(f"({x}e0) * {lead(j)}" for j, x in enumerate(u)) + ") / 82.5e0"
    b2 = "(" + " + ".join(f"({x * x - 8.25}e0) * {lead(j)}" for j, x in enumerate(u)) + ") / 528e0"
    back = lambda b, j: b if j == 0 else f"lag({b}, {j}) OVER w"
    parts = " + ".join(f"coalesce({back('b1', j)} + 2e0 * ({x}e0) * {back('b2', j)}, 0e0)" for j, x in enumerate(u))
    n = " + ".join(f"CASE WHEN {back('b1', j)} IS NULL THEN 0 ELSE 1 END" for j in range(10))
    w = f"WINDOW w AS (PARTITION BY {keys} ORDER BY i)"
    return f"(SELECT *, ({parts}) / ({n}) / 0.01e0 AS {out} FROM (SELECT *, {b1} AS b1, {b2} AS b2 FROM {source} {w}) {w})"


SQL["polyfit_derivative"] = f"WITH {E} SELECT user_id, i, {r('degrees(slope)', 3)} AS slope FROM {poly('e', 'user_id', 'value', 'slope')}"
_w = "WINDOW w AS (PARTITION BY trial ORDER BY i)"
_n9 = [f"n{k}" for k in range(9)]
_step = f"{_two}, nx AS (SELECT *, {cols([f'lead({c}) OVER w' for c in _p9], _n9)} FROM m {_w}), st AS (SELECT trial, i, {cols(product(_p9, _n9, flip_a=True), _cells)} FROM nx), an AS (SELECT *, acos(greatest(-1e0, least(1e0, (r0 + r4 + r8 - 1e0) / 2e0))) AS a FROM st), om AS (SELECT trial, i, {cols([f'a / (2e0 * sin(a)) * ({e}) / 0.01e0' for e in ('r7 - r5', 'r2 - r6', 'r3 - r1')], vec('g'))} FROM an)"
SQL["fd_rotations"] = f"WITH {_step} SELECT trial, i, " + ", ".join(f"{r(f'coalesce(g{x}, lag(g{x}) OVER w)', 4)} AS g{x}" for x in X) + f" FROM om {_w}"


def _central(source: str, names: Sequence[str], outs: Sequence[str]) -> str:
    d = ", ".join(f"(lead({a}) OVER w - lag({a}) OVER w) / (lead(t) OVER w - lag(t) OVER w) AS z{o}" for a, o in zip(names, outs, strict=True))
    return f"(SELECT *, {', '.join(f'coalesce(z{o}, lead(z{o}) OVER w, lag(z{o}) OVER w) AS {o}' for o in outs)} FROM (SELECT *, {d} FROM {source} {_w}) {_w})"


_acc = f"{_two}, v1 AS (SELECT * FROM {_central('m', vec('pp'), vec('vv'))}), v2 AS (SELECT * FROM {_central('v1', vec('vv'), vec('wa'))}), wa AS (SELECT *, waz - 9.81e0 AS wz FROM v2)"
SQL["world_acceleration"] = f"WITH {_acc} SELECT trial, i, {r('wax', 4)} AS ax, {r('way', 4)} AS ay, {r('wz', 4)} AS az FROM wa"
SQL["synthetic_imu"] = f"WITH {_acc} SELECT trial, i, " + ", ".join(f"{r(e, 4)} AS a{x}" for x, e in zip(X, times(_p9, ["wax", "way", "wz"], True), strict=True)) + ", " + ", ".join(f"{r(e, 4)} AS m{x}" for x, e in zip(X, times(_p9, ["0.2e0", "0e0", "0.4e0"], True), strict=True)) + " FROM wa"
_alpha = "s"
_steps = []
for _x in X:
    _steps.append(f"al{_x} AS (SELECT * EXCLUDE (b1, b2) FROM {poly(_alpha, 'trial', f'gp{_x}', f'al{_x}')})")
    _alpha = f"al{_x}"
_off = ["0.1e0", "-0.2e0", "0.3e0"]
_proj = [f"{a} + {b} + {c}" for a, b, c in zip(vec("ap"), cross([f"al{x}" for x in X], _off), cross(vec("gp"), cross(vec("gp"), _off)), strict=True)]
SQL["project_acc"] = f"WITH {S}, " + ", ".join(_steps) + " SELECT trial, i, " + ", ".join(f"{r(e, 4)} AS a{x}" for x, e in zip(X, _proj, strict=True)) + f" FROM {_alpha}"

# --- resampling: the grid, and the last sample at or before each point (the last but one at the end) ---
SQL["imu_resample"] = f"""WITH {E}, n AS (SELECT user_id, count(*) AS n FROM e GROUP BY 1),
k AS (SELECT user_id, n, unnest(range(ceil(round(((n - 1) * 0.01e0 + 0.00625e0) / 0.00625e0, 9))::BIGINT)) AS k FROM n),
p AS (SELECT user_id, k, k * 0.00625e0 AS at, least(k * 5 // 8, n - 2) AS j FROM k)
SELECT p.user_id, p.k AS i, {r('p.at')} AS t, {r('a.value + (p.at - a.t) / (b.t - a.t) * (b.value - a.value)')} AS value
FROM p JOIN e a ON a.user_id = p.user_id AND a.i = p.j JOIN e b ON b.user_id = p.user_id AND b.i = p.j + 1"""
_sl = lambda c: f"(k0 * a.qp{c} + k1 * b.qp{c})"
_dotq = " + ".join(f"a.qp{c}*b.qp{c}" for c in W)
SQL["world_resample"] = f"""WITH {S}, n AS (SELECT trial, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT trial, n, unnest(range(round_even((n - 1) * 0.64e0, 0)::BIGINT)) AS k FROM n),
p AS (SELECT trial, k, k * 0.015625e0 AS tt, least(k * 25 // 16, n - 2) AS j FROM k),
j AS (SELECT p.trial, p.k, p.tt AS tt, (p.tt - a.t) / (b.t - a.t) AS f, acos(least(1e0, abs({_dotq}))) AS th, CASE WHEN {_dotq} < 0 THEN -1e0 ELSE 1e0 END AS sg,
  {", ".join(f"a.{c} AS a_{c}, b.{c} AS b_{c}" for c in [*vec('pp'), *[f'qp{c}' for c in W]])}
  FROM p JOIN s a ON a.trial = p.trial AND a.i = p.j JOIN s b ON b.trial = p.trial AND b.i = p.j + 1),
q AS (SELECT *, {", ".join(f"sin((1e0 - f) * th) / sin(th) * a_qp{c} + sg * sin(f * th) / sin(th) * b_qp{c} AS q{c}" for c in W)} FROM j)
SELECT trial, k AS i, {r('tt')} AS t, {", ".join(f"{r(f'a_pp{x} + f * (b_pp{x} - a_pp{x})')} AS p{x}" for x in X)}, {", ".join(f"{r(e)} AS r{k}" for k, e in enumerate(mat('q')))} FROM q"""

_near = f"WITH {E}, b AS (SELECT user_id - 1 AS user_id, i, value FROM e)"
SQL["sync_bounded_lag"] = f"""{_near}, c AS (SELECT e.user_id, e.i - b.i AS lag, sum(e.value * b.value) AS c FROM e JOIN b ON e.user_id = b.user_id AND abs(e.i - b.i) <= 5 GROUP BY ALL)
  SELECT user_id, lag FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(c, 6) DESC, lag) AS k FROM c) WHERE k = 1"""
SQL["sync_lag"] = f"""{_near}, c AS (SELECT e.user_id, e.i - b.i AS lag, sum(e.value * b.value) AS c FROM e JOIN b ON e.user_id = b.user_id GROUP BY ALL),
  t AS (SELECT user_id, lag FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(c, 6) DESC, lag) AS k FROM c) WHERE k = 1),
  na AS (SELECT user_id, count(*) AS na FROM e GROUP BY 1), nb AS (SELECT user_id, count(*) AS nb FROM b GROUP BY 1)
  SELECT user_id, greatest(0, lag) AS start_a, greatest(0, -lag) AS start_b, least(na - greatest(0, lag), nb - greatest(0, -lag)) AS length FROM t JOIN na USING (user_id) JOIN nb USING (user_id)"""

# --- statistics ---
SQL["error_long"] = f"WITH {M} SELECT trial, i, method, axis, {r('error')} AS error FROM errors"
_two_units = lambda e, n: f"{r(e)} AS {n}_rad, {r(f'degrees({e})')} AS {n}_deg"
SQL["error_stats"] = f"""WITH {M} SELECT trial, method, axis, {_two_units('sqrt(avg(error*error))', 'RMSE')}, {_two_units('avg(abs(error))', 'MAE')}, {_two_units('avg(error)', 'Mean')},
  {_two_units('stddev_samp(error)', 'STD')}, {_two_units('mad(error)', 'MAD')}, {_two_units('quantile_cont(error, 0.25)', 'Q25')}, {_two_units('median(error)', 'Median')}, {_two_units('quantile_cont(error, 0.75)', 'Q75')},
  {r('skewness(error)')} AS Skew, {r('kurtosis(error)')} AS Kurtosis FROM errors GROUP BY ALL"""
_corr = f"{M}, co AS (" + " UNION ALL ".join(f"SELECT trial, method, 'AA_{x.upper()}' AS axis, corr(r{x}, m{x}) AS c FROM both_ GROUP BY ALL" for x in X) + ")"
SQL["pearson_by_group"] = f"WITH {_corr} SELECT trial, method, axis, {r('c')} AS PearsonR FROM co WHERE c IS NOT NULL AND NOT isnan(c)"
SQL["pearson_least"] = f"WITH {_corr} SELECT method, axis, {r('min(c)')} AS PearsonR FROM co WHERE c IS NOT NULL AND NOT isnan(c) GROUP BY ALL"
SQL["line_method_stats"] = f"""WITH p AS (SELECT l_orderkey AS k, l_linenumber AS method, avg(l_extendedprice::DOUBLE) AS v FROM lineitem GROUP BY ALL),
  j AS (SELECT a.method, a.v AS a, b.v AS b, a.v - b.v AS e FROM p a JOIN p b USING (k) WHERE a.method <> 1 AND b.method = 1)
  SELECT method, count(*) AS n, {r('sqrt(avg(e*e))', 2)} AS rmse, {r('avg(abs(e))', 2)} AS mae, {r('median(e)', 2)} AS median, {r('corr(a, b)')} AS r FROM j GROUP BY 1"""
_side = f"{S}, ps AS (SELECT trial, " + ", ".join(f"{c}p{x} AS {c}{x}" for c in "am" for x in X) + ", " + ", ".join(f"sqrt({dot(vec(f'{c}p'), vec(f'{c}p'))}) AS {c}_mag" for c in "am") + " FROM s)"
_sums = ", ".join(f"avg({n}) AS {n}_mean, stddev_pop({n}) AS {n}_std" for c in "am" for n in [*vec(c), f"{c}_mag"])
_sum_names = [f"{n}_{k}" for c in "am" for n in [*vec(c), f"{c}_mag"] for k in ("mean", "std")]
SQL["imu_summary"] = f"WITH {_side}, su AS (SELECT trial, {_sums} FROM ps GROUP BY 1) SELECT trial, {rs(_sum_names)} FROM su"
_pool = ", ".join(f"{r(f'avg({n}_mean)')} AS {n}_mean, {r(f'sqrt(coalesce(var_samp({n}_mean), 0e0) + coalesce(avg({n}_std * {n}_std), 0e0))')} AS {n}_std" for c in "am" for n in [*vec(c), f"{c}_mag"])
SQL["pooled_imu"] = f"WITH {_side}, su AS (SELECT trial, {_sums} FROM ps GROUP BY 1) SELECT trial % 2 AS half, {_pool} FROM su GROUP BY 1"
SQL["iqr_filter"] = f"""WITH {E}, q AS (SELECT user_id, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM e GROUP BY 1)
  SELECT e.user_id, i, {r('value')} AS value FROM e JOIN q USING (user_id) WHERE value BETWEEN a - 1.5e0 * (b - a) AND b + 1.5e0 * (b - a)"""
_order = ", ".join(f"({k}, '{m}')" for k, m in enumerate([*OTHERS, "Nothing"]))
_quart = lambda x: f"{r(f'quantile_cont({x}, 0.25)')} AS q25, {r(f'median({x})')} AS median, {r(f'quantile_cont({x}, 0.75)')} AS q75, {r(f'quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)')} AS iqr"
SQL["method_quartiles"] = f"WITH {R}, d AS (SELECT * FROM (VALUES {_order}) AS t(ordinal, method)), q AS (SELECT method, {_quart('v')} FROM rm GROUP BY 1) SELECT method, ordinal, q25, median, q75, iqr FROM d LEFT JOIN q USING (method)"
# 97.5 % quantiles of Student's t for 1 to 9 degrees of freedom.
_T = [12.706204736, 4.302652730, 3.182446305, 2.776445105, 2.570581836, 2.446911851, 2.364624252, 2.306004135, 2.262157163]
_t = ", ".join(f"({n}, {q}e0)" for n, q in enumerate(_T, start=2))
SQL["ci95"] = f"WITH {R}, t AS (SELECT * FROM (VALUES {_t}) AS v(n, q)), c AS (SELECT method, avg(v) AS mean, stddev_samp(v) AS std, count(*) AS n FROM rm WHERE axis = 'MAG' GROUP BY 1) SELECT method, {r('mean')} AS mean, {r('std')} AS std, c.n AS n, {r('std / sqrt(c.n) * q')} AS half_width FROM c LEFT JOIN t ON t.n = c.n"
SQL["block_pivot"] = f"WITH {BLOCKS} SELECT block_id, " + ", ".join(f"""{r(f'"{m}"')} AS "{m}" """ for m in OTHERS) + " FROM wide WHERE " + " AND ".join(f'"{m}" IS NOT NULL' for m in OTHERS)
SQL["method_joint_heatmap"] = f"WITH {R} SELECT joint_name, method, {r('v')} AS RMSE_rad, v = min(v) OVER (PARTITION BY joint_name) AS best FROM rm WHERE axis = 'MAG'"
SQL["axis_kinds"] = f"WITH {R}, u AS (SELECT axis FROM rm UNION ALL SELECT 'AA_X') SELECT axis, CASE WHEN axis = 'MAG' THEN 'MAG' WHEN axis IN ('X', 'Y', 'Z') THEN 'XYZ' ELSE 'unknown' END AS axis_kind, count(*) AS n FROM u GROUP BY ALL"
_by_trial = "CASE trial % 7 " + " ".join(f"WHEN {k} THEN '{j}'" for k, j in enumerate(JOINTS)) + " END"
SQL["observability_roles"] = f"""WITH {_obs}, l AS (SELECT {_case(JOINT_LABELS.items(), _by_trial)} AS "Joint", obp, obc FROM ob),
  u AS (SELECT "Joint", 'Parent' AS "Role", obp AS o FROM l UNION ALL SELECT "Joint", 'Child', obc FROM l UNION ALL SELECT "Joint", 'Min', least(obp, obc) FROM l)
  SELECT "Joint", "Role", {_quart('o')} FROM u GROUP BY ALL"""

# --- rank tests ---
_k = len(OTHERS)
_unp = " UNION ALL ".join(f"""SELECT block_id, '{m}' AS method, "{m}" AS v FROM wide""" for m in OTHERS)
SQL["friedman_stat"] = f"""WITH {BLOCKS}, lo AS ({_unp}), rk AS (SELECT *, rank() OVER (PARTITION BY block_id ORDER BY v) + (count(*) OVER (PARTITION BY block_id, v) - 1) / 2e0 AS rk, count(*) OVER (PARTITION BY block_id, v) AS c FROM lo),
  su AS (SELECT method, sum(rk) AS s, count(*) AS n, sum(c * c - 1) AS t FROM rk GROUP BY 1)
  SELECT max(n) AS n_blocks, {_k} AS n_methods, {r(f'(12e0 / ({_k} * max(n) * {_k + 1}) * sum(s * s) - 3 * max(n) * {_k + 1}) / (1e0 - sum(t) / (max(n) * {_k * (_k * _k - 1)}e0))')} AS statistic FROM su"""
_prs = " UNION ALL ".join(f"""SELECT '{a}' AS a, '{b}' AS b, "{a}" - "{b}" AS d FROM wide""" for i, a in enumerate(OTHERS) for b in OTHERS[i + 1 :])
SQL["wilcoxon_stat"] = f"""WITH {BLOCKS}, pr AS ({_prs}), rk AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY a, b, abs(d)) - 1) / 2e0 AS rk, count(*) OVER (PARTITION BY a, b, abs(d)) AS c FROM pr),
  su AS (SELECT a, b, count(*)::DOUBLE AS n, sum(CASE WHEN d > 0 THEN rk WHEN d = 0 THEN rk / 2 ELSE 0e0 END) AS p, sum(CASE WHEN d < 0 THEN rk WHEN d = 0 THEN rk / 2 ELSE 0e0 END) AS m, sum(c * c - 1) AS t FROM rk GROUP BY ALL)
  SELECT a, b, n::BIGINT AS n, {r('p')} AS r_plus, {r('m')} AS r_minus, {r('least(p, m)')} AS statistic, {r('(least(p, m) - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - t / 2e0) / 24)')} AS z FROM su"""
SQL["holm"] = f"""WITH p AS (SELECT label AS trial, vec_id, abs(embedding[1]::DOUBLE) AS p FROM embeddings),
  x AS (SELECT *, p * (count(*) OVER (PARTITION BY trial) - row_number() OVER (PARTITION BY trial ORDER BY p, vec_id) + 1) AS x FROM p)
  SELECT trial, vec_id, {r('p')} AS p, {r('least(1e0, max(x) OVER (PARTITION BY trial ORDER BY p, vec_id ROWS UNBOUNDED PRECEDING))')} AS p_adj FROM x"""

# --- calibration sums ---
SQL["wahba_sums"] = f"WITH {S} SELECT trial, count(*) AS n, " + ", ".join(f"{r(f'sum(gp{a} * gc{b})')} AS h{3 * i + j}" for i, a in enumerate(X) for j, b in enumerate(X)) + " FROM s GROUP BY 1"


# --- files ---

SQL["imu_files"] = f"WITH {S} SELECT trial, i, {r('t')} AS t, " + ", ".join(f"{r(f'{c}p{x}')} AS {c}{x}" for c in "gam" for x in X) + " FROM s"
SQL["sto_files"] = f"WITH {S} " + " UNION ALL ".join(
    f"SELECT trial, '{name}' AS segment, i, {r('t')} AS t, " + cols([r(e) for e in mat(f"q{side}")], [f"r{k}" for k in range(9)]) + " FROM s" for side, name in (("p", "parent"), ("c", "child"))
)
