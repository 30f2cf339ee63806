"""Orientation filters: the relative Kalman filter and segment-wise AHRS filters.

A filter is sequential in time and independent between joints and conditions. A group holds one trial; its joints and
conditions are one more axis of every array, so a step in time updates all of them at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from kinespark.functions import rotations
from kinespark.functions import vectors as v
from kinespark.operators import calibration, derivatives, traces

CONDITIONS = ("mag on", "mag off", "mag adapt", "unprojected")
AHRS = ("angular rate", "ekf", "madgwick", "mahony")


@dataclass(frozen=True)
class RelativeFilter:
    """Settings of the relative filter. Deviations are squared into covariances, or put there as they are (`plain`).

    gyro and sensors hold the parent's deviations, gyro_c and sensors_c the child's where these differ; there is a triple
    for each vector sensor. Axes count by their directions. joint: None, '1dof' (axes in both frames coincide) or '2dof' (axes at a fixed angle); `jacobian` of the latter is
    'published' (in world axes) or 'corrected'. `drop_zero` leaves the second sensor out of an update
    where either side reads zero.
    """

    gyro: tuple[float, ...] = (0.1, 0.1, 0.1)
    sensors: tuple[tuple[float, ...], ...] = ((0.05**0.5,) * 3, (0.05**0.5,) * 3)
    gyro_c: tuple[float, ...] | None = None
    sensors_c: tuple[tuple[float, ...], ...] | None = None
    plain: bool = False
    drop_zero: bool = False
    joint: str | None = None
    axis_p: tuple[float, ...] | None = None
    axis_c: tuple[float, ...] | None = None
    angle: float = np.pi / 2
    joint_std: tuple[float, ...] | float | None = None
    jacobian: str = "published"

    def __post_init__(self):
        if self.joint not in (None, "1dof", "2dof"):
            raise ValueError(f"unknown joint {self.joint!r}")
        if self.joint and (self.axis_p is None or self.axis_c is None or self.joint_std is None):
            raise ValueError("a joint needs both axes and a deviation")
        if self.jacobian not in ("published", "corrected"):
            raise ValueError(f"unknown jacobian {self.jacobian!r}")
        for name, value in (("gyro_c", self.gyro), ("sensors_c", self.sensors)):
            if getattr(self, name) is None:
                object.__setattr__(self, name, value)
        if len(self.sensors) != len(self.sensors_c):
            raise ValueError("both sides need as many sensors")
        if any(np.shape(x) != (3,) for x in (self.gyro, self.gyro_c, *self.sensors, *self.sensors_c)):
            raise ValueError("deviations come in threes")
        if not self.sensors and not self.joint:
            raise ValueError("a filter needs a vector sensor or a joint")
        if self.joint:
            for name in ("axis_p", "axis_c"):
                axis = np.asarray(getattr(self, name), dtype=np.float64)
                if axis.shape != (3,) or not np.linalg.norm(axis) > 0:
                    raise ValueError(f"{name} is no direction")
                object.__setattr__(self, name, tuple((axis / np.linalg.norm(axis)).tolist()))
            if np.shape(self.joint_std) not in ((), (1,)) + ((3,),) * (self.joint == "1dof"):
                raise ValueError("the joint's deviation has another number of values")

    def variance(self, std) -> np.ndarray:
        x = np.asarray(std, dtype=np.float64)
        return x if self.plain else x * x


LEGACY = RelativeFilter(gyro=(0.01,) * 3, sensors=((0.05,) * 3, (0.05,) * 3), plain=True, drop_zero=True)


@dataclass
class State:
    """Rotations and covariance of a batch of joints."""

    rp: np.ndarray
    rc: np.ndarray
    cov: np.ndarray = field(default=None)

    def __post_init__(self):
        if self.cov is None:
            self.cov = np.tile(np.eye(6), (len(self.rp), 1, 1))


def _blocks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), 6, 6))
    out[:, :3, :3], out[:, 3:, 3:] = a, b
    return out


def measurement(f: RelativeFilter, rp: np.ndarray, rc: np.ndarray, p: list[np.ndarray], c: list[np.ndarray]):
    """Residual, Jacobian and noise covariance of a batch; p and c have an (n, 3) array for each sensor."""
    n, k = len(rp), len(p)
    size = 3 * k + {None: 0, "1dof": 3, "2dof": 1}[f.joint]
    e, h, noise = np.zeros((n, size)), np.zeros((n, size, 6)), np.zeros((n, size, size))

    def directions(at: int, up: np.ndarray, uc: np.ndarray) -> None:
        s = slice(at, at + 3)
        e[:, s] = np.einsum("nij,nj->ni", rp, up) - np.einsum("nij,nj->ni", rc, uc)
        h[:, s, :3], h[:, s, 3:] = -rp @ rotations.skew(up), rc @ rotations.skew(uc)

    for i in range(k):
        up, uc = (x / np.where(m == 0, 1.0, m) for x, m in ((x, np.linalg.norm(x, axis=1, keepdims=True)) for x in (p[i], c[i])))
        directions(3 * i, up, uc)
        noise[:, 3 * i : 3 * i + 3, 3 * i : 3 * i + 3] = (rp * f.variance(f.sensors[i])) @ rp.swapaxes(1, 2) + (rc * f.variance(f.sensors_c[i])) @ rc.swapaxes(1, 2)
        if f.drop_zero and i:
            gone = (np.linalg.norm(p[i], axis=1) == 0) | (np.linalg.norm(c[i], axis=1) == 0)
            e[gone, 3 * i : 3 * i + 3] = 0.0
            h[gone, 3 * i : 3 * i + 3] = 0.0
    if f.joint:
        up, uc = np.tile(np.array(f.axis_p, dtype=float), (n, 1)), np.tile(np.array(f.axis_c, dtype=float), (n, 1))
        if f.joint == "1dof":
            directions(3 * k, up, uc)
            noise[:, 3 * k :, 3 * k :] = np.diag(f.variance(np.broadcast_to(f.joint_std, 3)))
        else:
            wp, wc = np.einsum("nij,nj->ni", rp, up), np.einsum("nij,nj->ni", rc, uc)
            e[:, 3 * k] = np.sum(wp * wc, axis=1) - np.sin(f.angle)
            turn = np.cross(wc, wp)
            if f.jacobian == "published":
                h[:, 3 * k] = np.hstack([turn, -turn])
            else:
                h[:, 3 * k] = np.hstack([np.einsum("nji,nj->ni", rp, -turn), np.einsum("nji,nj->ni", rc, turn)])
            noise[:, 3 * k, 3 * k] = f.variance(np.atleast_1d(f.joint_std)[0])
    return e, h, noise


def step(f: RelativeFilter, s: State, gp: np.ndarray, gc: np.ndarray, p: list[np.ndarray], c: list[np.ndarray], dt) -> State:
    """One prediction and update of a batch; dt is one number or one for each member."""
    if not len(p) == len(c) == len(f.sensors):
        raise ValueError(f"{len(f.sensors)} sensors a side are wanted")
    dt = np.broadcast_to(np.asarray(dt, dtype=np.float64), (len(gp),))[:, None]
    up, uc = rotations.exp(dt * gp), rotations.exp(dt * gc)
    rp, rc = s.rp @ up, s.rc @ uc
    turn = _blocks(up, uc)
    cov = turn @ s.cov @ turn.swapaxes(1, 2) + dt[..., None] ** 2 * np.diag(np.concatenate([f.variance(f.gyro), f.variance(f.gyro_c)]))
    e, h, noise = measurement(f, rp, rc, p, c)
    ph = cov @ h.swapaxes(1, 2)
    gain = np.linalg.solve(h @ ph + noise, ph.swapaxes(1, 2)).swapaxes(1, 2)
    cov = cov - gain @ (h @ cov)
    n = -np.einsum("nij,nj->ni", gain, e)
    dp, dc = rotations.exp(n[:, :3]), rotations.exp(n[:, 3:])
    turn = _blocks(dp, dc)
    return State(rp @ dp, rc @ dc, turn @ cov @ turn.swapaxes(1, 2))


def _dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups dealt to a fixed number of tasks: few bytes are much work here, so small partitions must not be merged."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


# --- relative filter over a table ------------------------------------------------------------------------------------


def condition_inputs(df: DataFrame, keys: Sequence[str], conditions: Sequence[str] = CONDITIONS, threshold: float = 150.0) -> DataFrame:
    """Samples of each condition: projected to the joint's centre or not, magnetometers kept, off or masked.

    df: keys (joint last), i, t, gp gc ap ac mp mc, qp qc, pp pc. Centre and projection are computed once and fanned out.
    """
    if unknown := set(conditions) - set(CONDITIONS):
        raise ValueError(f"unknown conditions {sorted(unknown)}")
    wanted = [c for c in conditions if c != "unprojected"]
    centres = calibration.joint_centre(df, keys).select(*keys, *v.names("op"), *v.names("oc"))
    full = df.join(centres, list(keys))
    for s in "pc":
        full = derivatives.project_acc(full, keys, v.vec(f"o{s}"), f"g{s}", f"a{s}", f"b{s}")
    full = traces.observability(full, keys, (("gp", "bp"), ("gc", "bc")))
    rows = full.withColumn("condition", F.explode(F.array(*map(F.lit, [*wanted, *(["unprojected"] if "unprojected" in conditions else [])]))))
    raw = F.col("condition") == "unprojected"
    off = (F.col("condition") == "mag off") | ((F.col("condition") == "mag adapt") & (F.col("observability") > threshold))
    for s in "pc":
        rows = rows.withColumns({f"a{s}{x}": F.when(raw, F.col(f"a{s}{x}")).otherwise(F.col(f"b{s}{x}")) for x in v.XYZ})
        rows = rows.withColumns({f"m{s}{x}": F.when(off, 0.0).otherwise(F.col(f"m{s}{x}")) for x in v.XYZ})
    return rows.select(*keys, "condition", "i", "t", *[n for c in ("gp", "gc", "ap", "ac", "mp", "mc") for n in v.names(c)], *v.names("qp", v.WXYZ), *v.names("qc", v.WXYZ))


def _cube(rows: pd.DataFrame, member: list[str]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Members of a group, and each one's row numbers by time (short ones padded with their last row) and length."""
    rows = rows.sort_values([*member, "i"], kind="stable").reset_index(drop=True)
    sizes = rows.groupby(member, sort=True).size()
    ends = sizes.to_numpy().cumsum()
    starts = ends - sizes.to_numpy()
    at = np.minimum(starts[:, None] + np.arange(sizes.max()), ends[:, None] - 1)
    return rows, at, sizes.to_numpy()


def run_relative(df: DataFrame, trial: Sequence[str], member: Sequence[str] = ("joint", "condition"), settings: RelativeFilter = RelativeFilter()) -> DataFrame:
    """(trial, member, i, t, q*): R_pc after every update. The first rotations of qp and qc start the filter; dt is the first step.

    A group is a trial; its members (joint and condition) are filtered together.
    """
    trial, member = list(trial), list(member)
    channels = ["gp", "gc", "ap", "ac", "mp", "mc"]
    need = df.select(*trial, *member, "i", "t", *[n for c in channels for n in v.names(c)], *v.names("qp", v.WXYZ), *v.names("qc", v.WXYZ))
    schema = StructType([*need.select(*trial, *member, "i", "t").schema.fields, *(StructField(c, DoubleType()) for c in v.names("q", v.WXYZ))])

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows, at, sizes = _cube(rows, member)
        data = {c: rows[v.names(c)].to_numpy() for c in channels}
        t = rows["t"].to_numpy()
        dt = t[at[:, min(1, at.shape[1] - 1)]] - t[at[:, 0]]
        state = State(*(rotations.from_quat(rows[v.names(q, v.WXYZ)].to_numpy()[at[:, 0]]) for q in ("qp", "qc")))
        out = np.empty((len(rows), 3, 3))
        for k in range(at.shape[1]):
            now = at[:, k]
            state = step(settings, state, data["gp"][now], data["gc"][now], [data["ap"][now], data["mp"][now]], [data["ac"][now], data["mc"][now]], dt)
            live = k < sizes
            out[now[live]] = state.rp[live].swapaxes(1, 2) @ state.rc[live]
        made = rows[[*trial, *member, "i", "t"]].copy()
        made[v.names("q", v.WXYZ)] = rotations.to_quat(out)
        return made

    return _dealt(need, trial).groupBy(*trial).applyInPandas(work, schema)


def truth(df: DataFrame, qp: str = "qp", qc: str = "qc") -> DataFrame:
    """The marker condition: R_pc of the ground truth itself."""
    return v.bind(df, q=v.qmul(v.conj(v.quat(qp)), v.quat(qc)))


# --- AHRS filters, from the published papers -------------------------------------------------------------------------


def _qdot(q: np.ndarray, g: np.ndarray) -> np.ndarray:
    return 0.5 * rotations.qmul(q, np.concatenate([np.zeros(g.shape[:-1] + (1,)), g], axis=-1))


def _norm(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(n == 0, 1.0, n)


def angular_rate_step(q, g, a, m, dt, **_):
    """Integration of the gyro alone, by the first term of its series."""
    return _norm(q + _qdot(q, g) * dt)


def closed_rate_step(q, g, a, m, dt, **_):
    """Integration of the gyro alone, in closed form."""
    n = np.linalg.norm(g, axis=-1, keepdims=True) * dt / 2
    k = np.where(n < 1e-9, dt / 2, np.sin(n) / np.where(n < 1e-9, 1.0, n) * dt / 2)
    return _norm(rotations.qmul(q, np.concatenate([np.cos(n), g * k], axis=-1)))


def madgwick_step(q, g, a, m, dt, beta: float = 1.0, **_):
    """Gradient descent step of gravity and, where the magnetometer reads, of the field's direction."""
    w, x, y, z = (q[..., k] for k in range(4))
    a, field_ = _norm(a), _norm(m)
    zero = np.zeros_like(w)
    f = [2 * (x * z - w * y) - a[..., 0], 2 * (w * x + y * z) - a[..., 1], 2 * (0.5 - x * x - y * y) - a[..., 2]]
    j = [[-2 * y, 2 * z, -2 * w, 2 * x], [2 * x, 2 * w, 2 * z, 2 * y], [zero, -4 * x, -4 * y, zero]]
    there = np.linalg.norm(m, axis=-1) > 0
    h = np.einsum("nij,nj->ni", rotations.from_quat(q), field_)
    bx, bz = np.hypot(h[..., 0], h[..., 1]) * there, h[..., 2] * there
    f += [2 * bx * (0.5 - y * y - z * z) + 2 * bz * (x * z - w * y) - field_[..., 0], 2 * bx * (x * y - w * z) + 2 * bz * (w * x + y * z) - field_[..., 1], 2 * bx * (w * y + x * z) + 2 * bz * (0.5 - x * x - y * y) - field_[..., 2]]
    j += [
        [-2 * bz * y, 2 * bz * z, -4 * bx * y - 2 * bz * w, -4 * bx * z + 2 * bz * x],
        [-2 * bx * z + 2 * bz * x, 2 * bx * y + 2 * bz * w, 2 * bx * x + 2 * bz * z, -2 * bx * w + 2 * bz * y],
        [2 * bx * y, 2 * bx * z - 4 * bz * x, 2 * bx * w - 4 * bz * y, 2 * bx * x],
    ]
    gradient = np.stack([sum(j[r][k] * f[r] for r in range(6)) for k in range(4)], axis=-1)
    still = np.linalg.norm(a, axis=-1, keepdims=True) == 0
    rate = _qdot(q, g) - np.where(still, 0.0, beta * _norm(gradient))
    return _norm(q + rate * dt)


def mahony_step(q, g, a, m, dt, kp: float = 1.0, **_):
    """Proportional feedback of the angle between measured and expected directions; no integral term."""
    a, field_ = _norm(a), _norm(m)
    r = rotations.from_quat(q)
    back = r.swapaxes(-1, -2)
    error = np.cross(a, back[..., :, 2])
    h = np.einsum("nij,nj->ni", r, field_)
    flat = np.stack([np.hypot(h[..., 0], h[..., 1]), np.zeros(len(h)), h[..., 2]], axis=-1)
    error = error + np.cross(field_, np.einsum("nij,nj->ni", back, flat))
    return _norm(q + _qdot(q, g + kp * error) * dt)


def ekf_step(q, g, a, m, dt, memory: dict | None = None, noises: Sequence[float] = (0.01, 0.05, 0.05), **_):
    """Quaternion Kalman filter: gyro as input, directions of gravity and of the field as measurement."""
    memory = {} if memory is None else memory
    cov = memory.get("cov", np.tile(np.eye(4), (len(q), 1, 1)))
    field_world = memory.setdefault("field", None)
    if field_world is None:  # the field that the first sample and the start say, in the plane of x and z
        h = np.einsum("nij,nj->ni", rotations.from_quat(q), _norm(m))
        field_world = memory["field"] = np.stack([np.hypot(h[..., 0], h[..., 1]), np.zeros(len(h)), h[..., 2]], axis=-1)
    w = np.zeros((len(q), 4, 4))
    w[:, 0, 1:], w[:, 1:, 0], w[:, 1:, 1:] = -g, g, -rotations.skew(g)
    trans = np.eye(4) + 0.5 * dt * w
    lift = np.concatenate([-q[:, None, 1:], q[:, :1, None] * np.eye(3) + rotations.skew(q[:, 1:])], axis=1) * (dt / 2)
    cov = trans @ cov @ trans.swapaxes(1, 2) + noises[0] ** 2 * lift @ lift.swapaxes(1, 2)
    q = _norm(np.einsum("nij,nj->ni", trans, q))
    up = np.tile([0.0, 0.0, 1.0], (len(q), 1))
    h, e = [], []
    back = rotations.from_quat(q).swapaxes(1, 2)
    for world, seen in ((up, _norm(a)), (field_world, _norm(m))):
        there = (np.linalg.norm(seen, axis=1) > 0)[:, None]
        u, s = q[:, 1:], q[:, :1]
        # slopes of R' world by w and by the vector part
        dw = 2 * (s * world - np.cross(u, world))
        dv = 2 * (np.sum(u * world, axis=1)[:, None, None] * np.eye(3) + np.einsum("ni,nj->nij", u, world) - np.einsum("ni,nj->nij", world, u) + s[..., None] * rotations.skew(world))
        e.append((seen - np.einsum("nij,nj->ni", back, world)) * there)
        h.append(np.concatenate([dw[..., None], dv], axis=2) * there[..., None])
    h, e = np.concatenate(h, axis=1), np.concatenate(e, axis=1)
    noise = np.diag([noises[1] ** 2] * 3 + [noises[2] ** 2] * 3)
    ph = cov @ h.swapaxes(1, 2)
    gain = np.linalg.solve(h @ ph + noise, ph.swapaxes(1, 2)).swapaxes(1, 2)
    q = _norm(q + np.einsum("nij,nj->ni", gain, e))
    memory["cov"] = cov - gain @ (h @ cov)
    return q


STEPS = {"angular rate": angular_rate_step, "angular rate closed": closed_rate_step, "ekf": ekf_step, "madgwick": madgwick_step, "mahony": mahony_step}


def run_ahrs(df: DataFrame, trial: Sequence[str], filters: Sequence[str] = AHRS, warm_up: int = 2000, segment: str = "segment") -> DataFrame:
    """(trial, segment, filter, i, t, q*): world rotation of every segment by each filter, from g, a, m and the first q.

    The filter first sees sample 0 without rotation `warm_up` times; dt is the mean step. All segments of a trial are
    filtered together.
    """
    if unknown := set(filters) - set(STEPS):
        raise ValueError(f"unknown filters {sorted(unknown)}")
    trial = list(trial)
    need = df.select(*trial, segment, "i", "t", *[n for c in traces.CHANNELS for n in v.names(c)], *v.names("q", v.WXYZ))
    fields = {f.name: f for f in need.schema.fields}
    schema = StructType([*(fields[c] for c in (*trial, segment)), StructField("filter", StringType()), StructField("i", LongType()), StructField("t", DoubleType()), *(StructField(c, DoubleType()) for c in v.names("q", v.WXYZ))])

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows, at, sizes = _cube(rows, [segment])
        g, a, m = (rows[v.names(c)].to_numpy() for c in traces.CHANNELS)
        t = rows["t"].to_numpy()
        last = at[np.arange(len(at)), sizes - 1]
        dt = ((t[last] - t[at[:, 0]]) / np.maximum(1, sizes - 1))[:, None]
        first = rows[v.names("q", v.WXYZ)].to_numpy()[at[:, 0]]
        out = []
        for name in filters:
            one, memory = STEPS[name], {}
            step_dt = dt if name != "ekf" else dt[..., None]
            q = _norm(first)
            call = lambda q, g, a, m: one(q, g, a, m, step_dt, memory=memory)  # noqa: B023, E731
            for _ in range(warm_up):
                q = call(q, np.zeros_like(g[at[:, 0]]), a[at[:, 0]], m[at[:, 0]])
            made = rows[[*trial, segment, "i", "t"]].copy()
            made.insert(len(trial) + 1, "filter", name)
            values = np.empty((len(rows), 4))
            for k in range(at.shape[1]):
                now, live = at[:, k], k < sizes
                q = call(q, g[now], a[now], m[now])
                values[now[live]] = q[live]
            made[v.names("q", v.WXYZ)] = values
            out.append(made)
        return pd.concat(out)

    return _dealt(need, trial).groupBy(*trial).applyInPandas(work, schema)
