"""The relative filter on a stream: one state per (trial, joint), samples in the order of event time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from kinespark.functions import rotations
from kinespark.functions import vectors as v
from kinespark.operators.filters import RelativeFilter, State, step

_CHANNELS = ("gp", "gc", "ap", "ac", "mp", "mc")
OUT = StructType([StructField("trial", StringType()), StructField("joint", StringType()), StructField("i", LongType()), StructField("t", DoubleType()), *(StructField(c, DoubleType()) for c in v.names("q", v.WXYZ))])
_STATE = StructType([StructField("x", ArrayType(DoubleType()))])


class OnlineFilter(StatefulProcessor):
    """Keeps both rotations, the covariance, the last time and the first step: constant memory for each joint."""

    def __init__(self, settings: RelativeFilter):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("filter", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        frame = pd.concat(rows).sort_values("i", kind="stable").reset_index(drop=True)
        if self.state.exists():
            x = np.array(self.state.get()[0])
            state, last, dt = State(x[:9].reshape(1, 3, 3), x[9:18].reshape(1, 3, 3), x[18:54].reshape(1, 6, 6)), x[54], x[55]
        else:
            first = frame.iloc[:1]
            state = State(*(rotations.from_quat(first[v.names(q, v.WXYZ)].to_numpy(dtype=np.float64)) for q in ("qp", "qc")))
            last, dt = -np.inf, float(frame["t"].iloc[1] - frame["t"].iloc[0]) if len(frame) > 1 else 0.01
        out = []
        for k in range(len(frame)):
            row = frame.iloc[k : k + 1]
            if row["t"].iloc[0] <= last:
                continue  # late: its place in the order is past
            last = float(row["t"].iloc[0])
            g, h, a, b, m, n = (row[v.names(c)].to_numpy(dtype=np.float64) for c in _CHANNELS)
            state = step(self.settings, state, g, h, [a, m], [b, n], dt)
            q = rotations.to_quat(state.rp.swapaxes(1, 2) @ state.rc)[0]
            out.append((key[0], key[1], int(row["i"].iloc[0]), last, *q))
        self.state.update((np.concatenate([state.rp.ravel(), state.rc.ravel(), state.cov.ravel(), [last, dt]]).tolist(),))
        yield pd.DataFrame(out, columns=OUT.names)

    def close(self) -> None:
        pass


def filter_stream(samples: DataFrame, settings: RelativeFilter = RelativeFilter(), mode: str = "append") -> DataFrame:
    """R_pc of a stream of joint samples (trial, joint, i, t, gp gc ap ac mp mc, qp, qc).

    Samples that come behind a later one of their joint are dropped. The state store must be RocksDB.
    """
    need = samples.select("trial", "joint", "i", "t", *[n for c in _CHANNELS for n in v.names(c)], *v.names("qp", v.WXYZ), *v.names("qc", v.WXYZ))
    return need.groupBy("trial", "joint").transformWithStateInPandas(OnlineFilter(settings), OUT, mode, "None")
