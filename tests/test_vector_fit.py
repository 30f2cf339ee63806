import numpy as np
import pytest

from kinespark.functions import rotations as R
from kinespark.functions import vectors as v
from kinespark.operators import calibration, synthetic


@pytest.fixture(scope="module")
def body(spark):
    return synthetic.plate(spark, 1, 1.5, seed=1, noise=False).cache()


def test_one_rotation_from_two_kinds_of_vectors(body):
    turn = R.exp(np.array([0.4, -0.2, 0.3]))
    q = v.lit(R.to_quat(turn))
    df = v.bind(body, h=v.rotate(q, v.vec("g")), n=v.rotate(q, v.vec("m")))
    got = calibration.wahba_of_all(df, ["trial"], [("h", "g"), ("n", "m")]).collect()[0]
    assert np.allclose([got[f"r{k}"] for k in range(9)], turn.ravel())
