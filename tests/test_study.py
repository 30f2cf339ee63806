"""The study end to end, on seeded motion."""

import pytest
from pyspark.sql import functions as F

from kinespark.functions import vectors as v
from kinespark.operators import synthetic, traces
from kinespark.plans import study
from kinespark.sources import text
from kinespark.stages import stored


@pytest.fixture(scope="module")
def body(spark):
    return stored(synthetic.body(spark, 1, 1.5, seed=1, noise=False))


@pytest.fixture(scope="module")
def found(body):
    return study.orientations(body, ("mag on",))


def test_orientations_and_tables(found):
    assert {r["method"]: r["count"] for r in found.groupBy("method").count().collect()} == {"Marker": 8 * 150, "mag on": 8 * 150}
    table = study.joint_traces(found, most=100)
    assert table.count() == 2 * 7 * 100 and table.agg(F.max("i")).collect()[0][0] == 99
    stats, r = study.error_tables(table)
    assert stats.count() == 7 * 4 and r.count() == 7 * 3
    assert stats.where("RMSE_deg is null or MAE_deg > RMSE_deg + 1e-9").count() == 0
    # joints turn by up to half a turn, where rotation vectors jump; the rotations themselves are near
    truth = found.where("method = 'Marker'").select("segment", "i", *[F.col(f"q{c}").alias(f"o{c}") for c in v.WXYZ])
    near = traces.rotation_error(found.where("method = 'mag on'").join(truth, ["segment", "i"]), "q", "o")
    assert near.agg(F.percentile("error_deg", F.lit(0.5))).first()[0] < 15


def test_export_and_reload(spark, body, found, tmp_path):
    """What one step writes the next one reads."""
    study.export(found, str(tmp_path))
    assert [p.name for p in tmp_path.glob("*.sto")] == ["0_orientations_mag_on.sto"]
    back = text.read_sto(spark, str(tmp_path))
    both = back.join(found.where("method = 'mag on'").select("segment", "i", *[F.col(f"q{c}").alias(f"o{c}") for c in v.WXYZ]), ["segment", "i"])
    assert both.count() == 8 * 150
    assert traces.rotation_error(both, "q", "o").agg(F.max("error_deg")).first()[0] < 1e-4
