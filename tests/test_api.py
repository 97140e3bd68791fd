"""The flows end to end on synthetic faces: five people of four pictures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from likeness import api

RASTER = "width int, height int, channels int, data binary"


def face(i, n):
    y, x = np.mgrid[0:64, 0:48]
    p = i * np.pi / 5
    v = 128 + 60 * np.sin(x * (0.1 + 0.05 * i) + p) + 40 * np.cos(y * (0.1 + 0.03 * i) + p) + 20 * np.sin(0.1 * (x + y))
    return bytearray(np.clip(v + np.random.default_rng(10 * i + n).normal(0, 5, v.shape), 0, 255).astype(np.uint8).tobytes())


@pytest.mark.parametrize("algorithm", ["pca", "lda", "lbph"])
def test_enrol_train_recognise(spark, algorithm):
    rows = [(f"P{i}", f"s{n}", 48, 64, 1, face(i, n)) for i in range(5) for n in range(3)]
    reg = api.registry(spark, algorithm).enroll(spark.createDataFrame(rows, "name string, sample_id string, " + RASTER))
    assert reg.status().collect()[0].state == "NEEDS_TRAINING"
    with pytest.raises(ValueError):
        reg.gallery()
    reg = reg.train(4)
    assert reg.status().collect()[0].state == "READY" and reg.train(4) is reg
    probes = [(i, 48, 64, 1, face(i, 3)) for i in range(5)] + [(9, 48, 64, 1, bytearray(b"x"))]
    got = {r.probe_id: r for r in reg.recognize(spark.createDataFrame(probes, "probe_id long, " + RASTER), 0.5).collect()}
    assert sum(got[i].name == f"P{i}" for i in range(5)) >= 4
    assert got[9].status == "ERROR" and got[9].error
    if algorithm == "pca":
        gone = reg.deactivate(reg.identities.where("name = 'P1'").select("id"))
        one = spark.createDataFrame(probes[1:2], "probe_id long, " + RASTER)
        assert gone.recognize(one, 0.0).collect()[0].name != "P1"
        assert {r.status for r in api.summary(reg.recognize(one, 0.0)).collect()} == {"RECOGNIZED"}


def test_evaluation(spark):
    rng = np.random.default_rng(0)
    rows = [(i, str(i % 4), (np.eye(4)[i % 4] * 6 + rng.normal(size=4)).tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, identity string, v array<double>")
    got = api.evaluate(df)
    assert got["macro"].collect()[0].accuracy > 0.9 and got["predictions"].count() == 24
    folds = api.cross_validate(df, 4).collect()
    assert len(folds) == 4 and min(r.accuracy for r in folds) > 0.8
    assert api.learning_curve(df, [0.5, 0.8]).count() == 2
    assert [r["size"] for r in api.scalability(df, [1, 3], runs=2).orderBy("size").collect()] == [1, 3]


def test_preprocess():
    img = np.zeros((120, 120, 3), int)
    assert api.preprocess(img, "skin", required=True) is None and api.preprocess(img, "skin").shape == (64, 48)
    img[20:90, 30:90] = (200, 140, 110)
    assert api.preprocess(img, "skin", align=True).shape == (64, 48)
