"""Flows that keep state: model headers, sidecars, the enrolment log, snapshots, training on pairs, folders of pictures."""

import os
import shutil
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from likeness import api, settings
from likeness.operators import gallery, haar, images, matching, models
from likeness.sources import headers, images as readers, store
from likeness.streaming import requests

RASTER = "width int, height int, channels int, data binary"


def face(i, n):
    y, x = np.mgrid[0:64, 0:48]
    p = i * np.pi / 5
    v = 128 + 60 * np.sin(x * (0.1 + 0.05 * i) + p) + 40 * np.cos(y * (0.1 + 0.03 * i) + p) + 20 * np.sin(0.1 * (x + y))
    return np.clip(v + np.random.default_rng(10 * i + n).normal(0, 5, v.shape), 0, 255).astype(np.uint8)


def trained(spark, algorithm="pca", people=4):
    rows = [(f"P{i}", f"s{n}", 48, 64, 1, bytearray(face(i, n).tobytes())) for i in range(people) for n in range(3)]
    return api.registry(spark, algorithm).enroll(spark.createDataFrame(rows, "name string, sample_id string, " + RASTER)).train(4)


def header(version=1, flags=1, length=77, magic=b"FRCM", check=None):
    head = struct.pack(">4sii", magic, version, flags)
    return head + struct.pack(">qq", zlib.crc32(head) if check is None else check, length)


def test_headers_cost_a_few_bytes_a_file(spark, tmp_path, monkeypatch):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/one.frm").write_bytes(header() + b"x" * 100)
    (tmp_path / "a/b/two.frm").write_bytes(header(flags=0, length=2**40))
    (tmp_path / "a/new.frm").write_bytes(header(version=9))
    (tmp_path / "a/bad.frm").write_bytes(header(check=5))
    (tmp_path / "a/other.frm").write_bytes(header(magic=b"ABCD"))
    (tmp_path / "a/empty.frm").write_bytes(b"")
    (tmp_path / "a/note.txt").write_text("FRCM")
    with open(tmp_path / "a/huge.frm", "wb") as f:
        f.write(header())
        f.truncate(1 << 30)
    began = time.time()
    got = {os.path.basename(r.path): r for r in headers.model_headers(spark, f"file://{tmp_path}/a", ".frm").collect()}
    assert time.time() - began < 20 and len(got) == 7
    assert tuple(got["one.frm"])[1:] == (128, True, 1, True, 77, None) and got["two.frm"].data_length == 2**40 and not got["two.frm"].compressed
    assert [got[f"{k}.frm"].problem for k in ("new", "bad", "other", "empty")] == ["unsupported version", "checksum mismatch", "other magic", "too short"]
    assert got["huge.frm"].size == 1 << 30 and got["huge.frm"].is_model
    assert headers.model_headers(spark, str(tmp_path / "a"), only_models=True).count() == 5
    assert headers.model_headers(spark, str(tmp_path / "a/one.frm")).count() == 1
    read = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def read(self, n):
            read.append(n)
            return self.f.read(n)

    class System:
        def __init__(self, s):
            self.s = s

        def open_input_file(self, path):
            return Counted(self.s.open_input_file(path))

    opened = headers._opened
    reader = headers._Reader({"path": str(tmp_path / "a"), "suffix": "huge.frm"})
    parts = reader.partitions()
    monkeypatch.setattr(headers, "_opened", lambda uri: (System(opened(uri)[0]), opened(uri)[1]))
    assert [r[2] for p in parts for r in reader.read(p)] == [True] and sum(read) == headers.HEADER


def test_sidecars_are_one_scan(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}")
    assert s.models() == [] and s.catalogue().count() == 0
    line = '{{"name": "m{0}", "algorithm": "{1}", "version": 1, "dimension": 3, "components": 2, "normalise": true, "checksum": "c", "saved_at": {2}}}'
    for i in range(1000):
        (tmp_path / f"models/m{i}/info").mkdir(parents=True)
        (tmp_path / f"models/m{i}/info/part-0.txt").write_text(line.format(i, "lda" if i % 4 == 0 else "pca", 5000 - i) + "\n")
    (tmp_path / "models/broken/info").mkdir(parents=True)
    (tmp_path / "models/broken/info/part-0.txt").write_text('{"name": "x", \n')
    (tmp_path / "models/nameless/info").mkdir(parents=True)
    (tmp_path / "models/nameless/info/part-0.txt").write_text('{"algorithm": "pca"}\n')
    (tmp_path / "models/unfinished/components").mkdir(parents=True)
    group = "sidecars"
    spark.sparkContext.setJobGroup(group, "listing")
    got = s.models("lda")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == 250 and got[0]["name"] == "m0" and got[-1]["name"] == "m996" and len(jobs) == 2  # the files are listed, then read
    bad = {r.folder: r.corrupt for r in s.catalogue().where("corrupt IS NOT NULL").collect()}
    assert set(bad) == {"broken", "nameless"} and bad["broken"].startswith('{"name"')


def test_enrolment_is_logged_once(spark, tmp_path):
    at = lambda k: f"{tmp_path}/{k}"
    schema = "identity string, sample string, v int, ts long"
    spark.createDataFrame([("a", "1", 1, 1), ("a", "2", 2, 1), ("b", "1", 3, 1), ("b", "1", 4, 2)], schema).coalesce(1).write.parquet(at("in"))
    run = lambda: requests.enrolment_stream(spark.readStream.schema(schema).parquet(at("in")), at("log"), at("cp")).awaitTermination(120)
    run()
    log = lambda: spark.read.parquet(at("log"))
    assert log().count() == 4
    os.remove(f"{tmp_path}/cp/commits/0")  # stopped after the batch was written, before it was marked as done
    for name in os.listdir(f"{tmp_path}/cp/commits"):
        os.remove(f"{tmp_path}/cp/commits/{name}")
    run()
    assert log().count() == 4
    requests.put_batch(spark.createDataFrame([("a", "1", 9, 0), ("c", "1", 5, 1)], schema), 1, at("log"))
    requests.put_batch(spark.createDataFrame([("a", "1", 9, 0), ("c", "1", 5, 1)], schema), 1, at("log"))
    got = {(r.identity, r.sample): r.v for r in requests.enrolled(log(), ("identity", "sample"), "ts").collect()}
    assert got == {("a", "1"): 9, ("a", "2"): 2, ("b", "1"): 4, ("c", "1"): 5}


def test_snapshots_change_in_one_step(spark, tmp_path, monkeypatch):
    kept = store.Snapshots(spark, f"file://{tmp_path}")
    assert api.restored(spark, kept, "faces") is None
    reg = trained(spark)
    assert reg.snapshot(kept, "faces") == 1
    back = api.restored(spark, kept, "faces")
    probe = spark.createDataFrame([(1, 48, 64, 1, bytearray(face(2, 7).tobytes()))], "probe_id long, " + RASTER)
    assert back.recognize(probe, 0.0).collect()[0].name == reg.recognize(probe, 0.0).collect()[0].name == "P2"
    assert np.allclose(back.model.axes, reg.model.axes) and back.status().collect()[0].state == "READY"
    fewer = reg.deactivate(reg.identities.where("name = 'P2'").select("id"))
    with monkeypatch.context() as m:
        m.setattr(store.Snapshots, "_write", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):  # between the data and the manifest
            fewer.snapshot(kept, "faces")
    assert api.restored(spark, kept, "faces").identities.where("active").count() == 4
    assert fewer.snapshot(kept, "faces") == 2
    assert api.restored(spark, kept, "faces").identities.where("active").count() == 3
    assert api.restored(spark, kept, "faces", 1).identities.where("active").count() == 4 and api.restored(spark, kept, "faces", 7) is None
    assert kept.prune("faces", 1) == 2 and api.restored(spark, kept, "faces").identities.count() == 4
    with pytest.raises(ValueError):
        api.registry(spark).snapshot(kept, "x")
    with pytest.raises(ValueError):
        kept.publish("../x", {}, {})


@pytest.mark.parametrize("algorithm", ["pca", "lda"])
def test_weights_count_as_repeated_rows(spark, algorithm):
    r = np.random.default_rng(1)
    rows = [(f"l{i % 3}", (r.normal(size=5) + np.eye(5)[i % 3] * 4).tolist(), int(r.integers(0, 4))) for i in range(60)]
    df = spark.createDataFrame(rows, "label string, v array<double>, w int")
    one = models.EXTRACTORS[algorithm].fit(df, "v", "label", 4, "w")
    two = models.EXTRACTORS[algorithm].fit(df.withColumn("_", F.explode(F.when(F.col("w") > 0, F.sequence(F.lit(1), F.col("w"))))), "v", "label", 4)
    assert np.allclose(one.mean, two.mean) and np.allclose(one.values, two.values) and np.allclose(one.axes, two.axes)


def test_training_on_pairs(spark):
    reg = trained(spark)
    ids = {r.name: r.id for r in reg.identities.collect()}
    key = lambda i, n: f"{ids[f'P{i}']}|s{n}"
    pairs = [(key(0, 0), key(0, 1)), (key(0, 0), key(1, 0)), (key(2, 1), key(2, 2)), (key(0, 0), "nobody|s1"), (key(3, 0), key(3, 0))]
    got = reg.train_on_pairs(spark.createDataFrame(pairs, "a string, b string"), 3)
    each = [face(*at).astype(float) for at in ((0, 0), (0, 1), (0, 0), (1, 0), (2, 1), (2, 2), (0, 0), (3, 0), (3, 0))]
    x = np.array([g.ravel() for g in each])
    w = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    assert np.allclose(got.mean, x.mean(0)) and np.allclose(got.values, w[:3])
    with pytest.raises(ValueError):
        api.registry(spark, "lbph").train_on_pairs(spark.createDataFrame(pairs, "a string, b string"))


def test_a_folder_is_recognised(spark, tmp_path):
    reg = trained(spark)
    for i in range(5):
        (tmp_path / f"P{i}").mkdir()
        for n in (5, 6):
            (tmp_path / f"P{i}/{n}.pgm").write_bytes(images.write_pgm(face(i, n)))
    (tmp_path / "P0/bad.pgm").write_bytes(b"P5 broken")
    got = reg.recognize_folder(f"file://{tmp_path}", threshold=0.0).cache()
    assert got.count() == 11 and {r.status for r in got.where("probe_id LIKE '%bad.pgm'").collect()} == {"ERROR"}
    row = api.validation(got).collect()[0]
    right = sum(r.name == r.expected for r in got.collect() if r.status == "RECOGNIZED")
    assert (row.correct, row.total, row.errors, row.no_face) == (right, 10, 1, 0) and right >= 7 and abs(row.accuracy - right * 10) < 1e-9
    none = reg.recognize_folder(f"file://{tmp_path}", threshold=0.0, detector="skin")
    row = api.validation(none).collect()[0]
    assert (row.total, row.no_face, row.accuracy) == (10, 10, 0.0)
    shutil.rmtree(tmp_path / "P0")
    assert api.validation(got.where("false")).collect()[0].accuracy == 0.0


def test_keys_of_any_size(spark):
    rows = [(2**31 + i if i % 2 else -(2**62) + i, f"p{i % 3}", [float(i % 3), 0.1 * i]) for i in range(12)]
    df = spark.createDataFrame(rows, "k long, who string, v array<double>")
    got = {r.k: r.predicted for r in matching.leave_one_out(df, "k", "who", "v", "euclidean").collect()}
    for k, who, v in rows:
        want = min((np.hypot(v[0] - u[0], v[1] - u[1]), w) for j, w, u in rows if j != k)[1]
        assert got[k] == want
    named = spark.createDataFrame([("a/1", [0.0, 0.0]), ("b/2", [2.0, 1.0])], "probe_id string, v array<double>")
    near = matching.nearest_by_identity(named, df.select(F.col("who").alias("identity"), "v"), keep=1)
    assert {(r.probe_id, r.identity) for r in near.collect()} == {("a/1", "p0"), ("b/2", "p2")}


def test_comparison_in_words(spark):
    rows = [("pca", 0.9, 12.0), ("lda", 0.95, 30.0), ("lbph", 0.95, None)]
    got = store.comparison(spark.createDataFrame(rows, "algorithm string, accuracy double, ms double"), "algorithm", ("accuracy", "ms"), ("accuracy",))
    by = {r.algorithm: r for r in got.collect()}
    assert (by["lda"].wins, by["pca"].wins, by["lbph"].wins) == (1, 1, 1) and by["lbph"].ms_rank == 3 and abs(by["pca"].accuracy_from_best - 0.05) < 1e-9
    text = store.comparison_text(got, "algorithm", ("accuracy", "ms"))
    assert text.splitlines()[0].startswith("accuracy: lbph is best with 0.9500") and "ms: pca is best with 12.0000" in text
    assert store.comparison_text(got.where("false"), "algorithm", ("ms",)) == "Nothing to compare.\n"


def test_strict_readers_raise(spark, tmp_path):
    (tmp_path / "good.pgm").write_bytes(images.write_pgm(face(1, 1)))
    (tmp_path / "bad.pgm").write_bytes(b"P5 broken")
    (tmp_path / "Subject02.Happy.pgm").write_bytes(images.write_pgm(face(1, 1)))
    (tmp_path / "subject03").write_bytes(images.write_pgm(face(1, 1)))
    at = f"file://{tmp_path}"
    assert readers.one(spark, f"{at}/good.pgm").collect()[0].width == 48
    with pytest.raises(FileNotFoundError):
        readers.one(spark, f"{at}/none.pgm")
    with pytest.raises(ValueError):
        readers.one(spark, f"{at}/subject03")
    for failing in (readers.one(spark, f"{at}/bad.pgm"), readers.images(spark, at, strict=True)):
        with pytest.raises(Exception, match="cannot be decoded: .*bad.pgm"):
            failing.collect()
    assert readers.images(spark, at).count() == 2
    assert [(r.label, r.metadata) for r in readers.yale(spark, at).collect()] == [("subject02", {"condition": "happy"})]


def test_settings_choose_the_parts(spark):
    assert settings.settings()["classification.metric"] == "euclidean"
    for bad in ({"detection.type": "eyes"}, {"nothing": 1}, {"image.width": "3"}, {"quality.on_enrol": "maybe"}, {"recognition.threshold": "x"}):
        with pytest.raises(ValueError):
            settings.settings(bad)
    spark.conf.set("spark.likeness.extraction.algorithm", "LDA")
    spark.conf.set("spark.likeness.recognition.threshold", "0.0")
    try:
        own = settings.from_session(spark)
    finally:
        spark.conf.unset("spark.likeness.extraction.algorithm")
        spark.conf.unset("spark.likeness.recognition.threshold")
    assert own["extraction.algorithm"] == "lda" and own["recognition.threshold"] == 0.0
    with pytest.raises(ValueError):
        settings.configured(spark, {"detection.type": "haar"})
    rows = [(f"P{i}", f"s{n}", 48, 64, 1, bytearray(face(i, n).tobytes())) for i in range(3) for n in range(3)]
    people = spark.createDataFrame(rows, "name string, sample_id string, " + RASTER)
    probes = spark.createDataFrame([(i, 48, 64, 1, bytearray(face(i, 4).tobytes())) for i in range(3)], "probe_id long, " + RASTER)
    for given in ({"extraction-algorithm".replace("-", "."): "lbph", "extraction.lbph.grid": 4, "classification.metric": "chi_square"}, {"extraction.algorithm": "lda", "classification.average": "true"}):
        who = settings.configured(spark, {**given, "recognition.threshold": 0.0, "image.width": 40, "image.height": 50, "quality.min_score": 0.0}).enroll(people).train()
        got = {r.probe_id: r.name for r in who.recognize(probes).collect()}
        assert got == {i: f"P{i}" for i in range(3)}
    who = settings.configured(spark, {"detection.type": "haar", "recognition.threshold": 0.0}, haar.Cascade(12, 12, [(9.0, [(0, 0.0, 1.0, 1.0)])], [[(0, 0, 12, 12, 1.0)]]))
    assert {r.status for r in settings.Recognizer(trained(spark), who.settings, who.cascade).recognize(probes).collect()} == {"NO_FACE_DETECTED"}


def test_an_extractor_can_be_added(spark, monkeypatch):
    halves = models.Extractor(lambda g: np.array([g[:32].mean(), g[32:].mean(), g[:, :24].mean(), g[:, 24:].mean(), g.std()]))
    monkeypatch.setitem(models.EXTRACTORS, "halves", halves)
    reg = trained(spark, "halves")
    assert reg.model is None and len(reg.samples.first().features) == 5
    probes = spark.createDataFrame([(i, 48, 64, 1, bytearray(face(i, 5).tobytes())) for i in range(4)], "probe_id long, " + RASTER)
    assert sum(r.name == f"P{r.probe_id}" for r in reg.recognize(probes, 0.0).collect()) >= 3


def test_the_last_row_of_equal_ones_is_fixed(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 4, "z"), (None, 1, "n"), (2, None, "m")], "k int, o int, v string")
    assert sorted((r.k or 0, r.v) for r in gallery.last_wins(df, "k", "o").collect()) == [(0, "n"), (1, "b"), (2, "m")]
