"""Closed-form cases and invariants of the functions, kernels, models, sources and sinks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from likeness.functions import colour, geometry, text, vectors
from likeness.operators import boxes, gallery, haar, images, matching, metrics, models, order
from likeness.sources import images as sources, store
from likeness.streaming import requests


def one(spark, *cols):
    return spark.range(1).select(*cols).collect()[0]


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_vector_scalars(spark):
    r = one(
        spark,
        vectors.euclidean(arr(0, 0, 0), arr(3, 4, 0)).alias("e"),
        vectors.cosine_similarity(arr(1, 0), arr(-1, 0)).alias("c"),
        vectors.cosine(arr(0, 0), arr(1, 0)).alias("z"),
        vectors.manhattan(arr(1, 2, 3), arr(4, 6, 8)).alias("m"),
        vectors.chi_square(arr(0.5, 0.5, 0), arr(0.25, 0.75, 0)).alias("x"),
        vectors.norm(arr(3, 4)).alias("n"),
        vectors.normalize(arr(3, 4)).alias("u"),
        vectors.normalize(arr(0, 0)).alias("u0"),
        vectors.add(arr(1, 2), arr(3, 4)).alias("a"),
        vectors.subtract(arr(5, 7), arr(2, 3)).alias("s"),
        vectors.scale(arr(2, 3), 2).alias("k"),
        vectors.dot(arr(1, 2, 3), arr(4, 5, 6)).alias("d"),
        vectors.confidence(F.lit(2000.0)).alias("conf"),
    )
    assert (r.e, r.c, r.m, r.n, r.d) == (5, -1, 12, 5, 32) and math.isnan(r.z)
    assert abs(r.x - 0.1333333) < 1e-6 and r.u == [0.6, 0.8] and r.u0 == [0, 0]
    assert (r.a, r.s, r.k) == ([4, 6], [3, 4], [4, 6]) and abs(r.conf - math.exp(-0.4)) < 1e-12
    assert abs(vectors.distance_limit(0.6, "cosine") - 0.2554) < 1e-4


def test_dimension_guard(spark):
    with pytest.raises(Exception, match="same dimension"):
        one(spark, vectors.checked(arr(1, 2), arr(1, 2, 3), F.lit(0.0)).alias("d"))


def test_matching(spark):
    g = spark.createDataFrame([("e1", [1.0, 0.0, 0.0, 0.0]), ("e2", [0.0, 1.0, 0.0, 0.0]), ("e3", [0.0, 0.0, 1.0, 0.0]), ("e2", [9.0, 9.0, 9.0, 9.0])], "identity string, v array<double>")
    p = spark.createDataFrame([(1, [0.1, 0.9, 0.1, 0.0]), (2, [1000.0, 0.0, 0.0, 0.0])], "probe_id long, v array<double>")
    d = matching.nearest_by_identity(p, g)
    got = {r.probe_id: r for r in matching.classify(d, 0.9).collect()}
    assert got[1].identity == "e2" and got[1].status == "RECOGNIZED" and len(got[1].alternatives) == 2
    assert got[2].status == "UNKNOWN" and got[2].identity is None and got[2].confidence == 0 and len(got[2].alternatives) == 3
    assert {r.rn for r in matching.top_matches(d, 0, 0.5).collect()} == {1}
    nan = matching.nearest_by_identity(p.limit(1), spark.createDataFrame([("a", [float("nan")] * 4), ("a", [0.0] * 4)], g.schema), "euclidean").collect()[0]
    assert math.isnan(nan.distance)


def test_matching_is_the_same_in_shards(spark, monkeypatch):
    rng = np.random.default_rng(0)
    g = spark.createDataFrame([(str(i % 7), rng.normal(size=5).tolist()) for i in range(200)], "identity string, v array<double>")
    p = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(30)], "probe_id long, v array<double>")
    whole = {(r.probe_id, r.identity): r.distance for r in matching.nearest_by_identity(p, g, "manhattan").collect()}
    monkeypatch.setattr(matching, "SHARD", 16)
    monkeypatch.setattr(matching, "BLOCK", 7)
    assert whole == {(r.probe_id, r.identity): r.distance for r in matching.nearest_by_identity(p, g, "manhattan").collect()} and len(whole) == 210


@pytest.mark.parametrize("fold", [None, "fold"])
def test_first_identities_are_the_same_when_tasks_keep_few(spark, monkeypatch, fold):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(matching, "SHARD", 16)
    monkeypatch.setattr(matching, "BLOCK", 7)
    # one identity with a third of all samples, ties, and samples without direction (NaN by cosine)
    who = ["large"] * 60 + [f"i{i % 40:02d}" for i in range(120)]
    v = [rng.integers(-2, 3, 3).astype(float).tolist() for _ in who]
    v[100] = v[110] = [0.0] * 3
    g = spark.createDataFrame([(w, x, i % 3) for i, (w, x) in enumerate(zip(who, v))], "identity string, v array<double>, fold int")
    p = spark.createDataFrame([(i, rng.integers(-2, 3, 3).astype(float).tolist() if i else [0.0] * 3, i % 3) for i in range(20)], "probe_id long, v array<double>, fold int")

    def first(keep, k):
        got = {}
        for r in matching.nearest_by_identity(p, g, "cosine", fold, keep).collect():
            got.setdefault(r.probe_id, []).append((math.isnan(r.distance), 0 if math.isnan(r.distance) else r.distance, r.identity))
        return {i: sorted(x)[:k] for i, x in got.items()}, sum(map(len, got.values()))

    for k in (1, 4, 41):
        (want, most), (have, few) = first(None, k), first(k, k)
        assert have == want and len(have) == 20
        assert few < most if k == 1 else few <= most


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "manhattan", "chi_square"])
def test_screened_minima_equal_comparing_all_pairs(monkeypatch, metric):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(matching, "TILE", 700)
    monkeypatch.setattr(matching, "PAIRS", 50)
    computed = []
    monkeypatch.setattr(matching.Screen, "distances", lambda self, i, j, f=matching.Screen.distances: computed.append(len(i)) or f(self, i, j))
    for case in range(40):
        n, m, d, parts = int(rng.integers(1, 90)), int(rng.integers(1, 40)), int(rng.integers(1, 20)), int(rng.integers(1, 12))
        b = rng.normal(size=(n, d)) if case % 4 else rng.integers(-1, 2, (n, d)).astype(float)
        a = rng.normal(size=(m, d)) if case % 4 else b[rng.integers(0, n, m)]
        if metric == "chi_square" and case % 5:
            a, b = np.abs(a), np.abs(b)
        a, b = ([a, a + 1e3, a * 1e-7, a * 1e200][case % 10 % 4], [b, b + 1e3, b * 1e-7, b * 1e200][case % 10 % 4]) if case % 3 == 0 else (a, b)
        if case % 7 == 0:
            a[0], b[-1] = np.nan, 0
        if case % 7 == 1:
            a[-1] = 0
        where = np.sort(rng.integers(0, parts, n))
        cuts = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
        own, theirs = ((np.arange(m), np.arange(n)) if case % 2 else (rng.integers(0, 3, m), rng.integers(0, 3, n))) if case % 3 else (None, None)
        with np.errstate(all="ignore"):
            full = matching.block_distances(metric, a, b)
            full = np.where(own[:, None] == theirs[None, :], np.inf, full) if own is not None else full
            full = np.minimum.reduceat(full, cuts, axis=1)
            for keep in (1, 3, 20, None):
                got = {(int(i), int(j)): x for i, j, x in zip(*matching.part_minima(metric, a, b, cuts, keep, own, theirs))}
                want = {}
                for i, row in enumerate(full):
                    order = sorted((j for j in range(len(row)) if not np.isposinf(row[j])), key=lambda j: (np.isnan(row[j]), row[j], j))
                    want |= {(i, j): row[j] for at, j in enumerate(order) if keep is None or at < keep or np.isnan(row[j])}
                assert got.keys() == want.keys() and all(got[k] == want[k] or np.isnan(got[k]) and np.isnan(want[k]) for k in want)
    # among many rows few pairs are computed
    monkeypatch.setattr(matching, "TILE", 1 << 20)
    a, b = np.abs(rng.normal(size=(200, 64))) + 1, np.abs(rng.normal(size=(5000, 64))) + 1
    computed.clear()
    matching.part_minima(metric, a, b, np.arange(0, 5000, 500), 1)
    assert 0 < sum(computed) < 200 * 5000 / 20


def test_geometry(spark):
    b = lambda *v: [F.lit(x) for x in v]
    iou = lambda a, c: one(spark, geometry.iou(*b(*a), *b(*c)).alias("v")).v
    assert iou((0, 0, 100, 100), (0, 0, 100, 100)) == 1 and iou((0, 0, 10, 10), (10, 0, 10, 10)) == 0
    assert abs(iou((0, 0, 100, 100), (50, 50, 100, 100)) - 1 / 7) < 1e-9 and iou((0, 0, 100, 100), (25, 25, 50, 50)) == 0.25
    box = b(10, 10, 100, 100)
    r = one(spark, *[geometry.contains_point(*box, F.lit(x), F.lit(y)).alias(f"p{x}") for x, y in ((50, 50), (109, 50), (110, 110), (0, 0))], geometry.expand(*b(50, 50, 100, 100), 1.5).alias("e"), geometry.expand(*b(50, 50, 101, 101), 0.5).alias("s"))
    assert (r.p50, r.p109, r.p110, r.p0) == (True, True, False, False)
    assert tuple(r.e) == (25, 25, 150, 150) and tuple(r.s) == (75, 75, 50, 50)
    with pytest.raises(Exception, match="need 5 points"):
        one(spark, geometry.landmarks(F.array(F.lit(1)), "FIVE", F.lit(1.0)).alias("l"))


def test_colours(spark):
    r = one(spark, *[colour.gray_mean(*[F.lit(x) for x in v]).alias(f"g{i}") for i, v in enumerate([(255, 0, 0), (0, 0, 255), (255, 255, 255), (0, 0, 0)])], colour.hsv(F.lit(255), F.lit(0), F.lit(10)).alias("h"))
    assert (r.g0, r.g1, r.g2, r.g3) == (85, 85, 255, 0) and abs(r.h.h - (-10 / 255 + 6) / 6) < 1e-9
    yes, no = {0, 1, 2, 3, 7, 15, 31, 63, 127, 255, 128, 192, 224, 240, 248, 252, 254}, {5, 10, 42, 85, 170, 105, 150, 90}
    got = {r.i for r in spark.range(256).select(F.col("id").cast("int").alias("i")).where(colour.is_uniform(F.col("i"))).collect()}
    assert yes <= got and not no & got and len(got) == 58


def test_names(spark):
    df = spark.createDataFrame([("a_b_3.png",), ("x.JPG",), ("_q.bmp",), ("noext",)], "n string")
    got = [tuple(r) for r in df.select(text.flat_label(F.col("n")), text.image_format(F.col("n")), text.regex_label(F.col("n")), text.is_image(F.col("n"))).collect()]
    assert got == [("a_b", "PNG", "a_b", True), ("x", "JPEG", "x", True), ("_q", "BMP", "_q", True), ("noext", "UNKNOWN", None, False)]
    r = one(spark, text.trace_id(F.lit(" "), F.lit("b")).alias("t"), text.client_key(F.lit(" 1.2.3.4 , 5"), F.lit("r")).alias("c"), text.client_key(F.lit(None).cast("string"), F.lit("r")).alias("d"), text.file_size(F.lit(1536)).alias("s"), text.error_code(F.lit("Face not here")).alias("e"), text.csv_quoted(F.lit('a"b')).alias("q"), text.model_base_name(F.lit(".bin")).alias("m"), text.merged_map(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2))).alias("k"))
    assert (r.t, r.c, r.d, r.s, r.e, r.q, r.m, r.k) == ("b", "1.2.3.4", "r", "1.5 KB", "FACE_NOT_DETECTED", '"a""b"', "default", {"a": 2})


def test_kernels():
    white, black = np.full((30, 30, 3), 255), np.zeros((30, 30, 3), int)
    assert abs(images.quality(white)["brightness"] - 1) < 1e-9 and images.quality(black)["contrast"] == 0
    flat = images.lbp(np.full((20, 20), 9))
    assert (flat[1:-1, 1:-1] == 255).all() and flat[0].sum() == 0
    h = images.lbp_histogram((np.indices((64, 48)).sum(0) % 2) * 255)
    assert len(h) == 16384 and np.allclose(h.reshape(64, 256).sum(1), 1)
    assert images.equalize(np.full((5, 5), 7)).max() == 0
    g = np.random.default_rng(0).integers(0, 256, (40, 30))
    assert (images.resize(g, 30, 40) == g).all() and images.crop(g, 50, 50, 5, 5).shape == g.shape
    ii = images.integral(g)
    assert images.box_sum(ii, 3, 4, 10, 12) == g[4:16, 3:13].sum()
    m = g > 120
    e, d = images.erode(m, 3), images.dilate(m, 3)
    for y in range(1, 39):
        for x in range(1, 29):
            n = m[y - 1 : y + 2, x - 1 : x + 2]
            assert e[y, x] == n.all() and d[y, x] == n.any()
    two = np.zeros((20, 20), bool)
    two[2:6, 2:6] = two[10:18, 3:9] = True
    assert [(c["x"], c["y"], c["w"], c["h"], c["count"]) for c in images.components(two, 10)] == [(2, 2, 4, 4, 16), (3, 10, 6, 8, 48)]
    p = images.read_pgm(b"P5\n# c\n3 2\n255\n" + bytes(range(6)))
    assert p.tolist() == [[0, 1, 2], [3, 4, 5]] and (images.read_pgm(images.write_pgm(g)) == g).all()
    assert images.read_pgm(b"P2 2 2 9 1 2 3").tolist() == [[1, 2], [3, 0]]
    assert images.read_pgm(b"P5 1 1 65535\n\xff\xff").tolist() == [[255]]
    turned = images.align(g, (8.0, 20.0), (22.0, 20.0), 40, 40)
    assert turned.shape == (40, 40) and images.clahe(g, 8, 2.0).shape == g.shape
    skin = np.zeros((120, 120, 3), int)
    skin[20:90, 30:90] = (200, 140, 110)
    assert len(images.skin_regions(skin)) == 1
    assert images.align_region(skin, 30, 20, 60, 70, 48, 64).shape == (64, 48)


def test_merges(spark):
    rows = [(1, 1, 0, 0, 100, 100, 0.5), (1, 2, 5, 5, 100, 100, 0.9), (1, 3, 300, 300, 50, 50, 0.4), (2, 1, 0, 0, 10, 10, 0.7)]
    df = spark.createDataFrame(rows, boxes.SCHEMA)
    got = sorted((r.image_id, r.box_id, round(r.confidence, 3)) for r in boxes.merged_greedily(df).collect())
    assert got == [(1, 1, 0.99), (1, 3, 0.44), (2, 1, 0.7)]
    got = sorted((r.image_id, r.box_id, r.x, r.confidence) for r in boxes.merged_detections(df, 0.4, 1).collect())
    assert got == [(1, 1, 2, 1.0), (1, 3, 300, 0.5), (2, 1, 0, 1.0)]


CASCADE = """<opencv_storage><cascade><height>12</height><width>12</width><stages><_><stageThreshold>-0.5</stageThreshold><weakClassifiers><_>
<internalNodes>0 -1 0 0.0</internalNodes><leafValues>-0.75 0.75</leafValues></_></weakClassifiers></_></stages>
<features><_><rects><_>0 0 12 12 -1.</_><_>0 0 12 6 2.</_></rects></_></features></cascade></opencv_storage>"""


def test_cascade():
    c = haar.read_cascade(CASCADE)
    assert (c.width, c.height, len(c.stages), c.stages[0][0]) == (12, 12, 1, -0.5) and c.features[0][1] == (0, 0, 12, 6, 2.0)
    for bad in ("<a/>", CASCADE.replace("<width>12</width>", ""), CASCADE.replace("-0.75 0.75", "x"), "<"):
        with pytest.raises(ValueError):
            haar.read_cascade(bad)
    img = np.zeros((60, 60), int)
    img[10:30, 10:50] = 200
    found = haar.detect(img, c, least_side=24)
    assert found and found[0]["confidence"] == 1.0 and haar.detect(np.full((60, 60), 9), c) == []


def test_subspaces(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(3, 6)) * 8
    x = np.concatenate([centre[i] + rng.normal(size=(40, 6)) * [3, 2, 1, 0.5, 0.2, 0.1] for i in range(3)])
    df = spark.createDataFrame([(i, str(i // 40), v.tolist()) for i, v in enumerate(x)], "id long, label string, v array<double>")
    m = models.fit_pca(df, 4, normalise=False)
    w = np.sort(np.linalg.eigvalsh((x - x.mean(0)).T @ (x - x.mean(0))))[::-1]
    assert np.allclose(m.values, w[:4]) and np.allclose(m.ratio, w[:4] / w.sum()) and np.allclose(m.axes.T @ m.axes, np.eye(4))
    full = models.fit_pca(df, 6, normalise=False)
    assert np.allclose(full.reconstruct(full.project(x)), x)
    mean, within, between, n = models.scatter(models.moments(df, "v", "label"))
    assert n == 120 and np.allclose(within + between, (x - x.mean(0)).T @ (x - x.mean(0)))
    lda = models.fit_lda(df, "label", 5)
    y = lda.project(x)
    assert lda.axes.shape == (6, 2) and np.allclose((y**2).sum(1), 1)
    own = np.array([y[i * 40 : i * 40 + 40].mean(0) for i in range(3)])
    assert (((y[:, None] - own[None]) ** 2).sum(2).argmin(1) == np.arange(120) // 40).mean() > 0.9
    back = models.restored(full.transform(df), full).orderBy("id").collect()
    assert np.allclose([r.restored for r in back], x)
    rows = m.transform(df).orderBy("id").collect()
    assert np.allclose([r.features for r in rows], m.project(x))
    with pytest.raises(ValueError):
        models.fit_lda(df.where("label = '1'"), "label", 2)
    with pytest.raises(NotImplementedError):
        models.deep_extractor("x.onnx")


def test_wide_components_equal_the_full_ones(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(300, 150)) * 0.9 ** np.arange(150) @ np.linalg.qr(r.normal(size=(150, 150)))[0] + 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(5)
    one, two = models.fit_pca(df, 6), models.fit_pca_wide(df, 6)
    assert np.allclose(one.values, two.values) and np.allclose(one.ratio, two.ratio) and np.allclose(one.axes, two.axes, atol=1e-5)
    few = models.fit_pca_wide(df.limit(4), 6)
    assert len(few.values) == 3 and np.allclose(few.axes.T @ few.axes, np.eye(3))
    with pytest.raises(ValueError):
        models.fit_pca_wide(df.limit(0), 2)


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}")
    df = spark.createDataFrame([(i, [float(i), float(i % 3), 1.0]) for i in range(9)], "id long, v array<double>")
    m = models.fit_pca(df, 2)
    s.save("m-1", m, spark.createDataFrame([("a", [1.0])], "identity string, v array<double>"))
    with pytest.raises(FileExistsError):
        s.save("m-1", m)
    got = s.load("m-1")
    assert np.allclose(got.axes, m.axes) and np.allclose(got.mean, m.mean) and s.identities("m-1").count() == 1
    s.backup("m-1", "b1")
    assert s.delete("m-1") and s.load("m-1") is None and s.backups() == ["b1"]
    s.restore("b1", "m-2")
    s.export("m-2", f"file://{tmp_path}/out")
    assert s.import_(f"file://{tmp_path}/out", "m-3")["algorithm"] == "pca"
    assert {i["name"] for i in s.models("pca")} == {"m-1"} and s.size() > 0 and s.delete_backup("b1")
    with pytest.raises(ValueError):
        s.save("../x", m)
    assert "| a |" in store.markdown([{"a": 1.0}]) and "<td>1.0000</td>" in store.html([{"a": 1.0}])


def test_sources(spark, tmp_path):
    g = np.arange(48 * 64).reshape(64, 48) % 256
    for p in ("orl/s1/1.pgm", "orl/s2/1.pgm", "orl/x/1.pgm", "yale/subject01.happy.pgm", "yale/other.pgm", "lfw/Ann_Lee/Ann_Lee_0001.pgm", "lfw/Bob/Bob_0002.pgm", "flat/a_b_1.pgm"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(images.write_pgm(g))
    (tmp_path / "orl/s1/2.pgm").write_bytes(b"P5 broken")
    at = f"file://{tmp_path}"
    assert sorted(r.label for r in sources.read(spark, f"{at}/orl", "orl").collect()) == ["s1", "s2"]
    y = sources.read(spark, f"{at}/yale", "yale").collect()
    assert [(r.label, r.metadata) for r in y] == [("subject01", {"condition": "happy"})] and (y[0].width, y[0].height) == (48, 64)
    assert sorted(r.label for r in sources.lfw(spark, f"{at}/lfw").collect()) == ["Ann Lee", "Bob"]
    (tmp_path / "pairs.txt").write_text("1\nAnn_Lee 1 1\nAnn_Lee 1 Bob 2\nBob 2 9\n")
    pairs = sources.lfw_pairs(spark, f"{at}/pairs.txt", sources.lfw(spark, f"{at}/lfw")).collect()
    assert sorted(r.same for r in pairs) == [False, True]
    assert [r.label for r in sources.read(spark, f"{at}/flat", "flat").collect()] == ["a_b"]
    assert sorted(r.label for r in sources.read(spark, f"{at}/lfw", "tree").collect()) == ["Ann_Lee", "Bob"]
    bad = sources.decoded(sources.files(spark, f"{at}/orl/s1", "*.pgm"), keep_bad=True).where("data is null").count()
    assert bad == 1


def test_failing_images_stay_as_rows(spark):
    df = spark.createDataFrame([(1, 2, 2, 1, bytearray(b"\x01\x02\x03\x04")), (2, 2, 2, 1, bytearray(b"\x01"))], "image_id long, width int, height int, channels int, data binary")
    got = {r.image_id: r for r in images.map_images(df, lambda g: {"total": int(g.sum())}, "total long").collect()}
    assert got[1].total == 10 and got[1].error is None and got[2].total is None and "reshape" in got[2].error


def test_rate_limit_by_hand(spark):
    rows = [(i, "a", float(t)) for i, t in enumerate([0, 1, 2, 31, 32, 100])] + [(9, "b", 0.0)]
    df = spark.createDataFrame(rows, "request_id long, client string, t double").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.request_id: r.allowed for r in requests.rate_limited(df, 2.0).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: False, 5: True, 9: True}


def test_streams(spark, tmp_path):
    rows = [(i, "a", float(t)) for i, t in enumerate([0, 1, 2, 31, 32, 100])]
    spark.createDataFrame(rows, "request_id long, client string, t double").withColumn("ts", F.timestamp_seconds("t")).coalesce(1).write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema("request_id long, client string, t double, ts timestamp").parquet(f"{tmp_path}/in")
    q = requests.rate_limited_stream(src.select("client", "ts"), 2.0).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.allowed for r in spark.sql("select * from limited order by ts").collect()] == [True, True, False, True, False, True]
    q = requests.outcome_counts(src, "client").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.client, r.n) for r in spark.sql("select * from counted").collect()] == [("a", 6)]
    requests.enrolment_stream(src, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6


def test_splits(spark):
    df = spark.range(103).withColumn("label", (F.col("id") % 4).cast("string"))
    k = order.k_fold(df, "id", 5, 1).groupBy("fold").count().collect()
    assert {r.fold: r["count"] for r in k} == {0: 20, 1: 20, 2: 20, 3: 20, 4: 23}
    assert order.holdout(df, "id", 0.7, 1).where("is_train").count() == 72
    few = order.stratified_k_fold(df.where("id < 8"), "id", "label", 5, 1).collect()
    assert {r.fold for r in few} == {4}
    assert sorted(r.rn for r in order.seeded(df, "id", 9).collect()) == list(range(1, 104))


def test_registry_updates(spark):
    people = spark.createDataFrame([("1", "A", None, True, None), ("2", "B", None, True, None)], "id string, name string, external_id string, active boolean, updated_at timestamp")
    new = gallery.upsert(people, spark.createDataFrame([("9", "A"), ("8", "C"), ("7", "C")], "id string, name string"))
    assert sorted(r.name for r in new.collect()) == ["A", "B", "C"]
    samples = spark.createDataFrame([("1", "s1", [1.0, 2.0], 0.7, "f"), ("1", "s2", [3.0, 4.0], 0.95, "g")], "identity_id string, sample_id string, features array<double>, quality double, source string")
    view = {r.id: r for r in gallery.identity_view(people, samples).collect()}
    assert view["1"].sample_count == 2 and view["2"].average_quality == 0.0 and view["1"].samples[0].dimension == 2
    cent = matching.centroids(samples.select(F.col("identity_id").alias("identity"), F.col("features").alias("v"))).collect()
    assert cent[0].v == [2.0, 3.0]


def test_metric_invariants(spark):
    rows = [(i, str(i % 3), str(i % 3) if i % 4 else "UNKNOWN" if i % 8 else str((i + 1) % 3), 0.5, float(i)) for i in range(60)]
    p = spark.createDataFrame(rows, "probe_id long, actual string, predicted string, confidence double, distance double")
    pts = metrics.curve_points(p)
    a = metrics.auc(pts).collect()[0].auc
    assert 0 <= a <= 1 and 0 <= metrics.equal_error(pts).collect()[0].eer <= 1
    assert metrics.confusion_wide(p).count() == 3
    m = metrics.micro(p).collect()[0]
    assert m.tp + m.fp + m.fn == 60
    same = spark.createDataFrame([(0, 0.5), (1, 0.7)], "fold int, accuracy double")
    assert math.isnan(metrics.paired_t_test(same, same).collect()[0].t)
    assert abs(one(spark, metrics.erfc(F.lit(1.0)).alias("e")).e - math.erfc(1)) < 2e-7


def test_readers_give_the_same_rows_for_every_format(spark, tmp_path):
    """One raster as PGM and, written by the JVM's own encoders, as PNG and BMP; a broken file is counted."""
    from likeness.operators import images as I
    from likeness.sources import images as S

    g = (np.arange(48 * 64).reshape(64, 48) * 7 % 256).astype(np.uint8)
    for kind in ("pgm", "png", "bmp"):
        (tmp_path / kind / "Ann_Lee").mkdir(parents=True)
    (tmp_path / "pgm" / "Ann_Lee" / "Ann_Lee_0001.pgm").write_bytes(I.write_pgm(g))
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(48, 64, 5)
    for y in range(64):
        for x in range(48):
            v = int(g[y, x])
            image.setRGB(x, y, (v << 16) | (v << 8) | v)
    for kind in ("png", "bmp"):
        assert jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(str(tmp_path / kind / "Ann_Lee" / f"Ann_Lee_0001.{kind}")))
    got = {k: [(r.label, r.width, r.height, r.channels, bytes(r.data)) for r in S.lfw(spark, str(tmp_path / k)).collect()] for k in ("pgm", "png", "bmp")}
    assert got["pgm"] == got["png"] == got["bmp"] == [("Ann Lee", 48, 64, 1, g.tobytes())]
    (tmp_path / "png" / "Ann_Lee" / "bad.png").write_bytes(b"no image")
    assert S.lfw(spark, str(tmp_path / "png")).count() == 1
    assert [tuple(r) for r in S.undecoded(spark, str(tmp_path / "png"), recursive=True).collect()] == [("png", 1)]


def test_detections_merged_by_batch_equal_one_image_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(None if i % 11 == 0 else i % 40 // 2, k, *[int(v) for v in rng.integers(0, 60, 2)], *[int(v) for v in rng.integers(5, 30, 2)], 1.0) for k, i in enumerate(rng.integers(0, 40, 400).tolist())]
    rows += [(99, k, k, 0, 10, 10, 1.0) for k in range(300)]  # one chain, longer than a batch
    want = []
    for image in {r[0] for r in rows}:
        own = [dict(zip(("image_id", "box_id", "x", "y", "w", "h"), r)) for r in rows if r[0] == image]
        groups = {}
        for r, g in zip(own, boxes.union_find(own, 0.1)):
            groups.setdefault(g, []).append(r)
        top = max(map(len, groups.values()))
        want += [(image, m[0]["box_id"], *[sum(r[c] for r in m) // len(m) for c in "xywh"], len(m) / top) for m in groups.values() if len(m) >= 2]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = boxes.merged_detections(spark.createDataFrame(rows, boxes.SCHEMA), 0.1, 2).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    none = lambda r: (r[0] is None, *[-1 if v is None else v for v in r])
    assert sorted(map(tuple, got), key=none) == sorted(want, key=none)
    # all images of a batch in one call
    monkeypatch.setattr(boxes, "_PAIRS", 50)
    own = sorted((r for r in rows if r[0] is not None), key=lambda r: r[:2])
    label = boxes._groups(*(np.array([r[k] for r in own]) for k in (0, 2, 3, 4, 5)), 0.1)
    assert len(set(label)) == len({(r[0], g) for r in {x[0]: x for x in own}.values() for q in [[dict(zip(("image_id", "box_id", "x", "y", "w", "h"), x)) for x in own if x[0] == r[0]]] for g in boxes.union_find(q, 0.1)})


def test_nearest_of_own_label(spark):
    rng = np.random.default_rng(5)
    g = [(f"i{i % 3}" if i % 7 else None, rng.normal(size=4).tolist()) for i in range(60)] + [("n", [math.nan] * 4), ("n", [1.0] * 4), ("m", [math.nan] * 4)]
    p = [(i, ["i0", "i1", "i2", "n", "m", "none", None][i % 7], rng.normal(size=4).tolist()) for i in range(40)]
    got = {r.probe_id: r.distance for r in matching.nearest_of_own(spark.createDataFrame(p, "probe_id long, who string, v array<double>"), spark.createDataFrame(g, "who string, v array<double>"), "who").collect()}
    for i, who, v in p:
        d = [math.dist(v, u) for w, u in g if w == who and who is not None]
        best = min((x for x in d if not math.isnan(x)), default=math.nan)
        assert (i in got) == bool(d) and (not d or math.isnan(best) and math.isnan(got[i]) or abs(got[i] - best) < 1e-12)


def test_first_of_a_spread_identity_beside_its_not_a_number(spark, monkeypatch):
    monkeypatch.setattr(matching, "SHARD", 4)
    g = [("a", [math.nan, 0.0])] + [("a", [float(i), 1.0]) for i in range(20)] + [(w, [float(i), 3.0]) for w in "bc" for i in range(20)]
    p = spark.createDataFrame([(1, [2.0, 2.0])], "probe_id long, v array<double>")
    got = matching.nearest_by_identity(p, spark.createDataFrame(g, "identity string, v array<double>"), "euclidean", keep=1).collect()
    assert sorted((r.identity, math.isnan(r.distance)) for r in got) == [("a", True), ("b", False)]


def test_display_text_and_words_of_the_whole_text(spark, tmp_path):
    from likeness.plans import identities

    text = " ".join(f"w{i}" for i in range(500))
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    r = identities.text_truncate(spark, str(tmp_path)).collect()[0]
    assert r.short == text[:18] + ".." and r.words == 500


def test_catalogue_sizes_at_halves(spark, tmp_path):
    import duckdb

    from likeness.plans import catalogue

    rows = [(i, "p", "t", "x", 1, n / 1000) for i, n in enumerate((1280, 1792, 2304, 1048576 + 52429 * 5, 1048576 * 2 + 262144, 1048576 + 786432, 500))]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = catalogue.queries()["model_catalog"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalogue.oracle_sql()['model_catalog']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {r.p_partkey: r.size_text for r in got.collect()}[0] == "1.3 KB"
