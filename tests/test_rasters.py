"""Pictures as tables of pixels against the array kernels, and curves against splitting anew."""

import numpy as np
import pytest

from likeness import api
from likeness.operators import boxes, curves, graph, haar, images, raster


def table(spark, pictures):
    rows = [(i, y, x, int(v)) for i, g in pictures.items() for (y, x), v in np.ndenumerate(g)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, v int")


def pictures(seed=1):
    r = np.random.default_rng(seed)
    return {1: r.integers(0, 256, (13, 17)), 2: r.integers(100, 140, (8, 8)), 3: np.full((5, 9), 7), 4: r.integers(0, 256, (30, 12)), 5: r.integers(0, 256, (1, 1))}


def arrays(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.image_id, {})[r.y, r.x] = r.v
    return {i: np.array([[p[y, x] for x in range(max(k[1] for k in p) + 1)] for y in range(max(k[0] for k in p) + 1)]) for i, p in out.items()}


def spiral(n):
    """One winding path of a pixel's width: the longest part that a square can hold."""
    m = np.zeros((n, n), int)
    m[0::2] = 1
    m[1::4, -1] = m[3::4, 0] = 1
    return m


@pytest.mark.parametrize("least", [1, 4])
def test_components_equal_the_array_kernel(spark, least):
    own = {k: (g > 120).astype(int) for k, g in pictures().items()} | {10: spiral(21), 11: np.ones((6, 40), int), 12: np.zeros((4, 4), int), 13: np.eye(9, dtype=int)}
    got = raster.components(table(spark, own), raster.F.col("v") == 1, least).collect()
    want = [(i, c["x"], c["y"], c["w"], c["h"], c["count"], c["cx"], c["cy"]) for i, g in own.items() for c in images.components(g == 1, least)]
    assert sorted((r.image_id, r.x, r.y, r.w, r.h, r["count"], r.cx, r.cy) for r in got) == sorted(want)
    assert all(own[r.image_id][r.first_y, r.first_x] for r in got)
    assert len({(r.image_id, r.first_y, r.first_x) for r in got}) == len(got)


def test_components_of_nothing(spark):
    none = spark.createDataFrame([], "image_id long, y int, x int, v int")
    assert raster.components(none, raster.F.col("v") == 1, 1).count() == 0
    rows = [(1, 0, 0, 1), (1, 0, 0, 1), (1, None, 3, 1), (None, 0, 0, 1)]
    got = raster.components(spark.createDataFrame(rows, "image_id long, y int, x int, v int"), raster.F.col("v") == 1, 1).collect()
    assert [(r.image_id, r["count"]) for r in got if r.image_id is not None] == [(1, 1)]


def test_graph_components(spark):
    r = np.random.default_rng(2)
    edges = [(int(g), int(a), int(b)) for g, a, b in zip(r.integers(0, 2, 150), r.integers(0, 200, 150), r.integers(0, 200, 150))] + [(2, i, i + 1) for i in range(300)] + [(3, 0, i) for i in range(1, 100)]
    nodes = [(g, i) for g in range(2) for i in range(200)] + [(2, i) for i in range(301)] + [(3, i) for i in range(100)]
    label = {n: n[1] for n in nodes}
    moved = True
    while moved:
        moved = False
        for g, a, b in edges:
            low = min(label[g, a], label[g, b])
            moved |= label[g, a] != low or label[g, b] != low
            label[g, a] = label[g, b] = low
    got = graph.components(spark.createDataFrame(nodes, "g int, id long"), spark.createDataFrame(edges, "g int, u long, v long"))
    assert {(r.g, r.id): r.label for r in got.collect()} == label


def test_resize_equals_the_array_kernel(spark):
    own = pictures()
    for w, h in ((17, 13), (5, 31), (1, 1)):
        got = arrays(raster.resized(table(spark, own), w, h))
        for i, g in own.items():
            y = np.clip((2 * np.arange(h) + 1) * g.shape[0] - h, 0, (g.shape[0] - 1) * 2 * h)
            x = np.clip((2 * np.arange(w) + 1) * g.shape[1] - w, 0, (g.shape[1] - 1) * 2 * w)
            y0, x0 = y // (2 * h), x // (2 * w)
            y1, x1, fy, fx = np.minimum(y0 + 1, g.shape[0] - 1), np.minimum(x0 + 1, g.shape[1] - 1), (y - y0 * 2 * h)[:, None], (x - x0 * 2 * w)[None]
            total = (g[np.ix_(y0, x0)] * (2 * w - fx) + g[np.ix_(y0, x1)] * fx) * (2 * h - fy) + (g[np.ix_(y1, x0)] * (2 * w - fx) + g[np.ix_(y1, x1)] * fx) * fy
            assert (got[i] == (2 * total + 4 * w * h) // (8 * w * h)).all()
            assert np.abs(got[i] - images.resize(g, w, h)).max() <= 1 and (got[i] != images.resize(g, w, h)).mean() < 0.05  # halves may fall either way there


def test_alignment_equals_the_array_kernel(spark):
    own = {k: g for k, g in pictures().items() if min(g.shape) > 4}
    eyes = [(i, 1.0 + i, 2.0, 5.5 + i % 2, 3.0 + i % 3) for i in own]
    frame = spark.createDataFrame(eyes, "image_id long, lx double, ly double, rx double, ry double")
    got = arrays(raster.aligned(table(spark, own), frame, 11, 9, 0.4, 0.3))
    for i, lx, ly, rx, ry in eyes:
        want = images.align(own[i], (lx, ly), (rx, ry), 11, 9, 0.4, 0.3)
        assert got[i].shape == want.shape and (got[i] != want).mean() < 0.03 and np.abs(got[i] - want)[got[i] * want > 0].max(initial=0) <= 1
    boxes = [(1, 2, 3, 10, 9), (4, -1 + 1, 20, 12, 30), (2, 6, 6, 40, 40)]
    frame = spark.createDataFrame(boxes, "image_id long, bx int, by int, bw int, bh int")
    got = arrays(raster.aligned_region(table(spark, own), frame, 7, 5, 0.0))
    for i, x, y, w, h in boxes:
        assert np.abs(got[i] - images.align_region(own[i], x, y, w, h, 7, 5, 0.0)).max() <= 1


@pytest.mark.parametrize("tile,limit", [(4, 48.0), (8, 2.0), (5, 1000.0), (3, 0.0)])
def test_clahe_equals_the_array_kernel(spark, tile, limit):
    own = pictures() | {20: np.random.default_rng(5).integers(0, 3, (40, 33))}
    got = arrays(raster.clahe(table(spark, own), tile, limit))
    assert all((got[i] == images.clahe(g, tile, limit)).all() for i, g in own.items())


def plain_clahe(g, tile, limit):
    """By loops over tiles, values and pixels."""
    h, w = g.shape
    ny, nx = -(-h // tile), -(-w // tile)
    luts = {}
    for j in range(ny):
        for i in range(nx):
            part = [int(g[y, x]) for y in range(j * tile, min(j * tile + tile, h)) for x in range(i * tile, min(i * tile + tile, w))]
            hist = [part.count(v) for v in range(256)]
            top = int(limit * len(part) / 256)
            over = sum(max(n - top, 0) for n in hist) // 256
            total, cdf = 0, []
            for n in hist:
                total += min(n, top) + over
                cdf.append(total)
            low = next((v for v in cdf if v > 0), 0)
            luts[j, i] = [int(np.floor((v - low) / (len(part) - low) * 255 + 0.5)) if len(part) > low else k for k, v in enumerate(cdf)]
    out = np.zeros_like(g)
    for y in range(h):
        for x in range(w):
            ty, tx, v = y / tile - 0.5, x / tile - 0.5, int(g[y, x])
            y0, x0 = max(0, int(np.floor(ty))), max(0, int(np.floor(tx)))
            y1, x1 = min(ny - 1, y0 + 1), min(nx - 1, x0 + 1)
            a = luts[y0, x0][v] * (1 - (tx - x0)) + luts[y0, x1][v] * (tx - x0)
            b = luts[y1, x0][v] * (1 - (tx - x0)) + luts[y1, x1][v] * (tx - x0)
            out[y, x] = min(255, max(0, int(np.floor(a * (1 - (ty - y0)) + b * (ty - y0) + 0.5))))
    return out


def test_clahe_kernel_equals_plain_loops():
    for g in pictures().values():
        for tile, limit in ((4, 48.0), (6, 3.0)):
            assert (images.clahe(g, tile, limit) == plain_clahe(g, tile, limit)).all()


def test_cascade_windows_equal_the_array_kernel(spark):
    c = haar.Cascade(4, 4, [(-0.5, [(0, 0.1, -0.75, 0.75)])] * 3 + [(0.0, [(1, -0.06, -0.5, 0.5), (2, 0.2, 0.25, -0.25)])] * 3, [[(0, 0, 4, 4, -1.0), (0, 0, 2, 4, 2.0)], [(0, 0, 4, 4, -1.0), (0, 1, 4, 2, 2.0)], [(0, 0, 2, 2, 1.0), (2, 2, 2, 2, 1.0)]])
    own = pictures(7) | {9: np.kron(np.random.default_rng(3).integers(0, 256, (6, 6)), np.ones((5, 5), int))}
    got = haar.windows(table(spark, own), c, 4, 1.3).collect()
    want = [(i, d["x"], d["y"], d["w"], d["h"]) for i, g in own.items() for d in haar.scan(g, c, 4, 1.3)]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 20
    assert haar.windows(table(spark, {1: np.zeros((3, 3), int)}), c, 4).count() == 0


def test_patterns_and_quality_equal_the_array_kernels(spark):
    own = pictures()
    got = {}
    for r in raster.patterns(table(spark, own)).collect():
        got.setdefault(r.image_id, {})[r.y, r.x] = r.code
    for i, g in own.items():
        want = {k: int(v) for k, v in np.ndenumerate(images.lbp(g)) if 0 < k[0] < g.shape[0] - 1 and 0 < k[1] < g.shape[1] - 1}
        assert got.get(i, {}) == want
    for r in raster.quality(table(spark, own)).collect():
        want = images.quality(own[r.image_id])
        assert all(abs(r[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("adaptive", [True, False])
def test_skin_equals_the_array_kernel(spark, adaptive):
    r = np.random.default_rng(6)
    skin = lambda h, w, spread, dark: np.clip(np.array([190, 140, 115]) * dark + r.normal(0, spread, (h, w, 3)), 0, 255).astype(int)
    own = {1: skin(20, 15, 30, 1.0), 2: skin(12, 12, 20, 0.4), 3: np.full((6, 6, 3), 90), 4: r.integers(0, 256, (10, 10, 3)), 5: skin(130, 110, 40, 0.9)}
    rows = [(i, y, x, *map(int, g[y, x])) for i, g in own.items() for y in range(g.shape[0]) for x in range(g.shape[1])]
    frame = spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int")
    got = {(p.image_id, p.y, p.x): p.skin for p in raster.skin(frame, adaptive).collect()}
    want = {(i, y, x): bool(m[y, x]) for i, g in own.items() for m in [images.skin_mask(g, adaptive=adaptive)] for y in range(g.shape[0]) for x in range(g.shape[1])}
    assert got == want and 0 < sum(want.values()) < len(want)


@pytest.mark.parametrize("k", [1, 3, 5])
def test_morphology_equals_the_array_kernels(spark, k):
    own = {i: g > 110 for i, g in pictures().items()}
    mask = table(spark, own).selectExpr("image_id", "y", "x", "v = 1 AS m")
    for ours, kernel in ((raster.eroded, images.erode), (raster.dilated, images.dilate)):
        got = arrays(ours(mask, k).selectExpr("image_id", "y", "x", "m AS v"))
        assert all((got[i] == kernel(g, k)).all() for i, g in own.items())


def test_skin_regions_equal_the_array_kernel(spark):
    own = {}
    for i, boxes in enumerate([[(20, 30, 50, 60)], [], [(5, 5, 40, 45), (70, 60, 45, 40), (0, 118, 119, 2)], [(10, 10, 60, 20)]]):
        own[i] = np.zeros((120, 120, 3), int)
        for x, y, w, h in boxes:
            own[i][y : y + h, x : x + w] = (200, 140, 110)
    rows = [(i, y, x, *map(int, g[y, x])) for i, g in own.items() for y in range(120) for x in range(120)]
    got = raster.skin_regions(spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int"), 30).collect()
    want = [(i, b["x"], b["y"], b["w"], b["h"], round(b["confidence"], 9)) for i, g in own.items() for b in images.skin_regions(g, 30)]
    assert sorted((r.image_id, r.x, r.y, r.w, r.h, round(r.confidence, 9)) for r in got) == sorted(want) and len(want) == 3


@pytest.mark.parametrize("least", [0.05, 0.3, 0.5, 1.0])
def test_boxes_that_meet_on_a_grid(spark, least):
    r = np.random.default_rng(7)
    rows = [(int(i), k, int(r.integers(-40, 60)), int(r.integers(-40, 60)), int(r.integers(1, 2 ** r.integers(1, 7))), int(r.integers(1, 2 ** r.integers(1, 7))), 1.0) for i in range(4) for k in range(60)]
    rows += [(1, 100 + k, 5, 5, 8, 8, 0.5) for k in range(5)] + [(2, 200, 0, 0, 16, 16, 1.0), (2, 201, 0, 0, 16, 8, 1.0)]
    df = spark.createDataFrame(rows, boxes.SCHEMA)
    pairs = lambda f: {(p.image_id, p.a, p.b): round(p.iou, 9) for p in f(df, least).collect()}
    got = boxes.near_pairs(df, least)
    assert pairs(boxes.near_pairs) == pairs(boxes.overlapping_pairs) and got.count() == got.distinct().count() > 5
    for members in (1, 2):
        one, two = (sorted(map(tuple, boxes.merged_detections(df, least, members, spread).select(boxes.merged_detections(df).columns).collect())) for spread in (False, True))
        assert one == two
    with pytest.raises(ValueError):
        boxes.near_pairs(df, 0.0)


def test_curve_equals_splitting_anew(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(2**40 + i, f"p{i % 7}", r.normal(size=5).tolist()) for i in range(90)]
    rows += [(5, "p0", rows[3][2]), (6, "a", rows[3][2])]  # a tie, which goes to the first name
    df = spark.createDataFrame(rows, "id long, identity string, v array<double>")
    monkeypatch.setattr(curves, "SHARD", 11)
    monkeypatch.setattr(curves, "BLOCK", 9)
    ratios = [0.9, 0.05, 0.5, 0.31]
    got = {r.ratio: r for r in api.learning_curve(df, ratios, "manhattan").collect()}
    assert sorted(got) == sorted(ratios)
    for ratio, row in got.items():
        want = api.evaluate(df, "manhattan", ratio)["macro"].collect()[0]
        assert all(abs(row[k] - want[k]) < 1e-12 for k in ("accuracy", "precision", "recall", "f1")) and row.tested == 92 - int(92 * ratio)
    assert {r.ratio for r in api.learning_curve(df, [0.001, 0.5]).collect()} == {0.5}


def _joins(df):
    """Names of the joins that Spark plans, before it has seen any sizes."""
    return set(__import__("re").findall(r"\w+Join", df._jdf.queryExecution().sparkPlan().toString()))


def test_exploded_rows_are_never_broadcast(spark):
    g = table(spark, {k: v for k, v in pictures().items() if min(v.shape) >= 4})
    cascade = haar.Cascade(4, 4, [(-0.5, [(0, 0.125, -0.75, 0.75)])], [[(0, 0, 4, 4, -1.0), (0, 0, 2, 4, 2.0)]])
    found = haar.windows(g, cascade, 4, 1.25)
    assert _joins(found) == {"SortMergeJoin"} and _joins(raster.clahe(g, 4, 48.0)) == {"SortMergeJoin"} and _joins(raster.resized(g, 6, 5)) == {"SortMergeJoin"}
    boxed = found.select("image_id", raster.F.monotonically_increasing_id().alias("box_id"), "x", "y", "w", "h")
    assert _joins(boxes.near_pairs(boxed)) == {"SortMergeJoin"}


@pytest.mark.parametrize("rows", [40, 1 << 18])
def test_dealing_follows_the_rows_and_changes_nothing(spark, monkeypatch, rows):
    monkeypatch.setattr(raster, "ROWS", rows)
    own = pictures()
    side = raster.sizes(table(spark, own))
    n = sum(g.size for g in own.values())
    assert raster.dealing(side) == (-(-n // rows), rows > 400)
    got = arrays(raster.clahe(table(spark, own), 4, 48.0))
    assert all((got[i] == images.clahe(g, 4, 48.0)).all() for i, g in own.items())
    small = arrays(raster.resized(table(spark, own), 17, 13))
    assert (small[1] == own[1]).all()


def test_resize_needs_every_source(spark):
    rows = [(1, y, x, 10 * y + x) for y in range(3) for x in range(3) if (y, x) != (1, 1)] + [(1, 0, 0, 0)]
    got = {(r.y, r.x): r.v for r in raster.resized(spark.createDataFrame(rows, "image_id long, y int, x int, v int"), 3, 3).collect()}
    assert got[0, 0] == 0 and got[2, 2] == 22 and got.get((1, 1)) is None
