"""Image kernels in numpy, on one grayscale or RGB raster each, and their Arrow wrapper.

Rasters are arrays (h, w) or (h, w, 3) with values 0..255. Bilinear sampling
uses pixel centres; results equal other implementations within a tolerance.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from likeness.runtime import ship

LEAST_SIDE, LARGEST_SIDE = 20, 4096


def gray(rgb: np.ndarray) -> np.ndarray:
    """Mean of the channels, integer division."""
    return rgb if rgb.ndim == 2 else rgb.astype(np.int64).sum(2) // 3


def luma(rgb: np.ndarray) -> np.ndarray:
    x = rgb.astype(np.int64)
    return rgb if rgb.ndim == 2 else (x[..., 0] * 299 + x[..., 1] * 587 + x[..., 2] * 114) // 1000


def sample(img: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear values at the points; coordinates are clamped to the image."""
    h, w = img.shape[:2]
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = x - x0, y - y0
    if img.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    return (img[y0, x0] * (1 - fx) + img[y0, x1] * fx) * (1 - fy) + (img[y1, x0] * (1 - fx) + img[y1, x1] * fx) * fy


def resize(img: np.ndarray, w: int, h: int) -> np.ndarray:
    ih, iw = img.shape[:2]
    x, y = np.meshgrid((np.arange(w) + 0.5) * iw / w - 0.5, (np.arange(h) + 0.5) * ih / h - 0.5)
    return np.floor(sample(img.astype(float), x, y) + 0.5).astype(np.int64)


def crop(img: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    """Clamped to the image; an empty crop gives the whole."""
    x0, y0, x1, y1 = max(x, 0), max(y, 0), min(x + w, img.shape[1]), min(y + h, img.shape[0])
    return img[y0:y1, x0:x1] if x1 > x0 and y1 > y0 else img


def quality(rgb: np.ndarray) -> dict[str, float]:
    """brightness, contrast, sharpness and the weighted score (weights are fixed values)."""
    x = (rgb if rgb.ndim == 3 else np.repeat(rgb[..., None], 3, 2)).astype(float)
    v = x.sum(2) / 765
    b, c, s = v.mean(), v.std(), sharpness(gray(x.astype(np.int64)))
    side = min(min(rgb.shape[:2]) / 160, 1)
    score = 0.2 * (1 - 2 * abs(b - 0.5)) + 0.3 * min(4 * c, 1) + 0.3 * min(10 * s, 1) + 0.2 * side
    return {"brightness": b, "contrast": c, "sharpness": s, "score": score}


def sharpness(g: np.ndarray) -> float:
    """Root mean square of the Laplacian over the inside, by 255."""
    g = g.astype(float)
    if min(g.shape) < 3:
        return 0.0
    lap = 4 * g[1:-1, 1:-1] - g[:-2, 1:-1] - g[2:, 1:-1] - g[1:-1, 2:] - g[1:-1, :-2]
    return float(np.sqrt((lap**2).mean()) / 255)


def lbp(g: np.ndarray, radius: int = 1, points: int = 8) -> np.ndarray:
    """Codes: bit i is set where the neighbour at angle 2 pi i / points is not darker; the border of ``radius`` is 0."""
    h, w = g.shape
    out = np.zeros((h, w), np.int64)
    if h <= 2 * radius or w <= 2 * radius:
        return out
    ys, xs = np.mgrid[radius : h - radius, radius : w - radius]
    for i in range(points):
        a = 2 * np.pi * i / points
        near = np.floor(sample(g.astype(float), xs + radius * np.cos(a), ys - radius * np.sin(a)) + 0.5)
        out[radius : h - radius, radius : w - radius] |= (near >= g[ys, xs]).astype(np.int64) << i
    return out


def lbp_histogram(g: np.ndarray, grid: int = 8, radius: int = 1) -> np.ndarray:
    """Histograms of 256 codes for each of grid x grid regions, each summing to 1; the last regions take what is left over."""
    codes = lbp(g, radius)
    h, w = codes.shape
    rh, rw = max(h // grid, 1), max(w // grid, 1)
    ys, xs = np.mgrid[radius : h - radius, radius : w - radius]
    where = np.minimum(ys // rh, grid - 1) * grid + np.minimum(xs // rw, grid - 1)
    counts = np.bincount((where * 256 + codes[ys, xs]).ravel(), minlength=grid * grid * 256).reshape(-1, 256).astype(float)
    total = counts.sum(1, keepdims=True)
    return (counts / np.where(total == 0, 1, total)).ravel()


def equalize(g: np.ndarray) -> np.ndarray:
    """By the cumulative histogram; an image of one value becomes black."""
    hist = np.bincount(g.ravel().astype(int), minlength=256)
    cdf = hist.cumsum()
    low = cdf[np.flatnonzero(hist)[0]]
    if g.size == low:
        return np.zeros_like(g)
    lut = np.floor((cdf - low).astype(np.float32) / np.float32(g.size - low) * np.float32(255) + np.float32(0.5))
    return np.clip(lut, 0, 255).astype(np.int64)[g.astype(int)]


def clahe(g: np.ndarray, tile: int, limit: float) -> np.ndarray:
    """Equalised by tiles whose histograms are clipped, tables blended bilinearly; left and above the first tiles' centres the blend goes on outwards."""
    h, w = g.shape
    ny, nx = max(-(-h // tile), 1), max(-(-w // tile), 1)
    luts = np.zeros((ny, nx, 256))
    for j in range(ny):
        for i in range(nx):
            t = g[j * tile : (j + 1) * tile, i * tile : (i + 1) * tile]
            hist = np.bincount(t.ravel().astype(int), minlength=256)
            top = int(limit * t.size / 256)
            cdf = (np.minimum(hist, top) + int(np.maximum(hist - top, 0).sum()) // 256).cumsum()
            low = cdf[cdf > 0].min(initial=cdf[-1])
            luts[j, i] = np.floor((cdf - low) / (t.size - low) * 255 + 0.5) if t.size > low else np.arange(256)
    y, x = np.mgrid[0:h, 0:w]
    y0, x0 = np.maximum(np.floor(y / tile - 0.5), 0).astype(int), np.maximum(np.floor(x / tile - 0.5), 0).astype(int)
    y1, x1 = np.minimum(y0 + 1, ny - 1), np.minimum(x0 + 1, nx - 1)
    ay, ax, v = y / tile - 0.5 - y0, x / tile - 0.5 - x0, g.astype(int)
    out = (luts[y0, x0, v] * (1 - ax) + luts[y0, x1, v] * ax) * (1 - ay) + (luts[y1, x0, v] * (1 - ax) + luts[y1, x1, v] * ax) * ay
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.int64)


def align(img: np.ndarray, left: tuple[float, float], right: tuple[float, float], w: int, h: int, eye_distance: float = 0.35, eye_height: float = 0.35) -> np.ndarray:
    """Turned and scaled so that the eyes lie level, centred at half the width and ``eye_height`` of the height; outside is black."""
    dx, dy = right[0] - left[0], right[1] - left[1]
    scale = eye_distance * w / max(np.hypot(dx, dy), 1e-9)
    a = np.arctan2(dy, dx)
    x, y = np.meshgrid(np.arange(w) - w / 2, np.arange(h) - eye_height * h)
    sx = (x * np.cos(a) - y * np.sin(a)) / scale + (left[0] + right[0]) / 2
    sy = (x * np.sin(a) + y * np.cos(a)) / scale + (left[1] + right[1]) / 2
    g = gray(img)
    inside = (sx >= 0) & (sy >= 0) & (sx <= g.shape[1] - 1) & (sy <= g.shape[0] - 1)
    return np.where(inside, np.floor(sample(g.astype(float), sx, sy) + 0.5), 0).astype(np.int64)


def align_region(img: np.ndarray, x: int, y: int, w: int, h: int, to_w: int, to_h: int, margin: float = 0.1) -> np.ndarray:
    """The box with a margin on each side, clamped, scaled and grey."""
    mx, my = int(w * margin), int(h * margin)
    return resize(gray(crop(img, x - mx, y - my, w + 2 * mx, h + 2 * my)), to_w, to_h)


def integral(g: np.ndarray) -> np.ndarray:
    """Two-dimensional prefix sums with a row and column of zeros before."""
    out = np.zeros((g.shape[0] + 1, g.shape[1] + 1), np.int64)
    out[1:, 1:] = g.astype(np.int64).cumsum(0).cumsum(1)
    return out


def box_sum(ii: np.ndarray, x, y, w, h):
    return ii[y + h, x + w] - ii[y, x + w] - ii[y + h, x] + ii[y, x]


def erode(mask: np.ndarray, k: int) -> np.ndarray:
    """True where the whole k x k window is; the border of k // 2 is false."""
    r, (h, w) = k // 2, mask.shape
    out = np.zeros_like(mask)
    if h > 2 * r and w > 2 * r:
        ii = integral(mask)
        y, x = np.mgrid[r : h - r, r : w - r]
        n = 2 * r + 1
        out[r : h - r, r : w - r] = box_sum(ii, x - r, y - r, n, n) == n * n
    return out


def dilate(mask: np.ndarray, k: int) -> np.ndarray:
    """True where any of the k x k window is; the window is clipped at the borders."""
    r, (h, w) = k // 2, mask.shape
    ii = integral(mask)
    y, x = np.mgrid[0:h, 0:w]
    y0, x0, y1, x1 = np.maximum(y - r, 0), np.maximum(x - r, 0), np.minimum(y + r + 1, h), np.minimum(x + r + 1, w)
    return ii[y1, x1] - ii[y0, x1] - ii[y1, x0] + ii[y0, x0] > 0


def components(mask: np.ndarray, least: int = 100) -> list[dict]:
    """Four-connected parts of at least ``least`` pixels, in row-major order of their first pixel."""
    h, w = mask.shape
    lab = np.where(mask, np.arange(h * w).reshape(h, w), h * w)
    while True:  # least label of the neighbours, then of the label's own label
        new = lab.copy()
        for a, b in ((np.s_[1:, :], np.s_[:-1, :]), (np.s_[:-1, :], np.s_[1:, :]), (np.s_[:, 1:], np.s_[:, :-1]), (np.s_[:, :-1], np.s_[:, 1:])):
            new[a] = np.where(mask[a], np.minimum(new[a], lab[b]), new[a])
        jump = np.append(new.ravel(), h * w)[new]
        new = np.where(mask, np.minimum(new, jump), h * w)
        if (new == lab).all():
            break
        lab = new
    out = []
    for k in np.unique(lab[mask]):
        y, x = np.nonzero(lab == k)
        if len(y) >= least:
            out.append({"x": int(x.min()), "y": int(y.min()), "w": int(x.max() - x.min() + 1), "h": int(y.max() - y.min() + 1), "count": len(y), "cx": int(x.sum() // len(y)), "cy": int(y.sum() // len(y))})
    return out


def hsv(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r, g, b = (rgb[..., i].astype(float) / 255 for i in range(3))
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    d = top - low
    safe = np.where(d == 0, 1, d)
    hue = np.where(top == r, (g - b) / safe + np.where(g < b, 6, 0), np.where(top == g, (b - r) / safe + 2, (r - g) / safe + 4)) / 6
    return np.where(d == 0, 0, hue), np.where(top == 0, 0, d / np.where(top == 0, 1, top)), top


def skin_mask(rgb: np.ndarray, low: tuple = (0.0, 0.1, 0.2), high: tuple = (0.14, 0.7, 0.95), adaptive: bool = True) -> np.ndarray:
    """Skin by hue, saturation and value and by chroma; dark or pale images widen the ranges."""
    h, s, v = hsv(rgb)
    lo, hi = list(low), list(high)
    if adaptive:  # both ends of a range move by its margin
        step = max(h.size // min(10_000, h.size), 1)
        margins = (0.02, 0.1 if s.ravel()[::step].mean() < 0.3 else 0.0, 0.1 if v.ravel()[::step].mean() < 0.4 else 0.0)
        lo = [max(0.0, x - m) for x, m in zip(lo, margins)]
        hi = [min(1.0, x + m) for x, m in zip(hi, margins)]
    x = rgb.astype(float)
    cb = (128 - 0.169 * x[..., 0] - 0.331 * x[..., 1] + 0.5 * x[..., 2]).astype(int)
    cr = (128 + 0.5 * x[..., 0] - 0.419 * x[..., 1] - 0.081 * x[..., 2]).astype(int)
    by_hue = (((h >= lo[0]) & (h <= hi[0])) | ((h > 0.9) & (h <= 1))) & (s >= lo[1]) & (s <= hi[1]) & (v >= lo[2]) & (v <= hi[2])
    return by_hue & (cb >= 77) & (cb <= 127) & (cr >= 133) & (cr <= 173)


def skin_regions(rgb: np.ndarray, least_side: int = 30, largest_side: int | None = None, min_confidence: float = 0.3) -> list[dict]:
    """Boxes of skin, most confident first: mask, opening and closing, parts, filters, greedy merge."""
    mask = dilate(erode(skin_mask(rgb), 3), 5)
    found = []
    for c in components(mask):
        fill, aspect = c["count"] / (c["w"] * c["h"]), c["w"] / c["h"]
        if min(c["w"], c["h"]) >= least_side and (largest_side is None or max(c["w"], c["h"]) <= largest_side) and 0.5 <= aspect <= 2 and fill >= 0.3:
            conf = region_confidence(c["w"], c["h"], fill, least_side)
            if conf >= min_confidence:
                found.append({"x": c["x"], "y": c["y"], "w": c["w"], "h": c["h"], "confidence": conf})
    return sorted(greedy_merge(found), key=lambda r: -r["confidence"])


def region_confidence(w: int, h: int, fill: float, least_side: int = 30) -> float:
    size = min(w, h)
    by_size = 0.7 if size < 2 * least_side else 1.0 if size < 5 * least_side else 0.8
    return min(1.0, min(fill / 0.6, 1) * 0.4 + max(0.0, 1 - abs(w / h - 0.85)) * 0.3 + by_size * 0.3)


def box_iou(a: dict, b: dict) -> float:
    w = min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"])
    h = min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"])
    both = w * h if w > 0 and h > 0 else 0
    return both / (a["w"] * a["h"] + b["w"] * b["h"] - both)


def greedy_merge(boxes: list[dict], over: float = 0.3) -> list[dict]:
    """In order, each box takes in the later ones that overlap it by more; it keeps its place, with 1.1 times the best confidence."""
    if len(boxes) < 2:
        return list(boxes)
    used, out = [False] * len(boxes), []
    for i, a in enumerate(boxes):
        if used[i]:
            continue
        best = a["confidence"]
        for j in range(i + 1, len(boxes)):
            if not used[j] and box_iou(a, boxes[j]) > over:
                used[j] = True
                best = max(best, boxes[j]["confidence"])
        out.append(a | {"confidence": min(1.0, 1.1 * best)})
    return out


def read_pgm(data: bytes) -> np.ndarray:
    """P5 or P2. 8-bit raw values stay; 16-bit ones are scaled to 255; text values stay and missing ones are 0."""
    magic = data[:2]
    if magic not in (b"P5", b"P2"):
        raise ValueError("not a PGM file")
    head, i = [], 2
    while len(head) < 3:
        while i < len(data) and data[i : i + 1].isspace():
            i += 1
        if i >= len(data):
            raise ValueError("the PGM header ends early")
        if data[i : i + 1] == b"#":
            i = data.index(b"\n", i) + 1
            continue
        j = i
        while j < len(data) and not data[j : j + 1].isspace():
            j += 1
        head.append(int(data[i:j]))
        i = j
    w, h, top = head
    if magic == b"P2":
        got = np.array(data[i:].split()[: w * h], np.int64)
        return np.append(got, np.zeros(w * h - len(got), np.int64)).reshape(h, w)
    body = data[i + 1 :]
    if top <= 255:
        return np.frombuffer(body[: w * h], np.uint8).astype(np.int64).reshape(h, w)
    return np.frombuffer(body[: 2 * w * h], ">u2").astype(np.int64).reshape(h, w) * 255 // top


def write_pgm(g: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (g.shape[1], g.shape[0]) + g.astype(np.uint8).tobytes()


def map_images(df: DataFrame, f: Callable[[np.ndarray], dict], schema: str, key: str = "image_id") -> DataFrame:
    """Apply ``f`` to every raster of (key, width, height, channels, data): key, the fields of ``schema``, error.

    A raster that fails stays in the result, with its message in ``error`` and nulls elsewhere.
    """
    ship(df.sparkSession)
    names = [c.strip().split(" ")[0] for c in _fields(schema)]
    kind = dict(df.dtypes)[key]
    src = df.select(key, "width", "height", "channels", "data")
    target = src.sparkSession.createDataFrame([], f"`{key}` {kind}, {schema}, error string").schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches):
        for b in batches:
            rows = []
            for i, r in enumerate(b.to_pylist()):
                row = {key: r[key], "error": None}
                try:
                    shape = (r["height"], r["width"]) + ((r["channels"],) if r["channels"] > 1 else ())
                    row |= f(np.frombuffer(r["data"], np.uint8).reshape(shape))
                except Exception as e:  # one bad image is a row of the result
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append({n: row.get(n) for n in (key, *names, "error")})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return src.mapInArrow(run, target)


def _fields(schema: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[at:i])
            at = i + 1
    return [*out, schema[at:]]


def pixels(df: DataFrame) -> DataFrame:
    """(image_id, y, x, v) of rows (image_id, width, v: array of values, row-major)."""
    return df.select("image_id", "width", F.posexplode("v").alias("p", "v")).select("image_id", F.floor(F.col("p") / F.col("width")).cast("int").alias("y"), (F.col("p") % F.col("width")).cast("int").alias("x"), "v")
