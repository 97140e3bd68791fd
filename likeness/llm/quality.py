"""Operator 2: document quality by a byte-level convolutional network, in numpy.

A text's bytes are embedded, and learned filters of six bytes slide over all
of them. Their largest responses within overlapping chunks of 256 bytes (a new
chunk every 128) go through a small dense layer; the largest value of each of
its units over all chunks of the document is combined into one probability.

For scoring, embedding and filters are folded into three tables of byte pairs,
so a position costs three look-ups however wide the embedding is. Training is
by Adam on a bounded sample; its gradient runs through the maxima only.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from likeness.llm.arrow import map_docs

WIDTH, HALF = 6, 128
#: Bytes that one array step of scoring holds.
STEP = 1 << 17


def blocks(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each zero-padded to half chunks with at least a filter's width of zeros; number of half chunks of each."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    n = np.array([max(2, -(-(len(b) + WIDTH) // HALF)) for b in raw], np.int64)
    return np.frombuffer(b"".join(b.ljust(k * HALF, b"\0") for b, k in zip(raw, n.tolist())), np.uint8), n


class Net:
    """embed (256, d), filters (6 * d, f), bias (f); dense (f, g), its bias; out (g), its bias."""

    def __init__(self, embed, filters, fbias, dense, dbias, out, obias) -> None:
        self.embed, self.filters, self.fbias, self.dense, self.dbias, self.out, self.obias = embed, filters, fbias, dense, dbias, out, obias
        d = embed.shape[1]
        one = np.stack([embed @ filters[k * d : (k + 1) * d] for k in range(WIDTH)])
        self.one = one.astype(np.float32)
        self.one[0] += fbias.astype(np.float32)

    @cached_property
    def pairs(self) -> list[np.ndarray]:
        """Responses by pairs of bytes, for each third of a filter."""
        return [(self.one[k][:, None, :] + self.one[k + 1][None, :, :]).reshape(65536, -1) for k in (0, 2, 4)]

    def __reduce__(self):  # the tables are made anew where the model arrives
        return Net, (self.embed, self.filters, self.fbias, self.dense, self.dbias, self.out, self.obias)

    def half_maxima(self, data: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each half chunk of the bytes. For few bytes the tables of pairs are not worth making."""
        out = np.empty((len(data) // HALF, self.one.shape[2]), np.float32)
        if "pairs" not in self.__dict__ and len(data) <= 4 * STEP:
            for lo in range(0, len(data), STEP // 4):
                part = np.append(data[lo : lo + STEP // 4 + WIDTH], np.zeros(WIDTH, np.uint8))
                n = min(STEP // 4, len(data) - lo)
                r = self.one[0].take(part[:n], 0)
                for k in range(1, WIDTH):
                    r += self.one[k].take(part[k : n + k], 0)
                out[lo // HALF : (lo + n) // HALF] = r.reshape(-1, HALF, r.shape[1]).max(1)
            return out
        padded = np.append(data, np.zeros(WIDTH, np.uint8)).astype(np.int32)
        pair = padded[:-1] << 8 | padded[1:]
        for lo in range(0, len(data), STEP):
            hi = min(lo + STEP, len(data))
            r = self.pairs[0].take(pair[lo:hi], 0)
            r += self.pairs[1].take(pair[lo + 2 : hi + 2], 0)
            r += self.pairs[2].take(pair[lo + 4 : hi + 4], 0)
            out[lo // HALF : hi // HALF] = r.reshape(-1, HALF, r.shape[1]).max(1)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts))
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) < 8 * STEP):
                size += len(texts[hi])
                hi += 1
            data, n = blocks(texts[lo:hi])
            half = self.half_maxima(data)
            out[lo:hi] = self.head(half, n)[0]
            lo = hi
        return out

    def head(self, half: np.ndarray, n: np.ndarray):
        """Probabilities from the half chunks' maxima; also what the gradient needs."""
        ends = np.cumsum(n)
        first = np.maximum(half[:-1], half[1:])
        inside = np.ones(len(half), bool)
        inside[ends - 1] = False  # a chunk is two halves of one document
        at = np.flatnonzero(inside)
        chunk = np.maximum(first[at], 0)
        pre = chunk @ self.dense + self.dbias
        act = np.maximum(pre, 0.01 * pre)
        cuts = np.append(0, np.cumsum(n - 1)[:-1])
        top = np.maximum.reduceat(act, cuts, axis=0)
        z = top @ self.out + self.obias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return p, (at, chunk, pre, act, cuts, top)


def fit(texts: list[str], label, prior: float | None = None, filters: int = 16, hidden: int = 16, embed: int = 8, epochs: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 5) -> Net:
    """Train on labelled texts, both classes with the same weight; ``prior`` is the share of label 1 to which the scores are then shifted.

    With one class only every score is that class's share (0.5 without any text).
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(label, float)
    p = {
        "embed": rng.normal(0, 0.5, (256, embed)),
        "filters": rng.normal(0, 1 / np.sqrt(WIDTH * embed), (WIDTH * embed, filters)),
        "fbias": np.zeros(filters),
        "dense": rng.normal(0, 1 / np.sqrt(filters), (filters, hidden)),
        "dbias": np.zeros(hidden),
        "out": rng.normal(0, 1 / np.sqrt(hidden), hidden),
        "obias": np.zeros(1),
    }
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        p["out"][:] = 0
        p["obias"][:] = np.log(max(share, 1e-3) / max(1 - share, 1e-3))
        return Net(**p)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    step = 0
    total = epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            data, n = blocks([texts[i] for i in pick])
            g = gradient(p, data, n, y[pick], weight[pick])
            step += 1
            lr = rate * min(1.0, 1.5 * (1 - step / (total + 1)))
            for k, x in p.items():
                d = g[k] + 1e-4 * x
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                x -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    if prior is not None and 0 < prior < 1:
        p["obias"] += np.log(prior / (1 - prior))
    return Net(**p)


def gradient(p: dict, data: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """Of the weighted log loss, mean over documents."""
    net = Net(**p)
    half = net.half_maxima(data)
    prob, (at, chunk, pre, act, cuts, top) = net.head(half, n)
    g = {}
    dz = (prob - y) * weight / len(y)
    g["obias"] = np.array([dz.sum()])
    g["out"] = top.T @ dz
    dtop = dz[:, None] * p["out"][None, :]
    docs = np.repeat(np.arange(len(n)), n - 1)
    is_top = act == top[docs]
    dact = np.where(is_top, dtop[docs], 0)
    dpre = dact * np.where(pre > 0, 1, 0.01)
    g["dense"], g["dbias"] = chunk.T @ dpre, dpre.sum(0)
    dchunk = (dpre @ p["dense"].T) * (chunk > 0)
    live = np.flatnonzero(np.abs(dchunk).max(1) > 0)
    # where in the chunk each filter is largest
    d = p["embed"].shape[1]
    g["filters"], g["embed"], g["fbias"] = np.zeros_like(p["filters"]), np.zeros_like(p["embed"]), dchunk.sum(0)
    padded = np.append(data, np.zeros(WIDTH, np.uint8))
    from_second = half[at[live] + 1] > half[at[live]]
    block = at[live][:, None] + from_second
    used, back = np.unique(block, return_inverse=True)
    back = back.reshape(block.shape)
    pos = np.empty((len(used), half.shape[1]), np.int64)
    for lo in range(0, len(used), 512):
        u = used[lo : lo + 512]
        i = (u[:, None] * HALF + np.arange(HALF)[None, :]).ravel()
        r = net.one[0].take(padded[i], 0)
        for k in range(1, WIDTH):
            r += net.one[k].take(padded[i + k], 0)
        pos[lo : lo + 512] = r.reshape(len(u), HALF, -1).argmax(1) + u[:, None] * HALF
    where = pos[back, np.arange(half.shape[1])[None, :]]
    grad = dchunk[live]
    for f in range(half.shape[1]):
        w = grad[:, f]
        hit = np.flatnonzero(w)
        if not len(hit):
            continue
        bytes_ = padded[where[hit, f][:, None] + np.arange(WIDTH)[None, :]]
        emb = p["embed"][bytes_].reshape(len(hit), -1)
        g["filters"][:, f] = emb.T @ w[hit]
        de = w[hit][:, None] * p["filters"][:, f][None, :]
        for c, x in enumerate(de.reshape(-1, d).T):
            g["embed"][:, c] += np.bincount(bytes_.ravel(), x, 256)
    return g


def score(docs: DataFrame, model: Net, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """id, score (0 to 1) of every text; all its bytes count. A null text is empty; an empty one is scored as zeros alone.

    Repeated rows are scored each; an empty table gives no rows; other columns are dropped, or kept as ``_row``.
    """

    def start():
        return lambda texts: {"score": pa.array(model.scores(texts))}

    return map_docs(docs, start, "score double", id_col, text_col, keep_row)
