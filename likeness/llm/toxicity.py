"""Operator 10: toxicity by a support vector machine on a subsequence string kernel.

A text is a bag of units: its words, lower-cased and reduced to letters, with
runs of single letters joined ("i d i o t"), one or two digits or marks between
letters read as the letters that they look like ("m0r0n"); and, of a word with
marks or digits between its letters, the parts too ("you,bad"). Two strings are compared by the
gap-weighted subsequence kernel: all common subsequences of three letters
count, each discounted by the stretch it spans on either side, so inserted or
dropped letters lower the value but do not end it. It is normalised, and what
exceeds FLOOR is stretched to 0..1.

The value of a unit for a landmark of four letters or more is that of the
unit's best stretch of at most twice the landmark's letters: an insult is found
within a longer word, a spelled-out sentence, words joined by marks or unspaced
script, and every letter of a unit is read. A landmark of three letters is
compared with whole units only, as it stands inside too many plain words. The
value of a text is the largest of its units' values. That is a similarity, not
a kernel in the strict sense (a maximum is not positive definite), so the
Nystrom map uses the positive part of the landmarks' own matrix.

Landmarks are units, or beginnings of units, of the labelled sample that part
the labels. The Nystrom map, the values for the landmarks times the inverse
root of the landmarks' own matrix, feeds a linear support vector machine,
trained by dual coordinate descent, and a logistic curve turns its margin into
a probability.

No value above 0 is skipped: a unit is left out for a landmark only if the
letters that they share bound the kernel by FLOOR (the subsequences of those
letters hold too little of the landmark's own norm; Cauchy-Schwarz), a stretch
only if its kernel with the landmark is too small for the least norm that any
stretch of its length has.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from likeness.llm.arrow import map_docs
from likeness.llm.pretoken import LETTER, SEP, SPACE, code_points, powers, tables

ORDER, DECAY = 3, 0.7
#: Normalised kernel values up to it count as 0.
FLOOR = 0.5
#: Letters of a landmark; from STRETCH letters on it is sought inside units too.
SHORTEST, STRETCH, LONGEST = 3, 4, 16
#: Characters that one array step holds; windows that are compared at once.
STEP, BLOCK = 1 << 18, 1 << 14
#: Units known to have no value for any landmark that a task remembers, at most (8 bytes each).
KNOWN = 1 << 21
# Digits and marks that stand for letters.
LOOKS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: A longer text is cut here: between two units of at least two letters.
_SAFE = regex.compile(r"(?<=\p{L}\p{L})(?=\s\p{L}\p{L})")


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    """Lower case of each code point, where that is one code point."""
    low = np.arange(0x110001, dtype=np.uint32)
    for c in range(0x250):
        x = chr(c).lower()
        if len(x) == 1:
            low[c] = ord(x)
    for lo, hi in ((0x370, 0x530), (0x1E00, 0x2000)):
        for c in range(lo, hi):
            x = chr(c).lower()
            if len(x) == 1:
                low[c] = ord(x)
    return low


def spelled(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters of all texts, where the units of at least ORDER letters begin and end in them, and the text of each; parts of a unit overlap it."""
    cps, _ = code_points(texts)
    cls = tables()[0][cps]
    edge = lambda g: (np.flatnonzero((g == LETTER) & (np.append(SEP, g[:-1]) != LETTER)), np.flatnonzero((g == LETTER) & (np.append(g[1:], SEP) != LETTER)) + 1)
    ps, pe = edge(cls)  # parts: runs of letters
    looks = np.fromiter(map(ord, LOOKS), np.uint32)
    like = np.flatnonzero(np.isin(cps, looks))
    if len(like):
        around = np.pad(cls, 2, constant_values=SEP)  # around[i + 2] is cls[i]
        letter, look = around == LETTER, np.zeros(len(around), bool)
        look[like + 2] = True
        i = like + 2
        between = (letter[i - 1] & letter[i + 1]) | (letter[i - 1] & look[i + 1] & letter[np.minimum(i + 2, len(letter) - 1)]) | (letter[i - 2] & look[i - 1] & letter[i + 1])
        at = like[between]
        cps[at] = np.fromiter(map(ord, LOOKS.values()), np.uint32)[(cps[at][:, None] == looks).argmax(1)]
        cls = cls.copy()
        cls[at] = LETTER

    def dropped(keep: np.ndarray) -> None:
        nonlocal cps, cls, ps, pe
        new = np.cumsum(keep) - 1
        ps, pe = new[ps], new[pe - 1] + 1
        cps, cls = cps[keep], cls[keep]

    dropped((cls == LETTER) | (cls == SPACE) | (cls == SEP))
    s, e = edge(cls)
    if len(s):
        single = e - s == 1
        joins = single[1:] & single[:-1] & (np.add.reduceat(cls == SEP, s)[:-1] == 0)
        if joins.any():  # white space between single letters goes
            drop = np.zeros(len(cls) + 1, np.int32)
            np.add.at(drop, e[:-1][joins], 1)
            np.add.at(drop, s[1:][joins], -1)
            dropped(np.cumsum(drop)[:-1] == 0)
            s, e = edge(cls)
        long = pe - ps >= ORDER
        ps, pe = ps[long], pe[long]
        unit = np.searchsorted(s, ps, "right") - 1
        part = (ps != s[unit]) | (pe != e[unit])
        s, e = np.append(s, ps[part]), np.append(e, pe[part])
        order = np.lexsort((e, s))
        s, e = s[order], e[order]
    owner = np.searchsorted(np.flatnonzero(cls == SEP), s)
    ok = e - s >= ORDER
    return lower_table()[cps], s[ok], e[ok], owner[ok]


def prefix_hashes(low: np.ndarray):
    """f(starts, lengths): hashes of stretches of the letters, the same wherever they stand."""
    up, down = powers(len(low))
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(tables()[1][low] * up[: len(low)], out=total[1:])
    return lambda s, n: (total[s + n] - total[s]) * down[s] ^ (np.asarray(n, np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def chunks(texts: list[str], step: int = STEP):
    """(texts or pieces of long ones, the index of each one's text), of about ``step`` characters at a time."""
    part, owner, size = [], [], 0
    for i, t in enumerate(texts):
        lo = 0
        while lo < len(t):
            hi = len(t)
            if hi - lo > step:
                m = _SAFE.search(t, lo + step // 2)
                hi = m.start() if m else hi
            if part and size + hi - lo > step:
                yield part, np.array(owner)
                part, owner, size = [], [], 0
            part.append(t[lo:hi])
            owner.append(i)
            size += hi - lo
            lo = hi
    if part:
        yield part, np.array(owner)


def kernel(s: str, t: str, order: int = ORDER, decay: float = DECAY) -> float:
    """Gap-weighted subsequence kernel of two strings, not normalised."""
    a, b = (np.frombuffer(x.encode("utf-32-le"), np.uint32)[None] for x in (s, t))
    return float(prefix_kernels(a, b[0], order, decay)[0, -1]) if len(s) and len(t) else 0.0


def prefix_kernels(rows: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """(rows, letters): kernel of the first letters of each row (0: no letter) with the string ``t``."""
    m = len(t)
    ahead = np.arange(m)[None, :] - np.arange(m)[:, None] - 1  # how far the next letter may lie, and its discount
    ahead = np.where(ahead >= 0, decay ** np.maximum(ahead, 0.0), 0.0)
    before = [np.zeros((len(rows), m)) for _ in range(order - 1)]
    out = np.zeros(rows.shape)
    for i in range(rows.shape[1]):
        same = (rows[:, i, None] == t) * decay**2
        ends = [same, *(same * b for b in before)]  # subsequences of 1, 2, ... letters that end here
        out[:, i] = ends[-1].sum(1)
        before = [decay * b + k @ ahead for b, k in zip(before, ends)]
    return out.cumsum(1)


def own_kernels(rows: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """(rows, letters): kernel of the first letters of each row with themselves."""
    n, w = rows.shape
    same = ((rows[:, :, None] == rows[:, None, :]) & (rows > 0)[:, :, None]) * decay**2
    k, back = same, np.zeros((n, w, w))
    for _ in range(order - 1):
        before = np.zeros((n, w))
        for i in range(w):  # back[i, j]: discounted sum over earlier letters on both sides
            run = np.zeros(n)
            for j in range(w):
                back[:, i, j] = run
                run = decay * run + before[:, j]
            before = decay * before + k[:, i]
        k = same * back
    both = k.cumsum(1).cumsum(2)
    return both[:, np.arange(w), np.arange(w)]


def least_own(width: int, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """The least kernel of a string of 1, 2, ... letters with itself: that of different letters."""
    rows = np.arange(1, width + 1, dtype=np.uint32)[None]
    return own_kernels(rows, order, decay)[0]


class Landmark:
    """A string, its own kernel, and for each subset of its letters whether strings that share only those can exceed FLOOR."""

    def __init__(self, word: str) -> None:
        self.word = word
        self.letters = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        self.alphabet = sorted(set(word))
        self.own = kernel(word, word)
        m = len(word)
        weight: dict[str, float] = {}
        for at in combinations(range(m), ORDER):
            u = "".join(word[i] for i in at)
            weight[u] = weight.get(u, 0.0) + DECAY ** (at[-1] - at[0] + 1)
        norm = np.zeros(1 << len(self.alphabet))
        for u, x in weight.items():
            norm[sum(1 << self.alphabet.index(c) for c in set(u))] += x * x
        for b in range(len(self.alphabet)):  # sums over all subsets
            pairs = norm.reshape(-1, 2, 1 << b)
            pairs[:, 1] += pairs[:, 0]
        self.can = norm > self.own * FLOOR**2 * (1 - 1e-9)
        self.width = 2 * m if m >= STRETCH else 0


class Machine:
    """A fitted model: landmarks, the Nystrom map, the machine's weights and the logistic curve."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float, slope: float, shift: float) -> None:
        self.landmarks, self.weights, self.bias, self.slope, self.shift = landmarks, weights, bias, slope, shift
        self.marks = [Landmark(x) for x in landmarks]
        self.alphabet = np.unique(np.concatenate([x.letters for x in self.marks])) if landmarks else np.zeros(0, np.uint32)
        self.least = least_own(2 * LONGEST)
        self.none = np.zeros(0, np.uint64)

    def __reduce__(self):
        return Machine, (self.landmarks, self.weights, self.bias, self.slope, self.shift)

    def values(self, flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """(unit, landmark): values of the units flat[begin:end]; ``flat`` holds letters of units only, one after another."""
        out = np.zeros((len(begin), len(self.marks)))
        if not len(begin) or not self.marks:
            return out
        owner = np.repeat(np.arange(len(begin)), end - begin)
        place = np.minimum(np.searchsorted(self.alphabet, flat), len(self.alphabet) - 1)
        known = self.alphabet[place] == flat
        holds = np.zeros((len(begin), len(self.alphabet)), bool)
        holds[owner[known], place[known]] = True
        padded = np.append(flat, np.zeros(2 * LONGEST, np.uint32))
        for j, x in enumerate(self.marks):
            cols = np.searchsorted(self.alphabet, np.array([ord(c) for c in x.alphabet], np.uint32))
            live = x.can[holds[:, cols] @ (1 << np.arange(len(cols)))]
            if not live.any():
                continue
            if x.width:  # the best stretch begins with a letter of the landmark
                inside = np.zeros(len(self.alphabet), bool)
                inside[cols] = True
                at = np.flatnonzero(live[owner] & known & inside[place] & (end[owner] - np.arange(len(flat)) >= ORDER))
                width = x.width
            else:
                at = begin[live & (end - begin <= 2 * LONGEST)]
                width = int((end - begin)[live].clip(max=2 * LONGEST).max())
            for lo in range(0, len(at), BLOCK):
                p = at[lo : lo + BLOCK]
                reach = np.arange(width)
                rows = np.where(p[:, None] + reach < end[owner[p]][:, None], padded[p[:, None] + reach], 0).astype(np.uint32)
                cross = prefix_kernels(rows, x.letters)
                size = (rows > 0).sum(1)
                if not x.width:  # whole units only
                    cross[np.arange(width) < size[:, None] - 1] = 0
                hit = (cross**2 > FLOOR**2 * (1 - 1e-9) * x.own * self.least[:width]).any(1)
                if hit.any():
                    k = cross[hit] / np.sqrt(x.own * np.maximum(own_kernels(rows[hit]), 1e-30))
                    np.maximum.at(out[:, j], owner[p[hit]], (k.max(1) - FLOOR) / (1 - FLOOR))
        return np.clip(out, 0, 1)

    def text_values(self, texts: list[str]) -> np.ndarray:
        """Largest value of each text for each landmark."""
        out = np.zeros((len(texts), len(self.marks)))
        if not self.marks:
            return out
        for part, of in chunks(texts):
            low, s, e, owner = spelled(part)
            if not len(s):
                continue
            h = prefix_hashes(low)(s, e - s)
            uniq, first, where = np.unique(h, return_index=True, return_inverse=True)
            at = np.minimum(np.searchsorted(self.none, uniq), max(len(self.none) - 1, 0))
            new = np.flatnonzero(self.none[at] != uniq if len(self.none) else np.ones(len(uniq), bool))
            size = (e - s)[first[new]]
            end = np.cumsum(size)
            begin = end - size
            flat = low[np.repeat(s[first[new]] - begin, size) + np.arange(int(size.sum()))]
            got = self.values(flat, begin, end)
            hot = got.any(1)
            rest = uniq[new[~hot]]
            self.none = np.sort(rest if len(self.none) + len(rest) > KNOWN else np.append(self.none, rest))
            turn = np.full(len(uniq), -1)
            turn[new[hot]] = np.flatnonzero(hot)
            here = np.flatnonzero(turn[where] >= 0)
            np.maximum.at(out, of[owner[here]], got[turn[where[here]]])
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        m = self.text_values(texts) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * m + self.shift, -30, 30)))


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs, in order."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
    return a[new], b[new]


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Values in order, and the sum of their counts over all parts."""
    value, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in parts)]), return_inverse=True)
    return value, np.bincount(at, np.concatenate([np.zeros(0), *(x for _, x in parts)]), len(value)).astype(np.int64)


def choose_landmarks(texts: list[str], label: np.ndarray, count: int, least: float = 20.0) -> list[str]:
    """Units, and beginnings of four letters or more, that part the labels best; of alike ones the better.

    By the gain of knowing whether a text has a unit that is, or begins so. A
    gain over all texts of label 1 below ``least``, and below a fortieth of
    their number, is taken for chance. Of
    texts in which it stands between the same two units only one counts, so
    copies are no evidence. Counted by chunks of texts, first in those of label
    1, then, of what enough of them hold, in all. Where that leaves nothing, as
    with a few texts, every text counts and any gain.
    """
    n1, n0 = int(label.sum()), int((1 - label).sum())
    least = max(least, n1 / 40)

    def gain_of(with1, with0):
        a, b = (with1 + 0.5) / (n1 + 1), (with0 + 0.5) / (n0 + 1)
        return np.where(a > b, n1 * (a * np.log(a / b) + (1 - a) * np.log((1 - a) / (1 - b))), -1.0)

    def parts_of(low, s, e, owner):
        """(hash, start, length, which unit) of the candidates of a chunk."""
        f = prefix_hashes(low)
        for n in range(SHORTEST, LONGEST + 1):
            ok = np.flatnonzero(e - s >= n if n >= STRETCH else e - s == n)
            if len(ok):
                yield f(s[ok], np.full(len(ok), n)), s[ok], n, ok

    def counted(of_label: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Candidates in order, and how many texts of a label have each; of those ``among``: between how many different pairs of units, if that is less."""
        texts_of: list[tuple[np.ndarray, np.ndarray]] = []
        places: list[tuple[np.ndarray, np.ndarray]] = []
        own = np.flatnonzero(label == of_label)
        for part, of in chunks([texts[i] for i in own.tolist()]):
            low, s, e, owner = spelled(part)
            between = np.zeros(len(s), np.uint64)
            if among is not None and len(s):
                unit = prefix_hashes(low)(s, e - s)
                first = np.append(True, owner[1:] != owner[:-1])
                between = np.where(first, np.uint64(0), np.roll(unit, 1)) * np.uint64(3) + np.where(np.roll(first, -1), np.uint64(0), np.roll(unit, -1)) * np.uint64(5)
            for h, _, _, who in parts_of(low, s, e, owner):
                if among is not None:
                    ok = np.isin(h, among)
                    h, who = h[ok], who[ok]
                    places.append(distinct_pairs(h, between[who]))
                texts_of.append(np.unique(distinct_pairs(h, of[owner[who]].astype(np.uint64))[0], return_counts=True))
                if sum(len(x) for x, _ in texts_of) > 1 << 20:
                    texts_of = [summed(texts_of)]
            if sum(len(x) for x, _ in places) > 1 << 20:
                places = [distinct_pairs(*map(np.concatenate, zip(*places)))]
        h, n = summed(texts_of)
        return (h, n) if among is None or not places else (h, np.minimum(n, np.unique(distinct_pairs(*map(np.concatenate, zip(*places)))[0], return_counts=True)[1]))

    held_names, held = counted(1)
    found = held_names
    ok = (held > 1) & (gain_of(held, 0) >= least)
    found, with1 = counted(1, found[ok]) if ok.any() else (found[held > 1], held[held > 1])
    with0 = np.zeros(len(found), np.int64)
    got, n = counted(0, found)
    with0[np.searchsorted(found, got)] = n
    gain = gain_of(with1, with0)
    if not (gain >= least).any():
        gain = gain_of(held[np.isin(held_names, found)], with0)
        least = 1e-9
    top = np.flatnonzero(gain >= least)
    top = top[np.argsort(-gain[top], kind="stable")[: 50 * count]]
    wanted = dict(zip(found[top].tolist(), gain[top].tolist()))
    names: dict[str, float] = {}
    for part, _ in chunks([texts[i] for i in np.flatnonzero(label == 1).tolist()]):
        low, s, e, owner = spelled(part)
        for h, at, n, _ in parts_of(low, s, e, owner):
            hit = np.flatnonzero(np.isin(h, found[top]))
            for i in hit[np.unique(h[hit], return_index=True)[1]].tolist():
                if (x := int(h[i])) in wanted:
                    names[low[at[i] : at[i] + n].astype("<u4").tobytes().decode("utf-32-le", "replace")] = wanted.pop(x)
    order = sorted(names, key=lambda w: (-round(names[w], 6), -len(w), w))
    rows = np.array(order, f"<U{LONGEST}").view(np.uint32).reshape(len(order), LONGEST) if order else np.zeros((0, LONGEST), np.uint32)
    own = own_kernels(rows)[:, -1]
    free = np.ones(len(order), bool)
    out: list[str] = []
    while free.any() and len(out) < count:
        i = int(free.argmax())
        x = order[i]
        out.append(x)
        free &= prefix_kernels(rows, rows[i][: len(x)])[:, -1] < 0.7 * np.sqrt(own * own[i])
        for k in np.flatnonzero(free).tolist():
            free[k] = not (len(x) >= STRETCH and x in order[k] or len(order[k]) >= STRETCH and order[k] in x)
    return out


def constant(share: float) -> Machine:
    """The model whose score is ``share`` (0.001 to 0.999) for every text."""
    return Machine([], np.zeros(0), 0.0, 0.0, float(np.log(max(share, 1e-3) / max(1 - share, 1e-3))))


def fit(texts: list[str], label, prior: float | None = None, landmarks: int = 64, penalty: float = 3.0, rounds: int = 60, seed: int = 3) -> Machine:
    """Train on labelled texts; ``prior`` is the share of label 1 to which the scores are then shifted.

    With one class only, or no landmark, every score is that class's share (0.5 without any text).
    """
    label = np.asarray(label, np.int64)
    share = float(label.mean()) if len(label) else 0.5
    chosen = choose_landmarks(texts, label, landmarks) if len(label) and 0 < share < 1 else []
    if not chosen:
        return constant(share)
    x = Machine(chosen, np.zeros(len(chosen)), 0.0, 1.0, 0.0).text_values(texts)
    own = Machine(chosen, np.zeros(len(chosen)), 0.0, 1.0, 0.0).text_values(chosen)  # as texts are valued
    own = (own + own.T) / 2
    val, vec = np.linalg.eigh(own)
    root = vec @ np.diag(np.where(val > 1e-3, 1 / np.sqrt(np.maximum(val, 1e-3)), 0.0)) @ vec.T
    z = np.hstack([x @ root, np.ones((len(x), 1))])
    y = 2.0 * label - 1
    cost = np.where(label == 1, penalty * 0.5 / share, penalty * 0.5 / (1 - share))
    alpha, w = np.zeros(len(y)), np.zeros(z.shape[1])
    norm = (z * z).sum(1)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(y)).tolist():
            g = y[i] * (z[i] @ w) - 1
            was = alpha[i]
            alpha[i] = min(max(was - g / norm[i], 0.0), cost[i])
            if alpha[i] != was:
                w += (alpha[i] - was) * y[i] * z[i]
                worst = max(worst, abs(alpha[i] - was))
        if worst < 1e-3:
            break
    margin = z @ w
    slope, shift = 1.0, 0.0
    t = np.where(label == 1, (label.sum() + 1) / (label.sum() + 2), 1 / ((1 - label).sum() + 2))
    for _ in range(200):  # Newton steps on the logistic curve
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        g = np.array([((p - t) * margin).sum() + 1e-3 * slope, (p - t).sum()])
        r = p * (1 - p) + 1e-9
        hess = np.array([[(r * margin**2).sum() + 1e-3, (r * margin).sum()], [(r * margin).sum(), r.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        slope, shift = slope - step[0], shift - step[1]
        if abs(step).max() < 1e-6:
            break
    if prior is not None and 0 < prior < 1:
        shift += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return Machine(chosen, root @ w[:-1], float(w[-1]), float(slope), float(shift))


def score(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """id, score (0 to 1) of every text. A null text is empty; an empty one has the score of a text without landmarks.

    Repeated rows are scored each; an empty table gives no rows; other columns are dropped, or kept as ``_row``.
    """

    def start():
        return lambda texts: {"score": pa.array(model.scores(texts))}

    return map_docs(docs, start, "score double", id_col, text_col, keep_row)
