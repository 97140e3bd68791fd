"""Operator 3: personal data, by patterns and a linear-chain conditional random field.

Four patterns give the base spans. The random field adds spans that have the
shape and context of personal data but miss the patterns' letter, such as an
address with the at-sign and dots spelled out, or a phone number without the
plus. It labels word pieces by shape features (kind of characters, length,
digit count, neighbours, cue words), is trained by gradient ascent on
a small labelled table that is built from templates in this module, and is
decoded by Viterbi over numpy batches.

Part of the model is a constraint: a piece is inside a span only if it is live
(has a digit, an at-sign or a spelled-out form of one) or next to a live piece.
Elsewhere the label is outside, so the chain falls apart into short stretches
around the live pieces, and only these are decoded, with the features of the
pieces around them. The result is that of decoding the whole text.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from likeness.llm.arrow import map_docs

KINDS = ("email", "ip", "card", "phone")

# ---------------------------------------------------------------- base spans
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    """The local part is the run before the at-sign, back to the last match at most."""
    out, last = [], 0
    if "@" not in text:
        return out
    for m in _DOMAIN.finditer(text):
        s = m.start()
        while s > last and text[s - 1] in _LOCAL:
            s -= 1
        if s < m.start():
            out.append((s, m.end()))
            last = m.end()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' matches: leftmost, not overlapping within a kind, failing ones dropped."""
    out = [(0, s, e) for s, e in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((3, *m.span()))
    return out


# ------------------------------------------------------------- random field
#: A piece: white-space-free run, less punctuation at its ends.
_PIECE = re.compile(r"\S+")
#: Words that may stand inside a spelled-out address, or before a number (fixed values).
AT_WORDS = ("at", "(at)", "[at]", "{at}", "arroba")
DOT_WORDS = ("dot", "(dot)", "[dot]", "{dot}", "punto")
CUES = {w: k for k, ws in {"mail": ("mail", "email", "e-mail", "contact"), "phone": ("phone", "call", "tel", "telephone", "mobile", "fax", "dial"), "card": ("card", "visa", "mastercard", "pan"), "ip": ("ip", "host", "server", "address")}.items() for w in ws}
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))


def _shape(w: str) -> str:
    """Digits as 9, letters as a or A, runs shortened; other characters as they are."""
    out, last, n = [], "", 0
    for c in w:
        k = "9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else "a" if c.isalpha() else c
        n = n + 1 if k == last else 1
        if n <= 2:
            out.append(k)
        last = k
    return "".join(out)


def _own_features(w: str) -> list[str]:
    low = w.lower().strip(".,;:!?\"'")
    digits = sum(c in "0123456789" for c in w)
    f = ["bias", "shape=" + _shape(low), f"digits={min(digits, 20)}", f"len={min(len(low), 24)}"]
    if low in AT_WORDS:
        f.append("at-word")
    if low in DOT_WORDS:
        f.append("dot-word")
    if low in CUES:
        f.append("cue=" + CUES[low])
    if "@" in low:
        f.append("has-at")
    if digits and digits == len(low):
        f.append("all-digits")
    if digits and not any(c.isalpha() for c in low):
        f.append("digits-and-marks")
    if any(c in "abcdef" for c in low) and digits and all(c in "0123456789abcdef" for c in low):
        f.append("hexadecimal")
    f.append("plain" if low.isalpha() else "not-plain")
    return f


def features(words: list[str]) -> list[list[str]]:
    own = [_own_features(w) for w in words]
    out = []
    for i in range(len(words)):
        f = list(own[i])
        for d in range(-2, 3):
            if not d:
                continue
            if 0 <= i + d < len(words):
                f += [f"{d}:{x}" for x in own[i + d] if x.startswith(("at-", "dot-", "cue=", "has-", "all-", "digits-and", "digits=", "plain"))]
            else:
                f.append(f"{d}:edge")
        out.append(f)
    return out


def labelled_table(seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """The training table: sentences as words with labels, from templates; about half of them hold nothing personal."""
    r = random.Random(seed)
    name = lambda: "".join(r.choice("abdefghilmnorstuv") for _ in range(r.randint(2, 8)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    fill = lambda: [name() for _ in range(r.randint(1, 5))]

    def tag(words: list[str], kind: str) -> list[tuple[str, str]]:
        return [(w, ("B-" if i == 0 else "I-") + kind) for i, w in enumerate(words)]

    def spelled() -> list[str]:
        at, dot = r.choice(AT_WORDS), r.choice(DOT_WORDS)
        out = [name() + r.choice(["", num(2), "." + num(2)]), at, name() + r.choice(["", num(1)]), dot, r.choice(["com", "org", "net", "de"])]
        return out

    def joined() -> list[str]:
        return [name() + r.choice(["", num(2)]) + r.choice(["[at]", "(at)", "{at}"]) + name() + r.choice(["[dot]", "(dot)"]) + r.choice(["com", "org", "net"])]

    def phone() -> list[str]:
        a, b, c = num(3), num(3), num(4)
        return r.choice([[f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"{a}.{b}.{c}"], ["1", f"({a})", f"{b}-{c}"], [f"001-{a}-{b}-{c}"]])

    def card() -> list[str]:
        return [".".join([num(4) for _ in range(4)])]

    def address() -> list[str]:
        parts = [str(r.randint(0, 255)) for _ in range(4)]
        dot = r.choice(DOT_WORDS)
        if r.random() < 0.5:
            return [w for p in parts for w in (dot, p)][1:]
        return [r.choice(["[.]", "(.)", "{.}", "[dot]", "(dot)"]).join(parts)]

    def nothing() -> list[str]:
        pick = r.randint(0, 11)
        return [[num(4)], [num(r.randint(1, 3))], [num(1) + "." + num(1)], ["version", num(1) + "." + num(1) + "." + num(2)], [f"{num(2)}:{num(2)}"], [f"20{num(2)}-{num(2)}-{num(2)}"], ["".join(r.choice("0123456789abcdef") for _ in range(r.choice([16, 18, 40])))], ["$" + num(3) + "." + num(2)], ["at", name()], ["dot", name()], [name() + num(2)], ["".join(r.choice("0123456789ABCDEFGHKLM") for _ in range(20))]][pick]

    out = []
    for _ in range(400):
        row: list[tuple[str, str]] = [(w, "O") for w in fill()]
        for _ in range(r.randint(0, 2)):
            make, kind, cue = r.choice([(spelled, "email", ["mail", "contact"]), (spelled, "email", ["mail"]), (joined, "email", ["contact"]), (phone, "phone", ["call", "phone", "tel"]), (card, "card", ["card", "visa"]), (address, "ip", ["ip", "host", "server"])])
            row += [(r.choice(cue), "O")] * (kind == "phone" or r.random() < 0.5) + tag(make(), kind) + [(w, "O") for w in fill()]
        for _ in range(r.randint(0, 3)):
            row += [(w, "O") for w in nothing() + fill()]
        out.append(([w for w, _ in row], [t for _, t in row]))
    for _ in range(60):  # a bare ten-digit form with no cue, and long digit runs, are no phone
        row = [(w, "O") for w in fill() + [r.choice([num(16), num(10), num(12), f"{num(3)}-{num(2)}"])] + fill()]
        out.append(([w for w, _ in row], [t for _, t in row]))
    return out


class Field:
    """Weights of features by label, and of label pairs."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray) -> None:
        self.index, self.emit, self.move = index, emit, move

    def scores(self, feats: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(feats), len(LABELS)))
        for i, f in enumerate(feats):
            hit = [self.index[x] for x in f if x in self.index]
            if hit:
                out[i] = self.emit[hit].sum(0)
        return out


def allowed() -> np.ndarray:
    """0 where a label may follow another, minus infinity else: I needs B or I of its kind before."""
    bad = np.zeros((len(LABELS), len(LABELS)))
    for j, to in enumerate(LABELS):
        if to[0] == "I":
            for i, was in enumerate(LABELS):
                if was == "O" or was[2:] != to[2:]:
                    bad[i, j] = -np.inf
    return bad


def forward_backward(e: np.ndarray, move: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log normaliser, label marginals and summed pair marginals of sentences padded to one length (b, t, k)."""
    b, t, k = e.shape
    start = np.where([x[0] == "I" for x in LABELS], -np.inf, 0.0)
    lse = lambda x, axis: (m := x.max(axis, keepdims=True), np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis))[1]
    al, be = np.zeros_like(e), np.zeros_like(e)
    al[:, 0] = e[:, 0] + start
    with np.errstate(invalid="ignore", divide="ignore"):
        for i in range(1, t):
            step = lse(np.maximum(al[:, i - 1, :, None] + move, -1e9), 1) + e[:, i]
            al[:, i] = np.where(mask[:, i, None], step, al[:, i - 1])
        for i in range(t - 2, -1, -1):
            step = lse(np.maximum(move + (e[:, i + 1] + be[:, i + 1])[:, None, :], -1e9), 2)
            be[:, i] = np.where(mask[:, i + 1, None], step, 0)
        z = lse(np.maximum(al[:, -1], -1e9), 1)
        node = np.exp(al + be - z[:, None, None]) * mask[:, :, None]
        pair = np.zeros((k, k))
        for i in range(1, t):
            pair += (np.exp(np.maximum(al[:, i - 1, :, None] + move + (e[:, i] + be[:, i])[:, None, :] - z[:, None, None], -1e9)) * mask[:, i, None, None]).sum(0)
    return z, node, pair


@lru_cache(maxsize=1)
def trained(rounds: int = 60, seed: int = 7) -> Field:
    """Fit on the labelled table: Adagrad on the penalised conditional likelihood, full batches."""
    table = labelled_table(seed)
    index: dict[str, int] = {}
    feats = [features(w) for w, _ in table]
    t = max(map(len, feats))
    k = len(LABELS)
    rows, cols, gold = [], [], []
    mask = np.zeros((len(table), t), bool)
    for s, (f, (_, tags)) in enumerate(zip(feats, table)):
        mask[s, : len(f)] = True
        for i, x in enumerate(f):
            for name in x:
                rows.append(s * t + i)
                cols.append(index.setdefault(name, len(index)))
        gold.append([LABELS.index(y) for y in tags])
    rows, cols = np.array(rows), np.array(cols)
    order = np.argsort(rows, kind="stable")
    rows, cols = rows[order], cols[order]
    firsts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    at = rows[firsts]
    one = np.zeros((len(table), t, k))
    pairs = np.zeros((k, k))
    for s, g in enumerate(gold):
        one[s, np.arange(len(g)), g] = 1
        np.add.at(pairs, (g[:-1], g[1:]), 1)
    bad = allowed()
    emit, move = np.zeros((len(index), k)), np.zeros((k, k))
    se, sm = np.full_like(emit, 1e-6), np.full_like(move, 1e-6)
    by_col = np.argsort(cols, kind="stable")
    col_first = np.flatnonzero(np.append(True, cols[by_col][1:] != cols[by_col][:-1]))
    for _ in range(rounds):
        e = np.zeros((len(table) * t, k))
        e[at] = np.add.reduceat(emit[cols], firsts, axis=0)
        _, node, pair = forward_backward(e.reshape(len(table), t, k), move + bad, mask)
        miss = (one - node).reshape(-1, k)
        ge = np.add.reduceat(miss[rows[by_col]], col_first, axis=0) - 0.02 * emit
        gm = np.where(np.isfinite(bad), pairs - pair, 0) - 0.02 * move
        se += ge**2
        sm += gm**2
        emit += 0.5 * ge / np.sqrt(se)
        move += 0.5 * gm / np.sqrt(sm)
    return Field(index, emit, move + bad)


def viterbi(stretches: list[np.ndarray], move: np.ndarray) -> list[np.ndarray]:
    """Best labels of each stretch of scores. Stretches of about one length are decoded together."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(stretches)
    start = np.where([x[0] == "I" for x in LABELS], -np.inf, 0.0)
    order = sorted(range(len(stretches)), key=lambda i: len(stretches[i]))
    lo = 0
    while lo < len(order):
        n = len(stretches[order[lo]])
        hi = lo
        while hi < len(order) and len(stretches[order[hi]]) == n and hi - lo < 8192:
            hi += 1
        if n:
            e = np.stack([stretches[i] for i in order[lo:hi]])
            best, back = e[:, 0] + start, []
            for i in range(1, n):
                both = best[:, :, None] + move
                back.append(both.argmax(1))
                best = both.max(1) + e[:, i]
            path = [best.argmax(1)]
            for b in reversed(back):
                path.append(b[np.arange(len(b)), path[-1]])
            got = np.stack(path[::-1], 1)
            for j, i in enumerate(order[lo:hi]):
                out[i] = got[j]
        lo = hi
    return out


#: A piece is live if it has a digit, an at-sign or a bracketed at or dot, or is a bare word for one of them.
_LIVE = re.compile(r"[0-9@]|[(\[{](?:at|dot)[)\]}]|(?<!\S)(?:at|dot|arroba|punto)(?!\S)", re.I)
_TRIM = ".,;:!?\"'<>"
#: Pieces next to a live one whose labels are free, and pieces beyond them that features can see.
FREE, SEEN = 1, 2


def stretches(t: str) -> list[list[tuple[int, int]]]:
    """Spans of pieces in runs that hold every live piece of the text, FREE + SEEN pieces before and after it. No two runs share a piece."""
    out: list[list[tuple[int, int]]] = []
    last = 0  # end of the last piece that is in a run
    m = _LIVE.search(t)
    while m:  # once for each live piece, however many of its letters are
        if m.start() >= last:
            s = m.start()
            while s > last and not t[s - 1].isspace():
                s -= 1
            before, at = [], s
            while len(before) < FREE + SEEN and (found := piece_before(t, at, last)):
                before.append(found)
                at = found[0]
            run = [*before[::-1], (s, _PIECE.match(t, m.start()).end())]
            if out and not t[last : run[0][0]].strip():
                out[-1] += run
            else:
                out.append(run)
        else:  # within the pieces that follow an earlier live one
            while out[-1][-1][0] > m.start():
                out[-1].pop()
        done = out[-1][-1][1]
        for _ in range(FREE + SEEN):
            found = _PIECE.search(t, out[-1][-1][1])
            if not found:
                break
            out[-1].append(found.span())
        last = out[-1][-1][1]
        m = _LIVE.search(t, done)
    return out


def piece_before(t: str, at: int, least: int) -> tuple[int, int] | None:
    """The last piece that ends before ``at`` and does not begin before ``least``."""
    e = at
    while e > least and t[e - 1].isspace():
        e -= 1
    s = e
    while s > least and not t[s - 1].isspace():
        s -= 1
    return (s, e) if s < e else None


def free_pieces(words: list[str]) -> np.ndarray:
    """Which pieces may be inside a span."""
    live = np.array([bool(_LIVE.search(w)) for w in words], bool)
    out = live.copy()
    out[1:] |= live[:-1]
    out[:-1] |= live[1:]
    return out


def label_scores(words: list[str], field: Field) -> np.ndarray:
    """(piece, label): minus infinity for inside labels of pieces that are not free."""
    e = field.scores(features(words))
    e[~free_pieces(words), 1:] = -np.inf
    return e


def field_spans(texts: list[str], field: Field) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) that the random field finds in each text."""
    runs, owner = [], []
    for d, t in enumerate(texts):
        for run in stretches(t):
            runs.append(run)
            owner.append(d)
    scores = [label_scores([texts[d][s:e] for s, e in run], field) for d, run in zip(owner, runs)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for d, run, labels in zip(owner, runs, viterbi(scores, field.move)):
        out[d] += spans_of(texts[d], run, labels)
    return out


def spans_of(text: str, run: list[tuple[int, int]], labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the labelled spans that can be what they are called."""
    out, i = [], 0
    while i < len(run):
        y = LABELS[labels[i]]
        j = i + 1
        if y[0] == "B":
            while j < len(run) and LABELS[labels[j]] == "I-" + y[2:]:
                j += 1
            s, e = run[i][0], run[j - 1][1]
            while s < e and text[s] in _TRIM:
                s += 1
            while e > s and text[e - 1] in _TRIM:
                e -= 1
            if e > s and plausible(y[2:], text[s:e]):
                out.append((KINDS.index(y[2:]), s, e))
        i = j
    return out


def plausible(kind: str, found: str) -> bool:
    """What a span of the kind must hold, whatever its shape."""
    digits = len(_NOT_DIGIT.sub("", found))
    if kind == "email":
        low = found.lower()
        return bool(re.search(r"@|[(\[{]at[)\]}]|\s(?:at|arroba)\s", low)) and bool(re.search(r"\.|[(\[{]dot[)\]}]|\s(?:dot|punto)\s", low)) and len(found) >= 7
    if kind == "phone":
        return 8 <= digits <= 15
    if kind == "card":
        return 16 <= digits <= 19 and luhn(_NOT_DIGIT.sub("", found))
    parts = re.findall(r"[0-9]+", found)
    return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)


def merged(base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """All base spans, and those of ``more`` that overlap none of them; by kind, then start."""
    taken: list[list[int]] = []  # union of the base spans, in order
    for s, e in sorted((s, e) for _, s, e in base):
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    starts = [a for a, _ in taken]
    out = list(base)
    for k, s, e in more:
        i = bisect_left(starts, e)  # the last base span that begins before e
        if i == 0 or taken[i - 1][1] <= s:
            out.append((k, s, e))
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """Personal data of every text: id, n_email, n_ip, n_card, n_phone (base spans), base_spans and spans (text), redacted.

    Spans are kind:start:end in code points, end exclusive, by kind and then
    start, comma-joined. ``redacted`` has [KIND] in place of every span, of
    overlapping ones the first and longest. A null text is empty and has
    none. Repeated rows are searched each; an empty table gives no rows;
    other columns are dropped, or kept as the struct ``_row``.
    """

    field = trained()

    def start():

        def f(texts: list[str]) -> dict:
            base = [base_spans(t) for t in texts]
            spans = [merged(b, m) for b, m in zip(base, field_spans(texts, field))]
            counts = {f"n_{k}": pa.array([sum(x[0] == i for x in b) for b in base], pa.int64()) for i, k in enumerate(KINDS)}
            return counts | {"base_spans": pa.array(map(written, base), pa.string()), "spans": pa.array(map(written, spans), pa.string()), "redacted": pa.array([redact(t, s) for t, s in zip(texts, spans)], pa.string())}

        return f

    return map_docs(docs, start, "n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string, redacted string", id_col, text_col, keep_row)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    if not spans:
        return text
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s < at:
            at = max(at, e)
            continue
        out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = e
    return "".join(out) + text[at:]
