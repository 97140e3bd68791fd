"""Operator 1: byte-pair encoding and decoding with a pair-occurrence index.

The words of a chunk of a partition are laid out as one array of symbols. An
index maps each mergeable pair, by its rank, to all positions at which it
stands in the chunk. Ranks are applied in ascending order, each to all of
its positions at once; the pairs that a merge makes on either side are added
to the lists of their own ranks. Applying the lowest active rank of the whole
chunk first is, within each word, the usual greedy order.

Equal pre-tokens of a chunk are encoded once, and the encodings of earlier
chunks are kept, up to a bound, as long as the worker lives.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from likeness.llm.arrow import binaries, map_docs
from likeness.llm.pretoken import STEP, code_points, hashes, pieces, spans

_NONE = 1 << 30


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in own else chr(256 + extra))
        extra += b not in own
    return out


def _distinct(a: np.ndarray) -> np.ndarray:
    if len(a) < 2:
        return a
    a = np.sort(a)
    return a[np.append(True, a[1:] != a[:-1])]


class Bpe:
    """A vocabulary file of the tokenizers library, BPE kind, as arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.byte_level = not suffix
        self.normalise = spec.get("normalizer") is not None
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t["special"]}
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        alphabet = byte_alphabet()
        self.first = np.array([vocab[c] for c in alphabet], np.int64)
        self.last = np.array([vocab[c + suffix] for c in alphabet], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        a = np.array([vocab[x] for x, _ in merges], np.int64)
        b = np.array([vocab[y] for _, y in merges], np.int64)
        self.left, self.right = a, b
        self.made = np.array([vocab[x + y] for x, y in merges], np.int64)
        key = a << 32 | b
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order
        size = max(max(vocab.values()), *self.specials.values(), 0) + 1
        back = {c: i for i, c in enumerate(alphabet)}
        words = [b""] * size
        for w, i in vocab.items():
            words[i] = bytes(back[c] for c in w.removesuffix(suffix)) if suffix else bytes(back[c] for c in w)
        for w, i in self.specials.items():
            words[i] = w.encode()
        self.word_len = np.fromiter(map(len, words), np.int64, size)
        self.word_at = np.cumsum(self.word_len) - self.word_len
        self.word_bytes = np.frombuffer(b"".join(words), np.uint8)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        n = int(lens.sum())
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lens)
        sym = np.empty(n + 1, np.int64)
        sym[:n] = self.first[raw]
        last = ends[lens > 0] - 1
        sym[last] = self.last[raw[last]]
        sym[n] = -1
        nxt = np.arange(1, n + 2)
        nxt[last] = n
        prv = np.arange(-1, n)
        prv[(ends - lens)[lens > 0]] = -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(pos: np.ndarray) -> None:
            r = self.rank(sym[pos], sym[nxt[pos]])
            ok = r < _NONE
            pos, r = pos[ok], r[ok]
            if not len(pos):
                return
            order = np.argsort(r, kind="stable")
            pos, r = pos[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            for k, part in zip(r[np.append(0, cuts)].tolist(), np.split(pos, cuts)):
                if k in index:
                    index[k].append(part)
                else:
                    index[k] = [part]
                    heapq.heappush(heap, k)

        add(np.flatnonzero(nxt[:n] < n))
        while heap:
            k = heapq.heappop(heap)
            found = index.pop(k)
            pos = found[0] if len(found) == 1 else np.concatenate(found)
            pos = _distinct(pos)
            a, b = self.left[k], self.right[k]
            second = nxt[pos]
            ok = (sym[pos] == a) & (sym[second] == b)
            pos, second = pos[ok], second[ok]
            if a == b and len(pos) > 1:
                keep, free = np.ones(len(pos), bool), -1
                for i, (p, q) in enumerate(zip(pos.tolist(), second.tolist())):
                    if p == free:
                        keep[i] = False
                    else:
                        free = q
                pos, second = pos[keep], second[keep]
            if not len(pos):
                continue
            after = nxt[second]
            sym[pos] = self.made[k]
            sym[second] = -2
            nxt[pos] = after
            prv[after[after < n]] = pos[after < n]
            before = prv[pos]
            add(_distinct(np.concatenate([before[before >= 0], pos[after < n]])))
        alive = sym[:n] >= 0
        upto = np.zeros(n + 1, np.int64)
        np.cumsum(alive, out=upto[1:])
        return sym[:n][alive], upto[ends] - upto[ends - lens]


@lru_cache(maxsize=4)
def load(path: str) -> "Encoder":
    return Encoder(Bpe(path))


class Encoder:
    """Encodes lists of texts; keeps the words it has met, up to ``keep`` of them."""

    def __init__(self, bpe: Bpe, keep: int = 400_000) -> None:
        self.bpe, self.keep = bpe, keep
        self._clear()

    def _clear(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)
        self.len = np.empty(0, np.int64)
        self.ids = np.empty(0, np.int32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash among the known ones, -1 where there is none."""
        if not len(self.known):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[at] == h, at, -1)

    def _learn(self, h: np.ndarray, words: list[str]) -> None:
        ids, lens = self.bpe.merge([w.encode("utf-8", "replace") for w in words])
        at = len(self.ids) + np.cumsum(lens) - lens
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        known = np.concatenate([self.known, h])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.at = np.concatenate([self.at, at])[order]
        self.len = np.concatenate([self.len, lens])[order]

    def _normal(self, text: str) -> str:
        if not self.bpe.normalise:
            return text
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def tokens(self, texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
        """Pre-tokens of all texts: spans by step, word of each, first of each text (one more at the end), id counts.

        A special token that stands in a text is a word of its own, numbered -1 - id.
        """
        if len(self.known) > self.keep:
            self._clear()
        parts: list[str] = []
        owner: list[int] = []  # text of each part
        special: list[tuple[int, int]] = []  # (part before which it stands, id)
        for i, t in enumerate(texts):
            cut = self.bpe.special_re.split(t) if self.bpe.special_re and "<|" in t else [t]
            for x in cut:
                if x in self.bpe.specials and len(cut) > 1:
                    special.append((len(parts), self.bpe.specials[x]))
                    parts.append("")
                    owner.append(i)
                    continue
                for y in pieces(self._normal(x)):
                    parts.append(y)
                    owner.append(i)
        steps, missing_h, missing_w = [], [], []
        lo = 0
        while lo < len(parts):
            hi, size = lo, 0
            while hi < len(parts) and (hi == lo or size + len(parts[hi]) < STEP):
                size += len(parts[hi]) + 1
                hi += 1
            cps, begin = code_points(parts[lo:hi])
            s, e = spans(cps, self.bpe.byte_level)
            h = hashes(cps, s, e)
            uniq, first, word = np.unique(h, return_index=True, return_inverse=True)
            new = np.flatnonzero(self._find(uniq) < 0)
            joined = "\0".join(parts[lo:hi])
            missing_h.append(uniq[new])
            missing_w.append([joined[a:b] for a, b in zip(s[first[new]].tolist(), e[first[new]].tolist())])
            steps.append((uniq, word.astype(np.int32), np.searchsorted(s, begin), s, e, lo, hi))
            lo = hi
        if steps:
            h, first = np.unique(np.concatenate(missing_h), return_index=True)
            words = [w for part in missing_w for w in part]
            if len(h):
                self._learn(h, [words[i] for i in first.tolist()])
        word_of, token_at, spans_of = [], [], []
        base = 0
        for uniq, word, begin, s, e, lo, hi in steps:
            word_of.append(self._find(uniq)[word])
            token_at.append(begin + base)
            spans_of.append((s, e))
            base += len(word)
        words = np.concatenate(word_of) if word_of else np.empty(0, np.int64)
        part_at = np.append(np.concatenate(token_at), base) if token_at else np.zeros(1, np.int64)
        if special:
            at = part_at[[p for p, _ in special]]
            words = np.insert(words, at, [-1 - i for _, i in special])
            shift = np.zeros(len(part_at), np.int64)
            np.add.at(shift, [p + 1 for p, _ in special], 1)
            part_at = part_at + np.cumsum(shift)
        first_part = np.searchsorted(np.array(owner, np.int64), np.arange(len(texts) + 1))
        lens = np.where(words < 0, 1, self.len[np.maximum(words, 0)] if len(self.len) else 1)
        return spans_of, words, part_at[first_part], lens

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's ids end."""
        _, words, first, lens = self.tokens(texts)
        upto = np.zeros(len(words) + 1, np.int64)
        np.cumsum(lens, out=upto[1:])
        ids = np.empty(int(upto[-1]), np.int32)
        if len(words):
            from_ = np.where(words < 0, 0, self.at[np.maximum(words, 0)] if len(self.at) else 0)
            pick = np.repeat(from_ - upto[:-1], lens) + np.arange(len(ids))
            if (words < 0).any():
                sp = words < 0
                pick[upto[:-1][sp]] = 0
                ids[:] = self.ids[pick] if len(self.ids) else 0
                ids[upto[:-1][sp]] = -1 - words[sp]
            else:
                ids[:] = self.ids[pick]
        return ids, upto[first[1:]]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The text of each slice of ids; bytes that are not UTF-8 become U+FFFD."""
        bpe = self.bpe
        lens = bpe.word_len[ids]
        upto = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(lens, out=upto[1:])
        data = bpe.word_bytes[np.repeat(bpe.word_at[ids] - upto[:-1], lens) + np.arange(int(upto[-1]))].tobytes()
        stops = upto[ends].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip([0, *stops[:-1]], stops)]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every text: id, n_tokens, ids (little-endian unsigned 32-bit integers).

    A null text is the empty text; an empty text has no ids. Repeated rows are
    encoded each; an empty table gives no rows; other columns are dropped.
    """

    def start():
        enc = load(path)

        def f(texts: list[str]) -> dict:
            ids, ends = enc.encode(texts)
            return {"n_tokens": pa.array(np.diff(ends, prepend=0)), "ids": binaries(ids.astype("<u4"), ends)}

        return f

    return map_docs(docs, start, "n_tokens long, ids binary", id_col, text_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode``, with ``decoded``, the text that the ids decode to (special tokens kept)."""

    def start():
        enc = load(path)

        def f(texts: list[str]) -> dict:
            ids, ends = enc.encode(texts)
            return {"n_tokens": pa.array(np.diff(ends, prepend=0)), "ids": binaries(ids.astype("<u4"), ends), "decoded": pa.array(enc.decode(ids, ends), pa.string())}

        return f

    return map_docs(docs, start, "n_tokens long, ids binary, decoded string", id_col, text_col)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The text of every row's ids (as ``encode`` writes them): id, decoded. Null ids give the empty text; ids outside the vocabulary fail."""
    from pyspark.sql import functions as F

    from likeness.runtime import ship

    ship(rows.sparkSession)

    def run(batches):
        enc = load(path)
        for b in batches:
            each = [np.frombuffer(x or b"", "<u4").astype(np.int64) for x in b.column(1).to_pylist()]
            flat = np.concatenate([np.empty(0, np.int64), *each])
            ends = np.cumsum(np.fromiter(map(len, each), np.int64, len(each)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(enc.decode(flat, ends), pa.string())], names=[id_col, "decoded"])

    src = rows.select(F.col(f"`{id_col}`").cast("long").alias(id_col), F.col(f"`{ids_col}`").alias("_ids"))
    return src.mapInArrow(run, f"`{id_col}` long, decoded string")
