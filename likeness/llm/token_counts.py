"""Operator 9: token counts that follow edits.

Each document keeps a segment tree over its pre-tokens: a leaf has the
characters and tokens of a pre-token, an inner node the sums below it. An
edit replaces some characters. Only the region between the nearest boundaries
around it is encoded anew, with a few characters of context; its leaves get the
new counts, and the sums on the paths to the root are updated.

Boundaries are of two kinds, in any script, in numbers, marks and code:

* between pre-tokens, where by the pre-tokeniser's classes neither side depends
  on what lies beyond: before white space, and between letters, numbers and
  other characters (but for an apostrophe, which may begin a contraction); and
  beside a special token, which is a leaf of its own;
* within a long pre-token, at the end of one of its tokens. A sequence of tokens is
  the encoding of a text if and only if any two neighbours are the encoding of
  theirs, so a new stretch fits in if it begins and ends with the tokens that stood
  there; else it is widened.

The k-th edits of all documents of a chunk are encoded in one batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from likeness.llm.arrow import CHUNK_CHARS
from likeness.llm.bpe import Encoder, load
from likeness.llm.pretoken import SPACE, tables
from likeness.runtime import ship

#: Longer pre-tokens are cut, about every so many tokens.
LONG, GROUP = 48, 6
#: Characters on either side of an edit that belong to its region: contractions and white space before a word reach no further.
CONTEXT = 4


def _cuts(text: str, ids: np.ndarray, enc: Encoder) -> tuple[list[int], list[int]]:
    """Characters and tokens of the pieces of a pre-token: it is cut where a token ends with a character, and no apostrophe is beside."""
    size = [1 if 0xD800 <= ord(c) < 0xE000 else len(c.encode()) for c in text]
    char_at = dict(zip(np.cumsum(size).tolist(), range(1, len(text) + 1)))
    chars, tokens, done, last, at = [], [], 0, 0, 0
    for k, n in enumerate(enc.bpe.word_len[ids].tolist(), 1):
        at += n
        c = char_at.get(at)
        if c and k - last >= GROUP and c < len(text) and "'" not in text[c - 1 : c + 1]:
            chars.append(c - done)
            tokens.append(k - last)
            done, last = c, k
    return [*chars, len(text) - done], [*tokens, len(ids) - last]


def leaves(enc: Encoder, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text, of its leaves: characters, tokens, and whether it goes on within the pre-token of the one before."""
    spans, words, first, lens = enc.tokens(texts)
    plain = words >= 0
    chars = np.zeros(len(words), np.int64)
    chars[plain] = np.concatenate([np.empty(0, np.int64), *(e - s for s, e in spans)])
    if not plain.all():
        name = {v: len(k) for k, v in enc.bpe.specials.items()}
        chars[~plain] = [name[-1 - w] for w in words[~plain].tolist()]
    lens = np.asarray(lens, np.int64)
    inner = np.zeros(len(words), bool)
    long = np.flatnonzero(plain & (chars > LONG))
    if len(long):
        upto = np.append(0, np.cumsum(chars))
        own = np.searchsorted(first, long, "right") - 1
        pieces = []
        for k, t in zip(long.tolist(), own.tolist()):
            begin = int(upto[k] - upto[first[t]])
            ids = enc.ids[enc.at[words[k]] : enc.at[words[k]] + enc.len[words[k]]]
            pieces.append(_cuts(texts[t][begin : begin + int(chars[k])], ids, enc))
        times = np.ones(len(words), np.int64)
        times[long] = [len(c) for c, _ in pieces]
        at = np.append(0, np.cumsum(times))
        chars, lens, inner = np.repeat(chars, times), np.repeat(lens, times), np.zeros(int(at[-1]), bool)
        for k, (c, n) in zip(long.tolist(), pieces):
            chars[at[k] : at[k + 1]], lens[at[k] : at[k + 1]] = c, n
            inner[at[k] + 1 : at[k + 1]] = True
        first = at[first]
    return [(chars[a:b], lens[a:b], inner[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


class CountTree:
    """Segment tree of one text: characters and tokens of its pre-tokens, or of pieces of long ones."""

    def __init__(self, text: str, chars: np.ndarray, tokens: np.ndarray, inner: np.ndarray, specials=()) -> None:
        self.text, self.n, self.inner, self.specials = text, len(chars), inner.copy(), specials
        self.begin = np.append(0, np.cumsum(chars))
        self.size = 1 << max(self.n - 1, 0).bit_length()
        self.chars = np.zeros(2 * self.size, np.int64)
        self.tokens = np.zeros(2 * self.size, np.int64)
        self.chars[self.size : self.size + self.n] = chars
        self.tokens[self.size : self.size + self.n] = tokens
        half = self.size
        while half > 1:
            for a in (self.chars, self.tokens):
                np.add(a[half : 2 * half : 2], a[half + 1 : 2 * half : 2], out=a[half // 2 : half])
            half //= 2
        self.new: dict[int, str] = {}  # leaves with text of their own

    def leaf_text(self, i: int) -> str:
        if not self.chars[i + self.size]:
            return ""
        return self.new[i] if i in self.new else self.text[self.begin[i] : self.begin[i + 1]]

    def find(self, at: int) -> tuple[int, int]:
        """Leaf that holds character ``at``, and where that leaf begins; the last leaf for the end of the text."""
        if at >= self.chars[1]:
            at = int(self.chars[1]) - 1
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if at >= before + self.chars[i]:
                before += int(self.chars[i])
                i += 1
        return i - self.size, before

    def step(self, i: int, by: int) -> int:
        """The next leaf that has characters, or -1."""
        i += by
        while 0 <= i < self.n and not self.chars[i + self.size]:
            i += by
        return i if 0 <= i < self.n else -1

    def ends_before(self, i: int) -> bool:
        """Whether a region may begin with leaf ``i``, or end before it."""
        left = self.step(i, -1)
        if left < 0 or self.inner[i]:
            return True
        one, two = self.leaf_text(left), self.leaf_text(i)
        if one in self.specials or two in self.specials:
            return True
        a, b = tables()[0][ord(one[-1])], tables()[0][ord(two[0])]
        return a != SPACE and (b == SPACE or (a != b and one[-1] != "'"))

    def left_of(self, i: int) -> int:
        """The nearest leaf before ``i`` with which a region may begin; ``i`` if there is none before."""
        while (left := self.step(i, -1)) >= 0:
            i = left
            if self.ends_before(i):
                break
        return i

    def right_of(self, j: int) -> int:
        """The nearest leaf after ``j`` with which a region may end; ``j`` if there is none after."""
        while (right := self.step(j, 1)) >= 0:
            j = right
            after = self.step(j, 1)
            if after < 0 or self.ends_before(after):
                break
        return j

    def goes_on(self, j: int) -> bool:
        """Whether the leaf after ``j`` is of the same pre-token."""
        after = self.step(j, 1)
        return after >= 0 and bool(self.inner[after])

    def region(self, at: int, delete: int, context: int) -> tuple[int, int]:
        """First and last leaf between boundaries that the edit, and some characters on either side, stay within; beside a cut in a pre-token one piece more."""
        i, _ = self.find(max(at - context, 0))
        j, _ = self.find(at + delete + context)
        i = i if self.ends_before(i) else self.left_of(i)
        after = self.step(j, 1)
        j = j if after < 0 or self.ends_before(after) else self.right_of(j)
        return self.left_of(i) if self.inner[i] else i, self.right_of(j) if self.goes_on(j) else j

    def begins(self, i: int) -> int:
        """Characters before leaf ``i``."""
        p, before = i + self.size, 0
        while p > 1:
            if p & 1:
                before += int(self.chars[p - 1])
            p >>= 1
        return before

    def replace(self, i: int, j: int, text: str, chars: np.ndarray, tokens: np.ndarray, inner: np.ndarray) -> None:
        """Deal the new leaves of a region to the places of its old ones; what goes beyond their number is put together evenly."""
        places = np.arange(i, j + 1)
        cut = np.unique(np.linspace(0, len(chars), min(len(places), len(chars)) + 1).astype(int))
        touched = set()
        upto = np.append(0, np.cumsum(chars))
        for k, place in enumerate(places.tolist()):
            self.new.pop(place, None)
            a, b = (int(cut[k]), int(cut[k + 1])) if k + 1 < len(cut) else (0, 0)
            self.chars[place + self.size] = upto[b] - upto[a]
            self.tokens[place + self.size] = tokens[a:b].sum()
            self.new[place] = text[upto[a] : upto[b]]
            self.inner[place] = self.inner[place] if k == 0 else bool(b > a and inner[a])
            touched.add((place + self.size) >> 1)
        while touched and max(touched) > 0:
            for p in touched:
                self.chars[p] = self.chars[2 * p] + self.chars[2 * p + 1]
                self.tokens[p] = self.tokens[2 * p] + self.tokens[2 * p + 1]
            touched = {p >> 1 for p in touched if p > 1}

    @property
    def total(self) -> int:
        return int(self.tokens[1]) if self.n else 0


def edited(text: str, edits: list[tuple[int, int, str]]) -> str:
    """The text after all edits."""
    for at, delete, insert in edits:
        at = min(at, len(text))
        text = text[:at] + insert + text[at + delete :]
    return text


def count_chunk(enc: Encoder, texts: list[str], edits: list[list[tuple[int, int, str]]]) -> dict[str, np.ndarray]:
    """Counts of a chunk of documents, before and after their edits."""
    n = len(texts)
    out = {k: np.zeros(n, np.int64) for k in ("n_tokens", "n_edits", "n_tokens_after", "n_chars_after", "n_chars_encoded")}
    out["n_edits"][:] = list(map(len, edits))
    specials = enc.bpe.specials
    longest = max(map(len, specials), default=0)
    could_be_special = lambda i: all(any(c in x for x in (texts[i], *(e[2] for e in edits[i]))) for c in "<|")
    context = [max(CONTEXT, longest) if could_be_special(i) else CONTEXT for i in range(n)]
    trees: dict[int, CountTree] = {}
    for i, (chars, tokens, inner) in enumerate(leaves(enc, texts)):
        out["n_tokens"][i] = out["n_tokens_after"][i] = tokens.sum()
        out["n_chars_after"][i] = len(texts[i])
        if edits[i]:
            if not len(chars):  # an empty text: one empty leaf
                chars, tokens, inner = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, bool)
            trees[i] = CountTree(texts[i], chars, tokens, inner, specials)

    for k in range(max((len(edits[i]) for i in trees), default=0)):
        live = []
        for i, tree in trees.items():
            if k < len(edits[i]):
                at, delete, insert = edits[i][k]
                size = int(tree.chars[1])
                at = min(at, size)
                delete = min(delete, size - at)
                live.append((i, at, delete, insert, *(tree.region(at, delete, context[i]) if size else (0, 0))))
        while live:
            asked, now = [], []
            for i, at, delete, insert, lo, hi in live:
                tree = trees[i]
                was = "".join(tree.leaf_text(j) for j in range(lo, hi + 1))
                begin = at - tree.begins(lo)
                text = was[:begin] + insert + was[begin + delete :]
                now.append(text)
                asked += [text, tree.leaf_text(lo) if tree.inner[lo] else "", tree.leaf_text(hi) if tree.goes_on(hi) else ""]
                out["n_chars_encoded"][i] += sum(map(len, asked[-3:]))
            ids, ends = enc.encode(asked)
            begins = np.append(0, ends)
            part = lambda x: ids[begins[x] : begins[x + 1]]
            fits, wider = [], []
            for x, (i, at, delete, insert, lo, hi) in enumerate(live):
                got, first, last = part(3 * x), part(3 * x + 1), part(3 * x + 2)
                left, right = len(first) and (not len(got) or got[0] != first[0]), len(last) and (not len(got) or got[-1] != last[-1])
                if left or right:
                    tree = trees[i]
                    wider.append((i, at, delete, insert, tree.left_of(lo) if left else lo, tree.right_of(hi) if right else hi))
                else:
                    fits.append(x)
            for x, new in zip(fits, leaves(enc, [now[x] for x in fits])):
                i, *_, lo, hi = live[x]
                trees[i].replace(lo, hi, now[x], *new)
            live = wider
    for i, tree in trees.items():
        out["n_tokens_after"][i], out["n_chars_after"][i] = tree.tokens[1], tree.chars[1]
    return out


def count_edits(docs: DataFrame, path: str, edits_col: str = "edits", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts before and after a document's edits: id, n_tokens, n_edits, n_tokens_after, n_chars_after, n_chars_encoded.

    ``edits_col``: array of (at, delete, insert), applied one after another,
    each to the text that the last one left. An edit beyond the text's end
    appends; a null insert is empty; null edits are none. A null text is
    empty. n_chars_encoded: characters that the edits made to encode anew, in
    texts of any script, numbers, marks or special tokens. Repeated rows are counted each, an empty table
    gives no rows, other columns are dropped. ``path``: a byte-level
    vocabulary; with another kind the operator fails.
    """
    ship(docs.sparkSession)
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"), F.col(f"`{edits_col}`").cast("array<struct<at:long,delete:long,insert:string>>").alias("_edits"))

    def clean(edits: list | None) -> list[tuple[int, int, str]]:
        return [(max(e["at"] or 0, 0), max(e["delete"] or 0, 0), e["insert"] or "") for e in edits or [] if e]

    def run(batches):
        enc = load(path)
        if not enc.bpe.byte_level:
            raise ValueError("edit-aware counts need a byte-level vocabulary")
        for b in batches:
            texts, edits = b.column(1).to_pylist(), [clean(e) for e in b.column(2).to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK_CHARS):
                    size += len(texts[hi])
                    hi += 1
                got = count_chunk(enc, texts[lo:hi], edits[lo:hi])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *map(pa.array, got.values())], names=[id_col, *got])
                lo = hi

    return src.mapInArrow(run, f"`{id_col}` long, n_tokens long, n_edits long, n_tokens_after long, n_chars_after long, n_chars_encoded long")
