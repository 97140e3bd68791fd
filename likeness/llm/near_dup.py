"""Operator 8: near-duplicates by a chosen-path set similarity join.

A document is the set of its distinct five-word shingles. Equal sets are one
from the start. The sets are joined on independent trees: at each level of a
tree a set follows, by the minima of its shingles under the level's hash
functions, to children that it shares with the sets of the same minima. Two
functions are drawn at each level, so a pair of similarity 0.75 stays together
in at least one child with a chance that, over any depth, never falls below
8/9 (the root of q = (1/4 + 3/4 q)^2 is q = 1/9). Seven independent trees would
lose such a pair with a chance below 10^-6; but below the first level all trees
draw from the same 32 minima of a set, so they are not independent. For a pair
at exactly 0.75 that meets only in nodes that are not small, the chance by
calculation is 3e-6 after one deeper level, 2e-5 after two and 3e-4 after six;
a pair that meets in a small node of the first level is lost with 4e-9. A small
node is compared exhaustively; only nodes that are not small are branched further.

Comparisons are on 256 minima of 8 bits first, which all but one in a million
linked pairs pass, and then on the full sets, made anew from the texts.

A crowd of near copies stays in one node on every level. So in each node all
sets are first compared with one of them, the links found are closed to
components, and whatever lies within one component is done: no further
comparison can change the result. Only nodes that hold several components go
on to the exhaustive comparison and to deeper levels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from likeness.llm.arrow import binaries, map_docs
from likeness.llm.pretoken import powers
from likeness.runtime import cut, ship, tidy

WORDS = 5
TREES, BRANCH = 7, 2
#: Minima kept in full for branching: the first TREES * BRANCH for the first level, all for deeper ones.
KEYS = 32
SKETCH = 256
#: Equal minima of 256 that a pair must have to be compared in full, and of the first 32 to be counted:
#: of linked pairs one in a million has fewer.
LEAST_EQUAL, FIRST, LEAST_FIRST = 159, 32, 11
#: Sets in a node that are compared exhaustively, shingles of all its sets (8 bytes each), and levels below the first.
SMALL, LIGHT, DEPTH = 2048, 4_000_000, 6
#: Rows of one key that one task may get; sets of a node that are compared with its first one by one task, and the parts that larger ones are dealt into.
HOT, CROWD, SALTS = 1_000_000, 512, 64
#: Ids of documents to broadcast, at most (16 bytes each).
BROADCAST_IDS = 1_000_000
_STEP = 1 << 20

_rng = np.random.default_rng(88172645463325252)
_BYTE = _rng.integers(0, 2**64, 256, np.uint64)
_MIX = _rng.integers(0, 2**64, SKETCH, np.uint64) | np.uint64(1)
_XOR = _rng.integers(0, 2**64, SKETCH, np.uint64)
_ORDER = _rng.integers(0, 2**64, WORDS, np.uint64) | np.uint64(1)
_SHORT = _rng.integers(0, 2**64, WORDS, np.uint64)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased texts, one after another, and the number of words of each."""
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    white = _WHITE[data]
    prev = np.append(True, white[:-1])
    s, e = np.flatnonzero(~white & prev), np.flatnonzero(white & ~prev)
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    h = mixed((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    return h, np.diff(np.searchsorted(s, ends), prepend=0)


def parts(raw: bytes) -> list[bytes]:
    """A long text, cut at white space into steps of about a megabyte."""
    if len(raw) <= _STEP:
        return [raw]
    out, lo = [], 0
    while len(raw) - lo > _STEP:
        hi = lo + _STEP
        while hi < len(raw) and not _WHITE[raw[hi]]:
            hi += 1
        out.append(raw[lo:hi])
        lo = hi
    return [*out, raw[lo:]]


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    lo = 0
    raw = [parts(t.encode("utf-8", "replace").lower()) for t in texts]
    while lo < len(raw):
        hi, size, flat, owner = lo, 0, [], []
        while hi < len(raw) and (hi == lo or size + sum(map(len, raw[hi])) < _STEP):
            size += sum(map(len, raw[hi])) + 1
            flat += raw[hi]
            owner += [hi - lo] * len(raw[hi])
            hi += 1
        if len(flat) > hi - lo:  # a long text: its steps' words one after another
            got = [word_hashes([x]) for x in flat]
            h = np.concatenate([g[0] for g in got])
            n = np.bincount(owner, [len(g[0]) for g in got], hi - lo).astype(np.int64)
        else:
            h, n = word_hashes(flat)
        k = max(len(h) - WORDS + 1, 0)
        s = np.zeros(k, np.uint64)
        for j in range(WORDS):
            s += h[j : j + k] * _ORDER[j]
        s = mixed(s)
        ends = np.cumsum(n)
        for a, b in zip((ends - n).tolist(), ends.tolist()):
            if b - a >= WORDS:
                x = np.sort(s[a : b - WORDS + 1])
                out.append(x[np.append(True, x[1:] != x[:-1])])
            elif b > a:
                out.append(mixed((h[a:b] * _ORDER[: b - a]).sum(keepdims=True, dtype=np.uint64) + _SHORT[b - a]))
            else:
                out.append(np.empty(0, np.uint64))
        lo = hi
    return out


def signatures(sets: list[np.ndarray]) -> dict:
    """Size, identity, branching minima and sketch of each set."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    full = np.flatnonzero(n)
    ident = np.zeros(len(sets), np.uint64)
    minima = np.zeros((len(sets), SKETCH), np.uint64)
    lo = 0
    while lo < len(full):  # a quarter of a million shingles at a time stay in the cache
        hi, size = lo, 0
        while hi < len(full) and (hi == lo or size + n[full[hi]] <= 1 << 18):
            size += n[full[hi]]
            hi += 1
        own = full[lo:hi]
        flat = np.concatenate([sets[i] for i in own])
        cuts = np.append(0, np.cumsum(n[own])[:-1])
        ident[own] = mixed(np.add.reduceat(mixed(flat ^ np.uint64(0x5851F42D4C957F2D)), cuts) + n[own].astype(np.uint64))
        for c in range(SKETCH):
            minima[own, c] = np.minimum.reduceat((flat ^ _XOR[c]) * _MIX[c], cuts)
        lo = hi
    keys = minima[:, :KEYS].astype(np.int64)
    counts = np.where(n > 0, KEYS, 0)
    short = (mixed(minima) >> np.uint64(56)).astype(np.uint8)
    return {
        "n": pa.array(n),
        "sid": pa.array(ident.astype(np.int64)),
        "keys": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(keys[n > 0].ravel())),
        "sketch": binaries(short.ravel(), np.arange(1, len(sets) + 1) * SKETCH),
    }


def sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH)


def joined(rows: DataFrame, one: DataFrame, key: str, size: str, most: int) -> DataFrame:
    """``rows``, of which there are at most ``most``, joined on ``key`` with ``one``, which has a row for each key and how many rows hold it as ``size``.

    The rows of a key that more than HOT hold stay where they are, and the
    other side's row is broadcast, so that no key lands in one task. There is
    at most one such key for every HOT rows; up to HOT rows in all there is none.
    """
    if most <= HOT:
        return rows.join(one, key)
    one = cut(one)
    hot = one.where(F.col(size) > HOT).select(key)
    n = hot.count()
    if not n or n > BROADCAST_IDS:
        return rows.join(one, key)
    hot = F.broadcast(hot)
    return rows.join(F.broadcast(one.join(hot, key, "left_semi")), key).unionByName(rows.join(hot, key, "left_anti").join(one, key))


def with_first(pairs: DataFrame, one: DataFrame) -> DataFrame:
    """The pairs (a, b, salt) with the row (a, ...) of their first set, of which each salt gets a copy: a crowd's pairs have several."""
    return pairs.join(pairs.select("a", "salt").distinct().join(one, "a"), ["a", "salt"])


def alike(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b, salt) of set ids whose sketches and sizes leave a link possible."""
    own = reps.select("sid", "n", "sketch")
    left = own.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka"))
    right = own.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
    both = with_first(pairs, left).join(right, "b").where((F.col("na") * 100 >= F.col("nb") * 75) & (F.col("nb") * 100 >= F.col("na") * 75)).select("a", "b", "salt", "ka", "kb")

    def keep(batches):
        for t in batches:
            if t.num_rows:
                ok = (sketches(t.column(3)) == sketches(t.column(4))).sum(1) >= LEAST_EQUAL
                yield pa.RecordBatch.from_arrays(t.columns[:3], names=["a", "b", "salt"]).filter(pa.array(ok))

    return both.mapInArrow(keep, "a long, b long, salt int")


def confirmed(pairs: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of pairs (a, b, salt) whose full sets have 100 * intersection >= 75 * union."""
    ids = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    held = text_of(ids, reps, texts)
    right, left = held.select(F.col("sid").alias("b"), F.col("_text").alias("tb")), held.select(F.col("sid").alias("a"), F.col("_text").alias("ta"))
    rows = with_first(pairs, left).join(right, "b").select("a", "b", "ta", "tb")

    def check(batches):
        last, own = None, None
        for t in batches:
            a, b, tb = t.column(0).to_pylist(), t.column(1).to_pylist(), t.column(3)
            ok = []
            for lo in range(0, len(a), 256):
                part = shingle_sets(tb.slice(lo, 256).to_pylist())
                for i, y in enumerate(part, lo):
                    text = None
                    if a[i] != last:
                        text = t.column(2)[i].as_py()
                        last, own = a[i], shingle_sets([text])[0]
                    ok.append(linked(own, y))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return rows.mapInArrow(check, "a long, b long").distinct()


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    if not len(x) or not len(y):
        return False
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    common = int((y[at] == x).sum())
    return 100 * common >= 75 * (len(x) + len(y) - common)


def components(edges: DataFrame) -> DataFrame:
    """(sid, comp) of all ends of the edges (a, b): comp is the least id that can be reached. Alternates large and small stars.

    The edges are done when they form stars: each end has either one
    neighbour, a smaller one, or none but larger ones.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct())
    while True:
        way = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(way.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c")))
        open_, most = least.agg(F.count_if((F.col("m") < F.col("a")) & (F.col("c") > 1)), F.coalesce(F.sum("c"), F.lit(0))).collect()[0]
        if not open_:
            break
        least = least.select("a", F.least("a", "m").alias("m"), "c")
        large = joined(way.where(F.col("b") > F.col("a")), least, "a", "c", most).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large) if most > HOT else large
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c"))
        small = joined(large, low, "a", "c", most).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct()
        edges = cut(small)
        way = least = large = low = small = None
        tidy(edges.sparkSession)
    return edges.select(F.col("a").alias("sid"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("sid"), F.col("b").alias("comp")).distinct())


def _by_node(t) -> tuple:
    """The columns of a table of rows (node, sid, comp, n, sketch), sorted by node, and where each node begins and ends."""
    node = t.column("node").to_numpy()
    order = np.argsort(node, kind="stable")
    node = node[order]
    cuts = np.flatnonzero(np.append(True, node[1:] != node[:-1])).tolist()
    k = sketches(t.column("sketch"))[order]
    return order, node, t.column("sid").to_numpy()[order], t.column("comp").to_numpy()[order], t.column("n").to_numpy()[order], k, np.ascontiguousarray(k[:, :FIRST]), list(zip(cuts, [*cuts[1:], len(node)]))


def _candidates(i: int, hi: int, comp, n, k, first) -> np.ndarray:
    """The later rows of row i's node, up to hi, that lie in another component and could be linked with it."""
    rest = slice(i + 1, hi)
    j = np.flatnonzero((comp[rest] != comp[i]) & (n[rest] * 100 >= n[i] * 75) & (n[i] * 100 >= n[rest] * 75)) + i + 1
    if len(j):
        j = j[(first[j] == first[i]).sum(1) >= LEAST_FIRST]
        j = j[(k[j] == k[i]).sum(1) >= LEAST_EQUAL]
    return j


def _tasks(rows: DataFrame, per_task: int, shingles: int) -> DataFrame:
    """The rows, grouped so that a group has whole nodes, of about ``per_task`` sets and ``shingles`` shingles."""
    n, weight = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).collect()[0]
    return rows.withColumn("task", F.pmod(F.xxhash64("node"), F.lit(max(1, -(-n // per_task), -(-weight // shingles))))).groupBy("task")


def compare_nodes(rows: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) within the nodes of rows (node, sid, comp) between sets of different components, as many as join these.

    Sketches first leave only the sets that could be linked with another of
    their node; with the texts of these every such pair is compared in full,
    but for pairs that links of the node have joined already.
    """
    rows = rows.select("node", "sid", "comp").join(reps.select("sid", "n", "sketch"), "sid")

    def alike_rows(key, t):
        order, node, sid, comp, n, k, first, nodes = _by_node(t)
        hit = np.zeros(len(node), bool)
        for lo, hi in nodes:
            for i in range(lo, hi - 1):
                j = _candidates(i, hi, comp, n, k, first)
                if len(j):
                    hit[i] = hit[j] = True
        return pa.table({"node": pa.array(node[hit]), "sid": pa.array(sid[hit]), "comp": pa.array(comp[hit])})

    live = cut(_tasks(rows, 20_000, 1 << 62).applyInArrow(alike_rows, "node long, sid long, comp long"))
    held = text_of(live.select("sid").distinct(), reps, texts)
    full = live.join(reps.select("sid", "n", "sketch"), "sid").join(held, "sid")

    def links(key, t):
        order, node, sid, comp, n, k, first, nodes = _by_node(t)
        column = t.column("_text").take(pa.array(order))
        a, b = [], []
        for lo, hi in nodes:
            sets = shingle_sets(column.slice(lo, hi - lo).to_pylist())
            own = comp[lo:hi].copy()  # components as far as this node's links join them
            for i in range(hi - lo - 1):
                for j in (_candidates(lo + i, hi, comp, n, k, first) - lo).tolist():
                    if own[i] != own[j] and linked(sets[i], sets[j]):
                        a.append(sid[lo + i])
                        b.append(sid[lo + j])
                        own[own == own[j]] = own[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _tasks(full, 4_000, LIGHT).applyInArrow(links, "a long, b long")


def text_of(ids: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """(sid, _text) of the set ids; the texts are not dealt anew where the ids are few enough to broadcast."""
    wanted = cut(ids.join(reps.select("sid", F.col("rep._id").alias("_id"), F.col("rep.text_hash").alias("text_hash")), "sid"))
    few = wanted.count() <= BROADCAST_IDS
    return texts.join(F.broadcast(wanted) if few else wanted, ["_id", "text_hash"]).select("sid", "_text").dropDuplicates(["sid"])


def several(rows: DataFrame, at_least: int, most: int) -> DataFrame:
    """The rows (node, sid, comp, n) of nodes that hold several components, with the sets and the shingles of their node as ``c`` and ``weight``."""
    nodes = rows.groupBy("node").agg(F.count("*").alias("c"), F.sum("n").alias("weight"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where((F.col("lo") < F.col("hi")) & (F.col("c") >= at_least)).select("node", "c", "weight")
    return joined(rows, nodes, "node", "c", most).select("node", "sid", "comp", "n", "c", "weight")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept, text_hash, stays of every row.

    A document without words (or with a null text) has an empty set and is
    linked with nothing. A row with a null id takes no part; its component is
    null and it is kept. component_id is the smallest id that links reach,
    kept whether it is the row's own; rows that repeat an id with one text
    are all kept or all not. Rows that repeat an id with other texts are
    documents of their own, each in the component of its text. ``stays`` is
    true for the rows of one id and text of each component, those of the
    smallest id and then the smallest text_hash (a hash of the text). An empty
    table gives no rows. Other columns are dropped.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text")).withColumn("text_hash", F.xxhash64(F.coalesce("_text", F.lit(""))))

    def start():
        return lambda t: signatures(shingle_sets(t))

    signed = cut(map_docs(texts, start, "n long, sid long, keys array<long>, sketch binary", "_id", "_text", carry=("text_hash",)))
    own = F.struct("_id", "text_hash")
    reps = cut(signed.where((F.col("n") > 0) & F.col("_id").isNotNull()).groupBy("sid").agg(F.min(own).alias("rep"), F.count("*").alias("copies"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys"), F.any_value("sketch").alias("sketch")))
    entry = reps.select("sid", "n", F.posexplode(F.slice("keys", 1, TREES * BRANCH)).alias("pos", "key")).select("sid", "n", F.xxhash64("pos", "key").alias("node"))
    nodes = entry.groupBy("node").agg(F.count("*").alias("c"), F.min("sid").alias("pivot")).where(F.col("c") > 1)
    sets = reps.count()
    entry = cut(joined(entry, nodes, "node", "c", TREES * BRANCH * sets))
    # one comparison for each set of a node, with the node's first set
    salt = F.when(F.col("c") > CROWD, F.pmod(F.xxhash64("sid", F.lit("salt")), F.lit(SALTS))).otherwise(0).cast("int")
    stars = entry.where(F.col("sid") != F.col("pivot")).groupBy(F.col("pivot").alias("a"), F.col("sid").alias("b")).agg(F.max(salt).alias("salt"))
    links = cut(confirmed(cut(alike(stars, reps)), reps, texts))
    del stars
    comps = components(links)
    # nodes that still hold several components (of two sets, both have been compared)
    rows = entry.where(F.col("c") > 2).select("node", "sid", "n").join(comps, "sid", "left").select("node", "sid", F.coalesce("comp", "sid").alias("comp"), "n")
    rows = cut(several(rows, 3, TREES * BRANCH * sets))
    more = None
    for level in range(DEPTH + 1):
        fits = (F.col("c") <= SMALL) & (F.col("weight") <= LIGHT)
        pairs = cut(compare_nodes(rows.where(fits), reps, texts))
        more = pairs if more is None else more.unionByName(pairs)
        tidy(docs.sparkSession)
        hot = rows.where(~fits)
        if hot.isEmpty():
            break
        if level == DEPTH:  # what no level could part: every two blocks of a node are a node of their own
            blocks = F.greatest(F.ceil(F.col("c") / (SMALL // 2)), F.ceil(F.col("weight") / (LIGHT // 2))).cast("int")
            block = F.pmod(F.xxhash64("sid", F.lit("block")), blocks).cast("int")
            split = hot.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            split = split.withColumn("node", F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")))
            more = more.unionByName(cut(compare_nodes(split, reps, texts)))
            break
        turn = F.explode(F.array(*[F.lit(i) for i in range(BRANCH)]))
        child = hot.join(reps.select("sid", "keys"), "sid").withColumn("turn", turn).withColumn("coord", F.pmod(F.xxhash64("node", "turn", F.lit(level)), F.lit(KEYS)).cast("int"))
        child = child.select(F.xxhash64("node", "turn", "coord", F.element_at("keys", F.col("coord") + 1)).alias("node"), "sid", "comp", "n")
        rows = cut(several(child, 2, BRANCH * hot.count()))
    if not more.isEmpty():
        comps = components(comps.select(F.col("sid").alias("a"), F.col("comp").alias("b")).unionByName(more))
    # the least row of each component; most sets are alone
    members = reps.select("sid", "rep").join(comps, "sid")
    least = members.groupBy("comp").agg(F.min("rep").alias("least"), F.count("*").alias("c"))
    found = joined(members, least, "comp", "c", sets).select("sid", "least")
    of = reps.select("sid", "rep", "copies").join(found, "sid", "left").select("sid", F.coalesce("least", "rep").alias("least"), "copies")
    linked_rows = signed.where((F.col("n") > 0) & F.col("_id").isNotNull()).select("_id", "n", "text_hash", "sid")
    out = joined(linked_rows, of, "sid", "copies", signed.count())
    alone = signed.where((F.col("n") == 0) | F.col("_id").isNull()).select("_id", "n", "text_hash", own.alias("least"))
    out = out.select("_id", "n", "text_hash", "least").unionByName(alone)
    component = F.col("least._id")
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"), "text_hash", (F.col("_id").isNull() | (own == F.col("least"))).alias("stays"))
