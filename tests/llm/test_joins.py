"""Vector searches, near-duplicates and the pipeline, against brute force."""

import random

import numpy as np
import pytest

from likeness.llm import exact_topk, near_dup, neighbours


def rows_of(x, ids=None):
    return [(int(i), [float(c) for c in v], "z") for i, v in zip(ids if ids is not None else range(len(x)), x)]


SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(x, ids, k, score):
    out = {}
    for a, i in enumerate(ids):
        if i % 50 == 0:
            s = sorted((-score(x[a], x[b]), j) for b, j in enumerate(ids) if j != i)[:k]
            out[i] = [(j, -v) for v, j in s]
    return out


def test_exact_topk_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 6)).astype(np.float32)
    x[100:300] = x[100]  # a crowd of copies
    ids = [*range(700)]
    extra = [(1000, None, "n"), (1050, [], "e"), (1100, [float("nan")] * 6, "x"), (None, [1.0] * 6, "i"), (1150, [float("inf")] + [0.0] * 5, "f")]
    df = spark.createDataFrame(rows_of(x, ids) + extra, SCHEMA)
    got = {}
    for r in exact_topk.search(df, shard_rows=128).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    q = np.floor(x.astype(float) * 256).astype(int)
    want = brute(q, ids, 5, lambda a, b: int(a @ b))
    assert {i: [(j, s) for _, j, s in sorted(v)] for i, v in got.items()} == want


def test_exact_topk_of_little_and_large(spark):
    df = spark.createDataFrame(rows_of(np.eye(3)), SCHEMA)
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in exact_topk.search(df).orderBy("rank").collect()] == [(0, 1, 1, 0), (0, 2, 2, 0)]
    assert exact_topk.search(df.limit(0)).count() == 0
    big = spark.createDataFrame([(0, [3e9, 1.0]), (1, [3e9, 2.0]), (2, [-3e9])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in exact_topk.search(big).orderBy("rank").collect()] == [1, 2]


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 12)).astype(np.float32)
    x[200:400] = x[200]
    ids = [*range(1500)]
    df = spark.createDataFrame(rows_of(x, ids) + [(2000, [0.0] * 12, "0"), (2050, None, "n")], SCHEMA)
    got = {}
    for r in neighbours.search(df, shard_rows=400, rounds=2).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    u = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = brute(u, ids, 5, lambda a, b: float(a @ b))
    hit = sum(len({j for j, _ in want[i]} & {j for _, j, _ in v}) for i, v in got.items())
    assert set(got) == set(want) and hit >= 0.95 * 5 * len(want)
    assert [j for _, j, _ in sorted(got[250])] == [200, 201, 202, 203, 204]
    assert all(len(v) == 5 for v in got.values())


def test_exact_topk_beyond_doubles(spark):
    r = random.Random(8)
    odd = lambda: float(r.choice([-1, 1]) * (2**r.randint(20, 30) + r.randint(0, 3)))  # noqa: E731  scores beyond 2^53 that differ by little
    vs = [[odd() for _ in range(4)] for _ in range(300)]
    assert exact_topk.exact_dot(np.array([[2.0**27 + 1, 1.0]]), np.array([[2.0**27 + 1, 1.0]]))[0, 0] == (2**27 + 1) ** 2 + 1
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "vec_id long, embedding array<double>")
    got = {}
    for x in exact_topk.search(df, scale=1, shard_rows=60).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    ints = [[int(x) for x in v] for v in vs]
    for q in range(0, 300, 50):
        want = sorted((-sum(a * b for a, b in zip(ints[q], ints[i])), i) for i in range(300) if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]


def test_searches_with_repeated_ids_and_odd_vectors(spark):
    """Of rows that repeat an id each counts, but never for its own id."""
    r = np.random.default_rng(3)
    rows = [(int(i), [float(c) for c in r.integers(-3, 4, 5)]) for i in [*range(120), 0, 0, 50, 7, 7, 100]]
    odd = [(150, [float("nan"), 1.0]), (200, [None, 1.0]), (250, [float("-inf"), 0.0]), (300, None), (350, []), (None, [1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + odd], "vec_id long, embedding array<double>, query_id string, rank int")
    got = {}
    for x in exact_topk.search(df, scale=1, shard_rows=30).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    for q in (0, 50, 100):
        own = [v for i, v in rows if i == q]
        want = sorted((-int(np.dot(a, b)), i) for a in own for i, b in rows if i != q)[:5]
        assert [(i, -s) for s, i in want] == [(i, s) for _, i, s in sorted(got[q])]
    assert set(got) == {0, 50, 100}
    near = neighbours.search(df, shard_rows=64).collect()
    assert {x.query_id for x in near} == {0, 50, 100} and all(x.vec_id != x.query_id and -1 <= x.score <= 1 for x in near)


def test_neighbours_of_few(spark):
    df = spark.createDataFrame(rows_of(np.eye(3)), SCHEMA)
    assert [(r.query_id, r["rank"], r.vec_id) for r in neighbours.search(df).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert neighbours.search(df.limit(0)).count() == 0


def shingles(t):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_classes(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed, n=120):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(40)]
    rows, base = [], []
    for i in range(n):
        if base and r.random() < 0.5:
            w = list(r.choice(base))
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(r.randint(1, 60))] + (passage if r.random() < 0.4 else [])
        base.append(w)
        rows.append((i * 7 % 1009, " ".join(w) if r.random() < 0.8 else "\t".join(w).upper()))
    return rows + [(2000, None), (2001, ""), (2002, " \n "), (2003, "one"), (2004, "ONE"), (2005, "one two")]


@pytest.mark.parametrize(("small", "light", "hot"), [(2048, 4_000_000, 1_000_000), (8, 300, 12)])
def test_classes_equal_brute_force(spark, monkeypatch, small, light, hot):
    for name, value in (("SMALL", small), ("LIGHT", light), ("HOT", hot), ("CROWD", hot), ("DEPTH", 1 if small == 8 else 6)):  # nodes split by sets and by shingles, keys held hot
        monkeypatch.setattr(near_dup, name, value)
    rows = corpus(3, 120 if small > 8 else 40)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, kept int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.classes(df).collect()}
    assert got == plain_classes(rows)


def test_classes_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (3, "A B C D E F"), (9, "x " * 3000)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dup.classes(df).collect()), key=str)
    assert got == sorted([(None, None, True), (5, 3, False), (5, 3, False), (3, 3, True), (9, 9, True)], key=str)
    assert near_dup.classes(df.limit(0)).count() == 0


def test_one_row_of_each_group_by_row(spark):
    import corpus_pipeline as P

    other, third = "z y x w v u t s", "q r s t u v w x"
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "x"), (2, other, "x"), (3, other, "y"), (3, third, "y"), (4, third, "k"), (4, third, "k"), (4, third, "j"), (None, third, "n"), (None, None, "n"), (5, None, "o"), (5, None, "p"), (6, "", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `my col` string")
    got = sorted(((r[0], r[1]) for r in P.one_of_each(spark, df, "").collect()), key=str)
    assert got == sorted([(1, "a b c d e f"), (2, other), (3, third), (None, third), (None, None), (5, None), (6, "")], key=str)
    same = spark.createDataFrame([(7, "a b c d e f", "x")] * 5 + [(8, "A b c d e f", "x")] * 2, "doc_id long, text string, stays string")
    assert [tuple(r) for r in P.one_of_each(spark, same, "").collect()] == [(7, "a b c d e f", "x")]
    assert P.one_of_each(spark, df.limit(0), "").count() == 0 and P.one_of_each(spark, df, "").columns == df.columns


def test_long_text_has_the_same_shingles(monkeypatch):
    t = " ".join(f"w{i % 97}x{i % 31}" for i in range(3000))
    whole = near_dup.shingle_sets([t, "short text of six words here"])
    monkeypatch.setattr(near_dup, "_STEP", 500)
    cut = near_dup.shingle_sets([t, "short text of six words here"])
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, cut)) and len(whole[0]) == len(shingles(t))


def test_sketch_passes_linked_pairs():
    r = np.random.default_rng(0)
    least = []
    for _ in range(200):
        own = r.integers(0, 2**63, 300, np.uint64)
        n = 257  # of 300 and 300 shared: 257 / 343 is just above 0.749
        x, y = own, np.concatenate([own[:n], r.integers(0, 2**63, 300 - n, np.uint64)])
        s = near_dup.signatures([np.unique(x), np.unique(y)])
        k = near_dup.sketches(s["sketch"])
        least.append((k[0] == k[1]).sum())
    assert min(least) >= near_dup.LEAST_EQUAL


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200) if i != 100] + [(7, 3)], "a long, b long")
    got = {r.sid: r.comp for r in near_dup.components(edges).collect()}
    assert got == {i: 0 if i <= 100 else 101 for i in range(201)}


def test_pipeline_keeps_what_it_should(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "toxicity", "near_dup", "pii", "packing"]
    kept = P.one_of_each(spark, docs, sf)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in plain_classes(rows).items() if i == c)
    assert kept.columns == docs.columns
    clean = P.without_personal_data(spark, docs, sf)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert not clean.where("text rlike '[A-Za-z0-9]@[a-z0-9]+[.]'").count() and not clean.where("n_chars <> length(text)").count()
    out = P.run(spark, sf)
    assert out.count() > 0 and out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
