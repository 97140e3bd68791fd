"""Filter audit, quality rules and the prefix trie against plain loops."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from likeness.llm import filter_audit, prefix_trie, quality_rules

DOCS = "doc_id long, text string, lang string, part string, digest string, mask int, _t string, _words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def doc(i, text, lang="en"):
    return (i, text, lang, "p", "d", 1, "t", "w")


def corpus(seed=5, n=300):
    r = random.Random(seed)
    words = ["the", "and", "Of", "NASA", "x%", "y|z", "café", "\U0001f600", "und", "-", "a.b", "wait..."]
    texts = [r.choice([" ", "\n", "\t"]).join(r.choice(words) for _ in range(r.choice([0, 1, 7, 8, 9, 30, 130]))) for _ in range(n)]
    texts += ["the and " * 60, "one two three four five six seven eight\n" * 3, "", "\n\n", "a b c d e f g h a b c d e f g h i"]
    rows = [doc(i, t, r.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    rows += [doc(1000 + i, r.choice(texts), "fr") for i in range(60)]
    rows += [doc(None, texts[0]), doc(None, texts[1], None), doc(7, None), doc(8, None, None), rows[3], rows[3], doc(3, "other words"), doc(2000, "long " * 40_000)]
    return rows


def test_audit_equals_running_every_order(spark):
    rows = corpus()
    labels = [(i % 90, q, t) for i, (q, t) in enumerate([(1, 0), (0, 1), (1, 1), (0, 0), (None, 1)] * 30)] + [(None, 1, 1), (5000, 1, 1), (1003, 1, 1)]
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    parts = defaultdict(list)
    for i, t, lang, *_ in rows:
        t, words = t or "", WORD.findall(t or "")
        f = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i,
        }
        parts[lang or ""].append(({k for k, v in f.items() if v}, i in good, i in toxic))
    want = {}
    for part, docs in parts.items():
        total, steps = Counter(), []
        for order in permutations("ABCDE"):
            alive = list(docs)
            for step, x in enumerate(order, 1):
                gone = [d for d in alive if x in d[0]]
                alive = [d for d in alive if x not in d[0]]
                early = [d for d in docs if x in d[0] and d[0] & set(order[: step - 1])]
                total[x] += len(gone)
                steps.append(((part, "".join(order), step), x, (len(alive), len(gone), len(early), sum(d[0] == {x} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone))))
        want |= {key: (*values, total[x]) for key, x, values in steps}
    got = filter_audit.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 600 * len(parts) and {tuple(r[:3]): tuple(r[3:]) for r in got} == want


def test_audit_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark.createDataFrame([], DOCS), none).count() == 0
    got = filter_audit.audit(spark.createDataFrame([doc(1, "a")], DOCS), none).collect()
    assert len(got) == 600 and {r.good_lost for r in got} == {0} and {r.removed for r in got if r.filter_order[r.step - 1] == "A"} == {0, 1} - {0}


def plain_measures(t):
    words, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
    seen = defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))


def test_rules_equal_plain_counts(spark):
    rows = corpus(9, 400)
    got = quality_rules.judged(spark.createDataFrame(rows, DOCS), keep_row=True).collect()
    assert len(got) == len(rows)
    for r in got:
        n, *_, repeats = base = plain_measures(r._row.text)
        assert tuple(r[c] for c in quality_rules.BASE_MEASURES) == base, r._row.text
        assert r.base_failed == (n < 20 or 100 * repeats > 30 * n) and (not r.kept or not r.base_failed)
        assert r.kept == (not r.failed)


def test_rules_table_decides(spark):
    clean = " ".join(f"the word{i} and other{i} of thing{i}." for i in range(30))
    texts = [clean, clean.replace(" ", "%% "), clean.upper().replace(" ", "!! "), "\n".join(f"- the item{i} of it" for i in range(40)), clean.replace("the", "zzz").replace("and", "zzy").replace("of", "zzx"), None]
    docs = spark.createDataFrame([doc(i, t) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.failed for r in quality_rules.judged(docs).collect()}
    assert got[0] == [] and "symbols" in got[1] and {"shouting", "capitals"} <= set(got[2]) and got[3] == ["bullet_lines"] and "no_stop_words" in got[4] and "few_words" in got[5]
    strict = quality_rules.judged(docs, rules=(quality_rules.Rule("tiny", 1, "n_words", ">", 50),), base=())
    assert {r.doc_id: r.kept for r in strict.collect()} == {0: False, 1: False, 2: False, 3: False, 4: False, 5: True}
    assert quality_rules.judged(spark.createDataFrame([], DOCS)).count() == 0


def test_rules_run_without_python(spark):
    plan = quality_rules.judged(spark.createDataFrame([doc(1, "a")], DOCS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    said = {c: [x[1:] for x in sorted(v)] for c, v in convs.items()}
    made = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(said.get(c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20)), [])[:h] + said[c][h:])
    nodes = defaultdict(list)
    for c, path in made.items():
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
    out = set()
    cost = {p: (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0 for p, m in nodes.items()}
    kids = Counter(p[:-1] for p in nodes if p)
    for p, m in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in m if len(made[c]) == len(p))))
        out.add((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], sum(not kids[q] for q in under), sum(cost[q] for q in under), hashlib.sha256(ends.encode()).hexdigest()))
    return out


CONVS = "conv_id long, turn long, role string, text string, family long, rank long, key string"


def chats(seed=3):
    r = random.Random(seed)
    rows = []
    for c in [*range(0, 130), *range(400, 431), -1, -7, -19, -20, -45, 2**40, 2**40 + 3]:
        if c % 40 == 20:
            continue  # families without their base
        for t in range(r.choice([0, 1, 2, 3, 4, 9])):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["hi", "hi there", "", None, f"word {r.randint(0, 3)}"]), 1, 2, "k"))
    rows += [(0, t, "user", f"turn {t}", 1, 2, "k") for t in range(9)]
    rows += [(60, None, "user", "before all", 1, 2, "k"), (60, 0, "user", "tie", 1, 2, "k"), (60, 0, "bot", "tie", 1, 2, "k"), (None, 0, "user", "nobody", 1, 2, "k")]
    rows += [(c, t, "user", f"same start {t}", 1, 2, "k") for c in range(1000, 1400) for t in range(3)]
    rows += [rows[0], rows[0]]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("large", [prefix_trie.LARGE, 30, 0])
def test_trie_equals_plain_loops(spark, large, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 2)
    rows = chats()
    got = prefix_trie.trie(spark.createDataFrame(rows, CONVS), large=large).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == plain_trie(rows)


def test_trie_of_odd_tables(spark):
    assert prefix_trie.trie(spark.createDataFrame([], CONVS)).count() == 0
    only = [(21, 0, "user", "hi", 1, 2, "k")]  # takes two turns of a base that is absent
    for large in (0, 10):
        assert {tuple(r) for r in prefix_trie.trie(spark.createDataFrame(only, CONVS), large=large).collect()} == plain_trie(only)
