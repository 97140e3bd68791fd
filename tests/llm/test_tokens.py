import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from likeness.llm import bpe, packing, token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  a", "a  b", "don't 'really we've !!'s ''s 's's x's\n'll\t'd a'", "<|endoftext|>x<|endoftext|><|endoftext|> y", " 　a \x1c b\x85c", "ΑΣ ΣΑΣ İstanbul", "é né", "123 4५٣ ½", "aaaa aaaaaaa zzzzzz", "日本語 テキスト🙂🙂  \n\n\n x", "'", "' s", "a'S", "<|startoftext|>hi <|endoftext|>", "it's" * 5]


def noise(n, seed=0, size=60):
    r = random.Random(seed)
    return ["".join(r.choice("abst'ermdvl .,!\n\t  019éßΣ日́🙂 <|") for _ in range(r.randint(0, size))) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_equal_the_library(path):
    texts = ODD + noise(800)
    ids, ends = bpe.Encoder(bpe.Bpe(path)).encode(texts)
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == want


def test_long_text_is_cut_safely(monkeypatch):
    from likeness.llm import pretoken

    monkeypatch.setattr(pretoken, "STEP", 64)
    text = " ".join(["the   word's", "It's", "12 34", "ab"] * 60)
    ids, _ = bpe.Encoder(bpe.Bpe(BYTE)).encode([text])
    assert ids.tolist() == Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids


def test_words_are_forgotten_beyond_the_bound():
    enc = bpe.Encoder(bpe.Bpe(BYTE), keep=3)
    for _ in range(3):
        ids, ends = enc.encode(["one two three four five six", "seven"])
        assert enc.decode(ids, ends) == ["one two three four five six", "seven"]


def test_round_trip_of_rows(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, "y"), (None, "", None), (3, "z" * 50_000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id or -1), r.decoded, len(r.ids) == 4 * r.n_tokens) for r in bpe.round_trip(docs, BYTE).collect())
    assert got == sorted((i or -1, t or "", True) for i, t, _ in rows)
    assert bpe.round_trip(docs.limit(0), BYTE).count() == 0
    again = bpe.decode(bpe.encode(docs, BYTE), BYTE).collect()
    assert sorted(r.decoded for r in again) == sorted(t or "" for _, t, _ in rows)


@pytest.mark.parametrize("seed", range(6))
def test_packing_holds_every_id_once(seed):
    r = random.Random(seed)
    lengths = [r.choice([0, 1, r.randint(1, 50), r.randint(1, 400), 64, 128]) for _ in range(r.choice([0, 1, 7, 300]))]
    got = packing.pack_lengths(lengths, 64, slack=2)
    for i, n in enumerate(lengths):
        own = sorted((s, k) for j, s, k, _, _ in got if j == i)
        at = 0
        for s, k in own:
            assert s == at and k > 0
            at += k
        assert at == n
    seqs = {}
    for _, _, k, q, o in got:
        seqs.setdefault(q, []).append((o, k))
    padding = 0
    for own in seqs.values():
        at = 0
        for o, k in sorted(own):
            assert o == at
            at += k
        assert at <= 64
        padding += 0 if at & (at - 1) == 0 else 64 - at
    assert padding <= 2 * len(seqs)


def test_tightest_window():
    free = packing.OpenWindows(100)
    for w, room in enumerate([5, 9, 9, 40]):
        free.put(room, w)
    assert [free.take(6)[0], free.take(6)[0], free.take(6)[0], free.take(6), free.take(5)[0], free.take(1)] == [9, 9, 40, None, 5, None]


def test_packed_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (2, None), (3, "word " * 5000)], "doc_id long, text string")
    got = packing.pack(docs, WORD, window=128).collect()
    assert {r.doc_id: r.doc_tokens for r in got} == {1: 4, 2: 1, 3: 5001}
    assert sum(r.length for r in got) == 4 + 1 + 1 + 5001 and all(len(r.ids) == 4 * r.length for r in got)
    assert packing.pack(docs.limit(0), WORD).count() == 0


def test_packing_of_odd_columns(spark):
    schema = "doc_id long, text string, start string, length int, sequence_id string, ids string, doc_tokens string"
    rows = [(1, "a b", "s", 1, "q", "i", "d"), (1, "a b", "s", 1, "q", "i", "d"), (None, "c", None, None, None, None, None), (2, None, None, None, None, None, None)]
    got = packing.pack(spark.createDataFrame(rows, schema), WORD, window=16).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in got) == [(0, 2), (1, 3), (1, 3), (2, 1)]


@pytest.mark.parametrize("seed", range(4))
def test_counts_after_edits_equal_a_full_count(seed):
    r = random.Random(seed)
    words = ["the", "word's", "It", "12", "ab", "'re", "\n", "  ", "é", "x'", "r", "e", "end,", "日"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 40))) for _ in range(60)] + noise(60, seed) + ODD
    edits = [[(r.randint(0, 80), r.choice([0, 0, 1, 3, 200]), r.choice(["", "e", " ", "re", "'s", " new words here ", "'", "\n"])) for _ in range(r.randint(0, 6))] for _ in texts]
    enc = bpe.Encoder(bpe.Bpe(BYTE))
    got = token_counts.count_chunk(enc, texts, edits)
    t = Tokenizer.from_file(BYTE)
    size = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    after = [token_counts.edited(x, e) for x, e in zip(texts, edits)]
    assert got["n_tokens"].tolist() == [size(x) for x in texts]
    assert got["n_tokens_after"].tolist() == [size(x) for x in after]
    assert got["n_chars_after"].tolist() == [len(x) for x in after]


SCRIPTS = {
    "japanese": "本日は晴天なり今日も良い天気ですね東京都に住んでいる人々は毎日電車で会社へ通い",
    "japanese_marks": "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。",
    "cyrillic": "съешьжеещёэтихмягкихфранцузскихбулокдавыпейчаю",
    "cyrillic_words": "Все счастливые семьи похожи друг на друга, каждая несчастливая. ",
    "code": "for(i=0;i<n;++i){a[i]=b[i]*c+=d_e(f->g);}",
    "digits": "31415926535897932384626433832795028841971",
    "markup": '<div class="a|b"><p id=7>x|y</p></div>',
    "marks": "=-=-=-~~~~....!!!!",
    "white": " " * 37 + "\n",
    "one_word": "abcdefghijklmnopqrstuvwxyz",
    "joined": "e\u0301👩‍👩‍👧‍👦ﷺ",
}


@pytest.mark.parametrize("script", SCRIPTS)
def test_an_edit_costs_little_in_any_script(script):
    r = random.Random(len(script))
    enc = bpe.Encoder(bpe.Bpe(BYTE))
    t = Tokenizer.from_file(BYTE)
    size = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    bits = ["", "7", "本", "xy", " ", "'s", "'", ".", "ж", "\n", "<|endoftext|>", "ing", "00"]
    text = (SCRIPTS[script] * 400)[:4000]
    edits = [[(r.randint(0, 4000), r.choice([0, 1, 3]), r.choice(bits))] for _ in range(60)] + [[(2000, 0, "")], [(0, 1, "")], [(4000, 0, "x")]]
    got = token_counts.count_chunk(enc, [text] * len(edits), edits)
    assert got["n_tokens_after"].tolist() == [size(token_counts.edited(text, e)) for e in edits]
    assert max(got["n_chars_encoded"]) < 200, script
    many = [[(r.randint(0, 4000), r.choice([0, 1, 3, 40]), r.choice(bits)) for _ in range(r.randint(2, 25))] for _ in range(40)]
    near = [[(1990 + r.randint(0, 20), r.choice([0, 1, 2]), r.choice(bits)) for _ in range(30)] for _ in range(10)]
    got = token_counts.count_chunk(enc, [text] * 50, many + near)
    assert got["n_tokens_after"].tolist() == [size(token_counts.edited(text, e)) for e in many + near]


@pytest.mark.parametrize("seed", range(3))
def test_edits_around_special_tokens_and_cuts(seed):
    r = random.Random(seed)
    enc = bpe.Encoder(bpe.Bpe(BYTE))
    t = Tokenizer.from_file(BYTE)
    size = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    bits = ["<|endoftext|>", "<|", "|>", "endof", "text", " ", "  ", "\n", "a", "'re", "'", "12", "本日", "." * 60, "z" * 70, "é", "<"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(150)]
    edits = [[(r.randint(0, 300), r.choice([0, 1, 2, 5, 13, 90]), r.choice(["", *bits])) for _ in range(r.randint(1, 8))] for _ in texts]
    got = token_counts.count_chunk(enc, texts, edits)
    assert got["n_tokens"].tolist() == [size(x) for x in texts]
    assert got["n_tokens_after"].tolist() == [size(token_counts.edited(x, e)) for x, e in zip(texts, edits)]
    assert got["n_chars_after"].tolist() == [len(token_counts.edited(x, e)) for x, e in zip(texts, edits)]


def test_counts_of_odd_tables(spark):
    schema = "doc_id long, text string, edits array<struct<at:long,delete:long,insert:string>>, n_tokens string, _text string, _edits int"
    rows = [(1, "a b", [(1, 0, "x"), None, (None, None, None)], "n", "t", 1), (1, "a b", [(1, 0, "x"), None, (None, None, None)], "n", "t", 1), (None, None, None, None, None, None)]
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_edits, r.n_tokens_after) for r in token_counts.count_edits(spark.createDataFrame(rows, schema), BYTE).collect())
    assert got == [(0, 0, 0, 0), (1, 2, 2, 2), (1, 2, 2, 2)]
    assert token_counts.count_edits(spark.createDataFrame([], schema), BYTE).count() == 0


def test_only_regions_are_encoded(spark):
    docs = spark.createDataFrame([(1, "plain words " * 1000, [(600, 0, " new")]), (2, None, [(0, 5, "x")]), (3, "abc", None)], "doc_id long, text string, edits array<struct<at:long,delete:long,insert:string>>")
    got = {r.doc_id: r for r in token_counts.count_edits(docs, BYTE).collect()}
    assert got[1].n_chars_encoded < 60 and got[1].n_tokens_after > got[1].n_tokens
    assert (got[2].n_tokens, got[2].n_tokens_after, got[3].n_edits) == (0, 1, 0)
