"""Personal data, secrets, quality and toxicity."""

import base64
import json
import random
import re
import time

import numpy as np
import pytest

from likeness.llm import pii, quality, secrets, toxicity


def noise(n, alphabet, seed=0, size=80):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, size))) for _ in range(n)]


def whole_text_spans(t, field):
    """The field's spans from one chain over all pieces of the text, without numpy batches or stretches."""
    run = [m.span() for m in re.finditer(r"\S+", t)]
    if not run:
        return []
    e = pii.label_scores([t[a:b] for a, b in run], field)
    best, back = e[0] + np.where([x[0] == "I" for x in pii.LABELS], -np.inf, 0.0), []
    for row in e[1:]:
        both = best[:, None] + field.move
        back.append(both.argmax(0))
        best = both.max(0) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return pii.spans_of(t, run, np.array(path[::-1]))


def test_stretches_give_what_the_whole_text_gives():
    field = pii.trained()
    r = random.Random(9)
    bits = ["call", "mail", "ip", "jo", "x" * 300, "555-123-4567", "anna", "at", "AT", "dot", "punto", "arroba", "example", "com", "(at)", "a[at]b[dot]com", "10", "12", "host", "1.2", "v2", "\n", "é9", "word", "some", "plain", "text", "4111.1111.1111.1111"]
    texts = [" ".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(400)]
    got = pii.field_spans(texts, field)
    for t, spans in zip(texts, got):
        assert spans == whole_text_spans(t, field), t
        assert len(set(spans)) == len(spans)
    t = "call 555-123-4567 " + "w" * 52 + " 555-987-6543 now"
    assert pii.field_spans([t], field) == [[(3, 5, 17), (3, 71, 83)]]


def test_merging_many_spans_is_a_sweep():
    base = [(0, 10 * i, 10 * i + 4) for i in range(40_000)]
    more = [(3, 10 * i + 3, 10 * i + 6) for i in range(40_000)] + [(3, 10 * i + 5, 10 * i + 9) for i in range(40_000)]
    began = time.time()
    assert pii.merged(base, more) == sorted(base + more[40_000:]) and time.time() - began < 2


def test_planted_personal_data_is_caught():
    """Forms that the base patterns miss, in sentences of words that the labelled table does not have."""
    field, r = pii.trained(), random.Random(77)
    word = lambda: "".join(r.choice("ckpqwxyzj") for _ in range(r.randint(3, 9)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    forms = {"email": lambda: f"{word()} at {word()} dot com", "joined email": lambda: f"{word()}[at]{word()}[dot]org", "phone": lambda: f"{num(3)}-{num(3)}-{num(4)}", "ip": lambda: "[.]".join(str(r.randint(0, 255)) for _ in range(4))}
    cue = {"email": "mail", "joined email": "contact", "phone": "call", "ip": "host"}
    for name, make in forms.items():
        texts = [" ".join([word() for _ in range(6)] + [cue[name], make()] + [word() for _ in range(6)]) for _ in range(100)]
        assert np.mean([bool(x) for x in pii.field_spans(texts, field)]) >= 0.9, name
    clean = [" ".join([word() for _ in range(6)] + [r.choice([num(4), "v" + num(1) + "." + num(2), "20" + num(2) + "-" + num(2) + "-" + num(2), "at " + word(), num(12)])] + [word() for _ in range(6)]) for _ in range(300)]
    assert np.mean([bool(x) for x in pii.field_spans(clean, field)]) <= 0.02


def plain_pii(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        s = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and s % 10 == 0:
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_base_pii_equals_the_plain_patterns(seed):
    texts = noise(4000, "a1@.-+ 0(52", seed) + noise(2000, "0123456789 -", seed, 40) + ["x@y@d.e", "@b.c@d.e", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.4", "1" * 4000 + ".1.1.1", "é a@b.co"]
    for t in texts:
        assert sorted(pii.base_spans(t)) == sorted(plain_pii(t))


def test_field_adds_spelled_out_data_and_keeps_clean_text():
    field = pii.trained()
    cases = {"mail me: john.doe (at) example dot com please": "email", "write bob [at] site [dot] org now": "email", "call (555) 123-4567 today": "phone", "card 4111.1111.1111.1111 visa": "card"}
    for (t, kind), got in zip(cases.items(), pii.field_spans([*cases], field)):
        assert [pii.KINDS[k] for k, _, _ in got] == [kind], t
    clean = ["the 4.0 license of 2020-01-02 at home dot matrix", "order 1234567890 of 16 items", "7602ad27cf5550de1c", "meet at 10 at a cafe", "", "version 1.2.3"]
    assert pii.field_spans(clean, field) == [[] for _ in clean]


def test_field_adds_spelled_out_hosts_and_spanish_words():
    field = pii.trained()
    cases = {"the server 10 dot 0 dot 0 dot 1 is down": ("ip", "10 dot 0 dot 0 dot 1"), "see host 192[.]168[.]1[.]1 now": ("ip", "192[.]168[.]1[.]1"), "mail juan arroba correo punto com please": ("email", "juan arroba correo punto com"), "mail bob at site Dot org now": ("email", "bob at site Dot org"), "mail ana arroba lugar PUNTO net now": ("email", "ana arroba lugar PUNTO net")}
    for (t, want), got in zip(cases.items(), pii.field_spans([*cases], field)):
        assert [(pii.KINDS[k], t[s:e]) for k, s, e in got] == [want], t
    assert not pii.plausible("ip", "10 dot 0 dot 0") and not pii.plausible("ip", "1.2.3.999")


def test_viterbi_equals_all_paths():
    import itertools

    r = np.random.default_rng(0)
    k = len(pii.LABELS)
    move = r.normal(size=(k, k)) + pii.allowed()
    start = np.where([x[0] == "I" for x in pii.LABELS], -np.inf, 0.0)
    e = [r.normal(size=(n, k)) for n in (1, 2, 3, 3, 0)]
    for x, path in zip(e, pii.viterbi(e, move)):
        best = max(itertools.product(range(k), repeat=len(x)), key=lambda p: sum(x[i, y] + (move[p[i - 1], y] if i else start[y]) for i, y in enumerate(p)))
        assert tuple(path.tolist()) == best


def test_redaction():
    assert pii.redact("a b@c.de f", [(0, 2, 8)]) == "a [EMAIL] f"
    assert pii.redact("1234567890", [(2, 0, 8), (3, 4, 10)]) == "[CARD]"


def test_pii_rows(spark):
    docs = spark.createDataFrame([(1, "x a@b.co", "k"), (1, "x a@b.co", "k"), (2, None, None), (3, "word " * 30_000, "")], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert got[1].base_spans == "email:2:8" and got[1].redacted == "x [EMAIL]" and got[2].spans == "" and got[3].n_email == 0
    assert pii.find(docs).count() == 4 and pii.find(docs.limit(0)).count() == 0
    kept = pii.find(docs, keep_row=True).select("_row.*").columns
    assert kept == docs.columns


def plain_secrets(t):
    a = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in a.finditer(t) if len(m[1]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def test_base_secrets_equal_the_plain_patterns():
    r = random.Random(1)
    bits = ["password", "Token", "secret", "api_key", "APIKEY", "=", ":", " ", '"', "AKIA", "ABCDEFGH1234567", "0123456789abcdef", "abc", "ſecret", "toKen", "z"]
    for _ in range(6000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 12)))
        assert secrets.base_spans(t) == plain_secrets(t)


def test_wrapped_joined_and_headed_keys():
    rsa = der(0x30, b"".join([der(2, b"\0")] + [der(2, bytes(range(1, 60))) for _ in range(8)]))
    field = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"p" * 40) + field(b"k" * 60)
    b64 = lambda b: base64.b64encode(b).decode()
    for data, kind in ((rsa, 4), (ssh, 5)):
        for width in (64, 76):
            for end in ("\n", "\r\n"):
                lines = end.join(re.findall(f".{{1,{width}}}", b64(data)))
                for after in ("", end, end + "and more text", end + end + "x"):
                    assert secrets.confirmed_spans("key: " + lines + after) == [(5, kind, 5 + len(lines))]
        for front in ("key_", "/etc/ssl/", "my-own-"):
            assert secrets.confirmed_spans(front + b64(data) + " x") == [(len(front), kind, len(front) + len(b64(data)))]
    body = "\n".join(re.findall(".{1,64}", b64(rsa)))
    pem = lambda head, body: f"-----BEGIN RSA PRIVATE KEY-----\n{head}{body}\n-----END RSA PRIVATE KEY-----"
    locked = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC," + "0A" * 16 + "\n\n"
    for t in (pem("Comment: mine\n\n", body), pem(locked, b64(bytes(range(64))))):
        assert secrets.confirmed_spans(t) == [(0, 6, len(t))]
    for t in (pem(locked, b64(bytes(range(63)))), "key_" + b64(rsa)[:-8], "x\n".join(re.findall(".{1,64}", b64(rsa)[:-8]))):
        assert secrets.confirmed_spans(t) == []


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + body


def test_structures_are_confirmed():
    ints = [der(2, b"\0")] + [der(2, bytes(range(1, 60))) for _ in range(8)]
    rsa = der(0x30, b"".join(ints))
    pkcs8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48") + der(5, b"")) + der(4, rsa))
    field = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"p" * 40) + field(b"k" * 60)
    url = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    jwt = url(json.dumps({"alg": "HS256"}).encode()) + "." + url(b'{"sub":1}') + "." + url(b"x" * 32)
    b64 = lambda b: base64.b64encode(b).decode()
    pem = "-----BEGIN PRIVATE KEY-----\n" + "\n".join(re.findall(".{1,64}", b64(pkcs8))) + "\n-----END PRIVATE KEY-----"
    for text, kind in ((b64(rsa), "key"), (rsa.hex(), "key"), (b64(pkcs8), "key"), (b64(ssh), "sshkey"), (jwt, "jwt"), (pem, "pem")):
        t = f"see {text} end"
        assert (4, secrets.KINDS.index(kind), 4 + len(text)) in secrets.confirmed_spans(t), kind
    for text in (b64(rsa[:-3]), b64(b"M" * 60), b64(bytes(range(200))), url(b'{"a":1}') + ".e30.x", "x" * 300, "ey.ey.ey"):
        assert secrets.confirmed_spans(f"see {text} end") == []


def test_secret_rows(spark):
    docs = spark.createDataFrame([(1, "token=abcdefghijklmnop", "k"), (2, None, None)], "doc_id long, text string, n_hex string")
    got = {r.doc_id: r for r in secrets.find(docs).collect()}
    assert got[1].spans == "assign:0:22" and got[2].spans == "" and got[2].n_hex == 0


def test_quality_is_learned():
    r = random.Random(0)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    good = [" ".join(word() for _ in range(r.randint(5, 200))) for _ in range(300)]
    bad = [" ".join(word().upper() + "!!" for _ in range(r.randint(5, 200))) for _ in range(150)] + [" ".join([word()] * r.randint(20, 200)) for _ in range(150)]
    net = quality.fit(good[:200] + bad[::2] + bad[1:100:2], [1] * 200 + [0] * 200, epochs=6)
    s = net.scores(good[200:] + bad[101::2])
    assert ((s >= 0.5) == np.array([1] * 100 + [0] * (len(s) - 100))).mean() > 0.93
    assert np.isfinite(net.scores(["", "x", "y" * 300_000])).all()
    assert quality.fit([], []).scores(["a"]) == [0.5] and quality.fit(["a"], [1]).scores(["b"])[0] > 0.9


def test_network_scores_equal_plain_loops():
    """A filter at each byte, the largest response of each chunk, a dense layer, the largest of all chunks, a logistic curve."""
    m = quality.fit(["good words here"] * 3 + ["b@d !!"] * 3, [1, 1, 1, 0, 0, 0], epochs=2)
    half, width = quality.HALF, quality.WIDTH
    for t in ["", "a", "é" * 40, "some words " * 60, "\0x", "z" * (2 * half), "z" * (2 * half - width), "y" * (3 * half + 1)]:
        raw = t.encode()
        n = max(2, -(-(len(raw) + width) // half))
        data = raw.ljust(n * half, b"\0") + b"\0" * width
        d = m.embed.shape[1]
        response = np.array([[sum(float(m.embed[data[i + k]] @ m.filters[k * d : (k + 1) * d, f]) for k in range(width)) + m.fbias[f] for f in range(len(m.fbias))] for i in range(n * half)])
        best = -np.inf
        for c in range(n - 1):
            pre = np.maximum(response[c * half : (c + 2) * half].max(0), 0) @ m.dense + m.dbias
            best = np.maximum(best, np.where(pre > 0, pre, 0.01 * pre))
        want = 1 / (1 + np.exp(-(best @ m.out + m.obias[0])))
        assert abs(m.scores([t])[0] - want) < 1e-4, t


def test_gradient_of_the_network():
    rng = np.random.default_rng(1)
    p = {"embed": rng.normal(0, 0.5, (256, 3)), "filters": rng.normal(0, 0.3, (18, 4)), "fbias": np.zeros(4), "dense": rng.normal(0, 0.5, (4, 3)), "dbias": np.zeros(3), "out": rng.normal(0, 0.5, 3), "obias": np.zeros(1)}
    data, n = quality.blocks(["the cat sat" * 30, "on a mat", "AB" * 200])
    y, w = np.array([1.0, 0, 1]), np.ones(3)

    def loss():
        prob = quality.Net(**p).head(quality.Net(**p).half_maxima(data), n)[0]
        return float(-(y * np.log(prob) + (1 - y) * np.log(1 - prob)).mean())

    g = quality.gradient(p, data, n, y, w)
    for k in ("obias", "out", "dense", "fbias", "filters"):
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        was, eps = p[k][i], 1e-3
        p[k][i] = was + eps
        up = loss()
        p[k][i] = was - eps
        down = loss()
        p[k][i] = was
        assert abs((up - down) / (2 * eps) - g[k][i]) < 0.05 * abs(g[k][i]) + 1e-3, k


def test_kernel_equals_the_sum_over_subsequences():
    import itertools

    def brute(s, t, p, d):
        out = 0.0
        for a in itertools.combinations(range(len(s)), p):
            for b in itertools.combinations(range(len(t)), p):
                if all(s[i] == t[j] for i, j in zip(a, b)):
                    out += d ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
        return out

    for s, t in (("idiot", "idxiot"), ("loser", "closer"), ("abc", "abc"), ("ab", "abc"), ("aaaa", "aaa")):
        assert abs(toxicity.kernel(s, t) - brute(s, t, toxicity.ORDER, toxicity.DECAY)) < 1e-9


def plain_units(t):
    """Words of letters, with look-alikes between letters read as letters; runs of single letters joined; and the parts of words."""
    looks = "".join(map(re.escape, toxicity.LOOKS))
    out, single = [], ""
    for w in t.lower().split():
        whole = re.sub(rf"(?<=[^\W\d_])[{looks}]{{1,2}}(?=[^\W\d_])", lambda m: "".join(toxicity.LOOKS[c] for c in m[0]), w)
        whole = re.sub(r"[\W\d_]", "", whole)
        if len(whole) == 1:
            single += whole
            continue
        if whole:
            out += [single, whole]
            single = ""
        out += [p for p in re.findall(r"[^\W\d_]+", w) if p != whole]
    return [u for u in [*out, single] if len(u) >= toxicity.ORDER]


def plain_values(texts, landmarks):
    """Straight from the definition: every unit and, for landmarks of four letters or more, every stretch of it."""
    out = np.zeros((len(texts), len(landmarks)))
    for i, t in enumerate(texts):
        for j, x in enumerate(landmarks):
            for w in plain_units(t):
                parts = [w] if len(x) < toxicity.STRETCH else {w[a:b] for a in range(len(w)) for b in range(a + 3, min(len(w), a + 2 * len(x)) + 1)}
                for p in parts:
                    own = toxicity.kernel(p, p)
                    k = toxicity.kernel(p, x) / np.sqrt(own * toxicity.kernel(x, x)) if own else 0.0
                    out[i, j] = max(out[i, j], (k - toxicity.FLOOR) / (1 - toxicity.FLOOR))
    return out


def test_text_values_equal_the_definition():
    landmarks = ["abac", "bad", "abcda", "ccbbaad"]
    m = toxicity.Machine(landmarks, np.zeros(4), 0.0, 1.0, 0.0)
    texts = noise(60, "abcd abcdabcde ,.1@48 x", 5, 50) + [" ".join("abcdaabacbad"), "x" * 90 + "abxcda" + "x" * 90, "", "bad", "badly bad", "ab-acus b.a.d"]
    assert np.abs(m.text_values(texts) - plain_values(texts, landmarks)).max() < 1e-9
    assert np.abs(m.text_values(texts[::-1])[::-1] - plain_values(texts, landmarks)).max() < 1e-9  # with units known from before
    long = ["ab cd " * 100_000 + "abcda", "abcda " + "ab cd " * 100_000]
    assert np.abs(m.text_values(long) - plain_values(["abcda"], landmarks)).max() < 1e-9


def test_units():
    low, s, e, owner = toxicity.spelled(["You i d i o t!", "", "st.u.pid  ab", "É" * 60])
    words = [low[a:b].tobytes().decode("utf-32-le") for a, b in zip(s, e)]
    assert words == ["you", "idiot", "stupid", "pid", "é" * 60] and owner.tolist() == [0, 0, 2, 2, 3]
    for t in ("you,bad m0r0n", "a1b a11b a111b 1abc abc1 $tu$id", "b a d 5 x", "x-y-z not-bad 12 ab3c", "\U0001f600ab@cd"):
        low, s, e, _ = toxicity.spelled([t])
        assert sorted(low[a:b].tobytes().decode("utf-32-le") for a, b in zip(s, e)) == sorted(plain_units(t)), t


def test_marks_part_units_and_digits_stand_for_letters():
    m = toxicity.Machine(["bad", "moron"], np.array([1.0, 1.0]), 0.0, 1.0, 0.0)
    assert (m.text_values(["you bad", "you,bad", "bad/me", "you_bad5me"])[:, 0] == 1).all()
    assert (m.text_values(["moron", "m0r0n", "m0r0n!!", "you.m0ron"])[:, 1] == 1).all()
    assert not m.text_values(["badly", "mp3 2015 r0", "a1b2c3"]).any()


def test_scores_equal_the_definition():
    """Every step of a score by plain loops: values, weights, logistic curve."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randint(3, 6)))
    texts = [" ".join(word() for _ in range(6)) + (" dacbad" if i % 3 == 0 else "") for i in range(60)]
    m = toxicity.fit(texts, [int(i % 3 == 0) for i in range(60)], landmarks=6)
    new = ["dac,bad", "", "d4cbad here", *texts[:9]]
    want = [1 / (1 + np.exp(-(m.slope * (sum(v * w for v, w in zip(row, m.weights)) + m.bias) + m.shift))) for row in plain_values(new, m.landmarks)]
    assert m.landmarks and np.abs(m.scores(new) - want).max() < 1e-9


def test_copies_are_no_evidence():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcefghklmnprsuv") for _ in range(r.randint(3, 9)))
    text = lambda *more: " ".join(r.sample([word() for _ in range(30)] + list(more), 30 + len(more)))
    copied = text()
    toxic = [text("idiot") for _ in range(60)] + [copied.replace(r.choice(copied.split()), word()) for _ in range(60)]
    got = toxicity.choose_landmarks(toxic + [text() for _ in range(200)], np.array([1] * 120 + [0] * 200), 64)
    assert got[0] == "idiot" and len(got) < 6  # of 30 words that 60 copies share


def test_fit_in_bounded_memory():
    import tracemalloc

    r = random.Random(3)
    words = ["".join(r.choice("abcefghklmnprsuv") for _ in range(r.randint(3, 9))) for _ in range(3000)]
    texts = [" ".join(r.choices(words, k=6_000)) for _ in range(60)]  # 2.5 million characters
    toxicity.tables(), toxicity.lower_table(), toxicity.powers(1)
    tracemalloc.start()
    toxicity.fit(texts, [1, 0] * 30)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6


def test_toxicity_is_learned_and_tolerant():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghilmnorst") for _ in range(r.randint(2, 9)))
    bad = ["idiot", "worthless", "stupid"]
    clean = [" ".join(word() for _ in range(40)) for _ in range(200)]
    toxic = [" ".join([*(word() for _ in range(30)), r.choice(bad), r.choice(bad)]) for _ in range(120)]
    m = toxicity.fit(clean + toxic, [0] * 200 + [1] * 120)
    assert {*bad} <= {*m.landmarks}
    s = m.scores(["such an idxiot and wor-thless st.u.pid thing", "a plain sentence here", "", "i d i o t w o r t h l e s s stupid"])
    assert s[0] > 0.5 and s[3] > 0.5 and s[1] < 0.5 and s[2] < 0.5
    assert toxicity.fit([], []).scores(["x"]) == [0.5]


def test_toxicity_within_long_units():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcefghklmnprsuv") for _ in range(r.randint(2, 9)))
    bad = ["idiot", "worthless", "stupid"]
    clean = [" ".join(word() for _ in range(40)) for _ in range(200)]
    toxic = [" ".join([*(word() for _ in range(30)), r.choice(bad), r.choice(bad)]) for _ in range(120)]
    m = toxicity.fit(clean + toxic, [0] * 200 + [1] * 120)
    front = "nobodylikesyouandnobodyeverwillbecauseyouare"
    whole = m.scores(["such an idiot"])[0]
    hidden = [" ".join(front + "anidiot"), ",".join([*["fellow"] * 9, "idiot"]), "\u597d" * 9000 + "idiot" + "\u597d" * 9000, "heisanidiot"]
    assert whole > 0.5 and (m.scores(hidden) > 0.5).all() and m.scores([" ".join(front)])[0] < 0.5


def test_toxicity_without_a_usable_sample(spark):
    from pyspark.sql import functions as F

    from likeness.llm import registry

    toxic = F.col("doc_id") % 4 == 0
    labels = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).cast("int").alias("toxic"))
    docs = labels.select("doc_id", F.concat(F.when(toxic, F.lit("such a worthless idiot ")).otherwise(F.lit("such a fine day ")), F.repeat(F.lit("and so on "), 10)).alias("text"))
    # no labels: nothing is called toxic
    assert registry.toxicity_model(docs, labels.limit(0)).scores(["a fine day"])[0] < 0.5
    # every text is over the bound: longer ones are drawn
    m = registry.toxicity_model(docs, labels, max_bytes=50)
    assert m.scores(["a worthless idiot"])[0] > 0.5 > m.scores(["a fine day"])[0]
    # nothing parts the labels: the share of all labels, not of the balanced sample
    same = docs.withColumn("text", F.lit("1 2 3"))  # no landmark
    assert abs(registry.toxicity_model(same, labels, per_class=20).scores(["x"])[0] - 0.25) < 0.08


def test_scored_rows(spark):
    m = toxicity.fit(["nice words", "idiot idiots here", "idiot and scum", "fine day"], [0, 1, 1, 0])
    docs = spark.createDataFrame([(1, "idiot", "a"), (2, None, "b"), (2, None, "b")], "doc_id long, text string, score string")
    assert toxicity.score(docs, m).count() == 3 and toxicity.score(docs.limit(0), m).count() == 0
    assert [f.name for f in toxicity.score(docs, m, keep_row=True).select("_row.*").schema] == docs.columns
    assert quality.score(docs, quality.fit(["a"], [1])).count() == 3


def test_sample_is_bounded(spark):
    from pyspark.sql import functions as F

    from likeness.llm.samples import labelled_sample

    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"), F.lit("x").alias("label"))
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).cast("int").alias("toxic"))
    texts, label, share = labelled_sample(docs, labels, "toxic", F.col("doc_id") % 5 != 0, 100, 1000)
    assert 60 < sum(label) <= 150 and 60 < len(label) - sum(label) <= 150 and abs(share - 0.25) < 0.05
    assert all(int(t[1:]) % 5 for t in texts)
    assert labelled_sample(docs, labels.limit(0), "toxic", F.lit(True), 10, 100) == ([], [], None)


def test_repeated_rows_do_not_crowd_the_sample(spark):
    from pyspark.sql import functions as F

    from likeness.llm.samples import labelled_sample

    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    often = docs.unionByName(docs.where("doc_id = 7").crossJoin(spark.range(5000)).select("doc_id", F.concat("text", F.lit(""), (F.col("id") % 3).cast("string")).alias("text"))).unionByName(docs)
    one = labelled_sample(docs, labels, "quality", F.lit(True), 1200, 1000)
    two = labelled_sample(often, labels.unionByName(labels), "quality", F.lit(True), 1200, 1000)
    assert len(one[0]) == 400 and one == two


def test_searches_take_linear_time():
    from likeness.llm.pii import stretches

    began = time.time()
    stretches("7" * 1_000_000 + " " + "x" * 1_000_000 + " 7")
    stretches("7 x " * 200_000)
    for t in ("/MIIE" * 200_000, "/b3BlbnNzaC1rZXktdjE" * 5_000, ("/MIIE" * 12 + "\n") * 20_000, "M" * 1_000_000):
        secrets.confirmed_spans(t)
    assert time.time() - began < 20
    key = base64.b64encode(b"\x30\x2e\x02\x01\x00\x30\x05\x06\x03\x2b\x65\x70\x04\x22\x04\x20" + bytes(range(32))).decode()
    began = time.time()
    assert len(secrets.confirmed_spans(f"{key} " * 5_000)) == 5_000 and time.time() - began < 5


def test_secrets_of_odd_tables(spark):
    schema = "doc_id long, text string, spans string, n_hex string"
    rows = [(1, "token = abcdefghijkl", "s", "n"), (1, "token = abcdefghijkl", "s", "n"), (None, None, None, None), (2, "", None, None), (3, "deadbeefdeadbeef " * 60_000, None, None)]
    got = sorted((r.doc_id or 0, r.n_assign, r.n_hex) for r in secrets.find(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 0, 0), (1, 1, 0), (1, 1, 0), (2, 0, 0), (3, 0, 60_000)]
    assert secrets.find(spark.createDataFrame([], schema)).count() == 0


def test_classifiers_on_an_empty_table(spark):
    from likeness.llm import registry

    docs = spark.createDataFrame([], "doc_id long, text string, score string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(docs, registry.quality_model(docs, labels)).count() == 0
    assert toxicity.score(docs, registry.toxicity_model(docs, labels)).count() == 0
