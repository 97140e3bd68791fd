"""Operator 5: secrets, by patterns and by structural confirmation.

Three patterns give the base spans. Beyond them, runs that could be encoded
keys or signed tokens are decoded from base64 or hexadecimal digits and
reported only if what they decode to parses to its last byte: a private-key
structure with nested lengths that add up (PKCS#1, PKCS#8, SEC 1, PKCS#12), the
length-prefixed fields of an OpenSSH private key, or a signed token whose
header names an algorithm and whose claims are an object. A base64 run may be
joined to earlier text by a slash, hyphen or underscore, and go on over lines of
one width. A PEM body that its header lines call encrypted cannot be parsed; it
is reported if it fills whole blocks of a cipher that the header gives the start value of.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from likeness.llm.arrow import map_docs

#: Base kinds in their order, then those of confirmed structures.
KINDS = ("assign", "access", "hex", "jwt", "key", "sshkey", "pem")
N_BASE = 3

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]++")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, in order."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


# ------------------------------------------------------- structures of bytes
def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the items that fill ``data`` exactly; None if their lengths do not add up."""
    out, i = [], 0
    while i < len(data):
        if i + 2 > len(data):
            return None
        tag, n = data[i], data[i + 1]
        i += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or i + k > len(data):
                return None
            n = int.from_bytes(data[i : i + k], "big")
            i += k
            if n < 0x80:
                return None
        if i + n > len(data):
            return None
        out.append((tag, data[i : i + n]))
        i += n
    return out


def is_private_der(data: bytes) -> bool:
    """A PKCS#1, PKCS#8 (also encrypted), SEC 1 or PKCS#12 structure, to the last byte."""
    if len(data) < 24 or data[0] != 0x30:
        return False
    top = der_items(data)
    if not top or len(top) != 1:
        return False
    own = der_items(top[0][1])
    if not own:
        return False
    tags = [t for t, _ in own]
    if tags[0] == 0x02:
        version = int.from_bytes(own[0][1], "big")
        if version == 0 and len(own) == 9 and all(t == 0x02 for t in tags):
            return True  # modulus, exponents, primes
        if version in (0, 1) and len(own) >= 3 and tags[1:3] == [0x30, 0x04]:
            kind = der_items(own[1][1])
            return bool(kind) and kind[0][0] == 0x06
        if version == 1 and len(own) >= 2 and tags[1] == 0x04 and len(own[1][1]) in (20, 24, 28, 32, 48, 66):
            return True
        if version == 3 and len(own) >= 2 and tags[1] == 0x30:
            kind = der_items(own[1][1])
            return bool(kind) and kind[0][0] == 0x06
        return False
    if tags == [0x30, 0x04]:  # encrypted: algorithm, data
        kind = der_items(own[0][1])
        return bool(kind) and kind[0][0] == 0x06 and len(kind) == 2
    return False


def is_openssh_private(data: bytes) -> bool:
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    i = len(magic)

    def field() -> bytes | None:
        nonlocal i
        n = int.from_bytes(data[i : i + 4], "big")
        if i + 4 + n > len(data):
            return None
        i += 4 + n
        return data[i - n : i]

    for _ in range(3):
        if field() is None:
            return False
    count = int.from_bytes(data[i : i + 4], "big")
    i += 4
    if not 1 <= count <= 64:
        return False
    for _ in range(count + 1):
        if field() is None:
            return False
    return i == len(data)


def from_base64(run: str) -> bytes | None:
    run = "".join(run.split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(run: str) -> bool:
    """Three parts; the first two decode to JSON objects, the first with an algorithm."""
    parts = run.split(".")
    if len(parts) != 3 or not parts[1]:
        return False
    for k in (0, 1):
        data = from_base64(parts[k])
        if not data:
            return False
        try:
            got = json.loads(data)
        except (ValueError, RecursionError):
            return False
        if not isinstance(got, dict) or (k == 0 and not isinstance(got.get("alg"), str)):
            return False
    return True


_JWT = re.compile(r"(?<![A-Za-z0-9_-])ey[A-Za-z0-9_-]{6,}+\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+={0,2}")
#: Name, header lines and body; line ends may be written as \\n.
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:\s|\\[rn])*+(?:[A-Za-z][A-Za-z0-9-]*+:[^\n\\]*+(?:\n|(?:\\r)?\\n))*+)([A-Za-z0-9+/=\s\\]*+)-----END \1-----")
_ENCRYPTED = re.compile(r"Proc-Type: *4, *ENCRYPTED")
_CIPHER = re.compile(r"DEK-Info: *[A-Za-z0-9-]+, *([0-9A-Fa-f]+)")
_LINE = re.compile(r"[A-Za-z0-9+/_-]++")
_NEXT = re.compile(r"\r?\n[ \t]*+([A-Za-z0-9+/_-]++)")
_PAD = re.compile(r"={0,2}")
#: Where a key may begin in a run.
_START = re.compile(r"(?:^|(?<=[/_-]))[Mb]")
_SSH_BEGIN = "b3BlbnNzaC1rZXktdjE"
_ALL_HEX = re.compile(r"[0-9A-Fa-f]+")
#: Digits of a key within a run or on lines, at most: over three times those of the largest in use. A run that is a key as a whole may be longer.
LONGEST_KEY = 1 << 16


def is_encrypted_body(head: str, data: bytes) -> bool:
    """Header lines that name a cipher with a start value of 8 or 16 bytes, and a body of whole blocks."""
    m = _CIPHER.search(head)
    return bool(m and _ENCRYPTED.search(head)) and len(m[1]) in (16, 32) and len(data) >= 24 and len(data) % (len(m[1]) // 2) == 0


def key_at(text: str, s: int, stop: int) -> tuple[int, int] | None:
    """(kind, end) of the base64 key that begins at ``s``, on one line, whose digits end at ``stop``, or on lines of one width."""
    need = None  # digits by the length that the structure's first bytes give
    if text[s] == "M":
        data = from_base64(text[s : s + 8])
        if not data or len(data) < 6 or data[0] != 0x30:
            return None
        k = data[1] & 0x7F if data[1] & 0x80 else 0
        if k > 4:
            return None
        need = -(-4 * (2 + k + (int.from_bytes(data[2 : 2 + k], "big") if k else data[1])) // 3)
    elif not text.startswith(_SSH_BEGIN, s):
        return None
    width = stop - s
    if width > (LONGEST_KEY if need is None else need) or (need or 0) > LONGEST_KEY:
        return None
    got, end = [text[s:stop]], stop
    size, ends = width, []
    while need is None or size < need:
        m = _NEXT.match(text, end)
        if not m or len(m[1]) > width:
            break
        if len(m[1]) < width:
            ends.append((len(got), end))  # the short line may be other text
        got.append(m[1])
        size += len(m[1])
        end = m.end()
        if len(m[1]) < width:
            break
        if size > LONGEST_KEY:
            return None
    if need is not None and size != need:
        return None
    for n, end in [*([] if need else ends), (len(got), end)][::-1]:
        data = from_base64("".join(got[:n]))
        if data and (is_private_der(data) if need else is_openssh_private(data)):
            return (4 if need else 5), _PAD.match(text, end).end()
    return None


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what decodes and parses."""
    out, blocks = [], []
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            data = from_base64(m[3].replace("\\n", "").replace("\\r", "").replace("\\", ""))
            if data and (is_private_der(data) or is_openssh_private(data) or is_encrypted_body(m[2], data)):
                out.append((m.start(), 6, m.end()))
                blocks.append(m.span())
    if "ey" in text and "." in text:
        out += [(m.start(), 3, m.end()) for m in _JWT.finditer(text) if is_signed_token(m[0])]
    upcoming, until = iter([*blocks, (len(text) + 1, 0)]), 0  # blocks and runs are met in order; all before ``until`` is taken
    begin, finish = next(upcoming)
    for m in _RUN.finditer(text):
        while begin <= m.start():
            until = max(until, finish)
            begin, finish = next(upcoming)
        if m.start() < until:
            continue
        run = m[0]
        tries = [bytes.fromhex(run)] if len(run) % 2 == 0 and _ALL_HEX.fullmatch(run) else []
        if run[0] in "Mb":  # an encoded sequence or the OpenSSH magic begins so
            tries.append(from_base64(run))
        for data in tries:
            if data and is_private_der(data):
                out.append((m.start(), 4, m.end()))
                break
            if data and is_openssh_private(data):
                out.append((m.start(), 5, m.end()))
                break
        else:
            stop = m.start() + len(run.rstrip("="))
            end = m.start()
            for at in _START.finditer(run):
                s = m.start() + at.start()
                if s >= end and (found := key_at(text, s, stop)):
                    end = found[1]
                    out.append((s, *found))
            until = max(until, end)
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every text: id, n_assign, n_access, n_hex (base spans), base_spans and spans (text).

    Spans are kind:start:end in code points, end exclusive, by start and then
    kind, comma-joined; ``spans`` has the base ones and the confirmed ones. A
    null text is empty and has none. Repeated rows are searched each; an empty
    table gives no rows; other columns are dropped.
    """

    def start():
        def f(texts: list[str]) -> dict:
            base = [base_spans(t) for t in texts]
            counts = {f"n_{KINDS[i]}": pa.array([sum(x[1] == i for x in b) for b in base], pa.int64()) for i in range(N_BASE)}
            spans = [sorted(b + confirmed_spans(t)) for b, t in zip(base, texts)]
            return counts | {"base_spans": pa.array(map(written, base), pa.string()), "spans": pa.array(map(written, spans), pa.string())}

        return f

    return map_docs(docs, start, "n_assign long, n_access long, n_hex long, base_spans string, spans string", id_col, text_col)
