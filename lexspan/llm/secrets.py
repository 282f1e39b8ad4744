"""Secret scan with structural confirmation.

Patterns find candidates; base64 and hex candidates are decoded, and what they hold is parsed before they are reported:

* DER private keys, by their structure: PKCS#1 and DSA (a version and the numbers), PKCS#8 (version, algorithm, octets; plain or encrypted) and
  SEC1 (version 1, octets). Nested lengths must add up. Public keys and certificates have other structures and aren't reported.
* OpenSSH key containers: every length is read, and they must fill the container.
* PEM armour of private keys, with headers (Proc-Type, DEK-Info) or without.
* Signed tokens, by the JSON header that names the algorithm.
* Base64 may be wrapped over lines, in armour or not, and candidates may be layers of base64 and hex, up to `DEPTH` deep.

Null and empty texts have no spans. Texts are read whole, however long, in time that grows with their length. Empty tables give empty
results; rows that repeat or tie give the same results, each on its own; other columns are not read."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import workers

# fixed values: the base patterns and kinds of the contract, in its order
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "pem", "key64", "keyhex")
ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that have 24 or more
HEX_ANY = re.compile(r"[0-9A-Fa-f]{46,}")
# words of the base64 alphabet, over line ends where a line is long enough to be a wrapped one
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)*={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
TOKEN = re.compile(r"e[wy][A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:(?!-----)[\s\S])*)-----END \1-----")
DEK = re.compile(r"DEK-Info:[ \t]*[A-Za-z0-9-]+,[ \t]*(?:[0-9A-Fa-f]{2}){8,}")
OPENSSH = b"openssh-key-v1\0"
SMALLEST, DEPTH = 23, 3  # bytes of the smallest key; layers
SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def unbase64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der(b: bytes, at: int, end: int, depth: int = 0) -> list[tuple[int, int, list]] | None:
    """(tag, length, values inside) of the values in b[at:end], or None if lengths don't add up."""
    out: list[tuple[int, int, list]] = []
    while at < end:
        if at + 2 > end or depth > 12:
            return None
        tag, n = b[at], b[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return None
            n, at = int.from_bytes(b[at : at + k], "big"), at + k
        if at + n > end:
            return None
        inner: list | None = []
        if tag in (0x30, 0x31) or tag & 0xE0 == 0xA0:
            inner = der(b, at, at + n, depth + 1)
            if inner is None:
                return None
        out.append((tag, n, inner))
        at += n
    return out


def der_size(head: bytes) -> int | None:
    """Size of the sequence that begins with these bytes (6 are enough)."""
    if len(head) < 2 or head[0] != 0x30:
        return None
    k = head[1] & 0x7F
    if head[1] < 0x80:
        return 2 + head[1]
    return 2 + k + int.from_bytes(head[2 : 2 + k], "big") if 1 <= k <= 4 and len(head) >= 2 + k else None


def is_private_der(b: bytes) -> bool:
    """A sequence that fills b and has the structure of a private key."""
    if der_size(b[:6]) != len(b) or not (found := der(b, 0, len(b))):
        return False
    inside = found[0][2]
    tags = [t for t, _, _ in inside]
    named = lambda x: x[0] == 0x30 and x[2][:1] and x[2][0][0] == 0x06 and x[2][0][1] > 0  # noqa: E731  # an algorithm: a sequence that begins with an object's number
    if len(tags) >= 2 and tags[0] == 0x02 and inside[0][1] == 1:
        numbers = next((i for i, t in enumerate(tags) if t != 0x02), len(tags))
        if (numbers >= 9 and numbers == len(tags) - (tags[-1] == 0x30)) or numbers == len(tags) == 6:  # RSA, with other primes or not; DSA
            return max(n for _, n, _ in inside) >= 16
        if tags[1] == 0x30 and tags[2:3] == [0x04]:  # PKCS#8
            return bool(named(inside[1])) and inside[2][1] >= 16
        return tags[1] == 0x04 and inside[1][1] >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])  # SEC1
    return tags == [0x30, 0x04] and bool(named(inside[0])) and inside[1][1] >= 16  # PKCS#8, encrypted


def openssh_size(b: bytes) -> int | None:
    """Size of the OpenSSH key container that b begins with: cipher, derivation and its options, number of keys, public keys, private part."""
    if not b.startswith(OPENSSH):
        return None
    at, left = len(OPENSSH), 3
    keys = None
    while left:
        if at + 4 > len(b):
            return None
        n = int.from_bytes(b[at : at + 4], "big")
        at += 4 + n
        if at > len(b) or (keys is None and n > 256):
            return None
        left -= 1
        if not left and keys is None:
            keys = int.from_bytes(b[at : at + 4], "big") if at + 4 <= len(b) else 0
            if not 1 <= keys <= 64:
                return None
            at, left = at + 4, keys + 1
    return at


def is_key(b: bytes | None) -> bool:
    return bool(b) and (is_private_der(b) if b[0] == 0x30 else openssh_size(b) == len(b))


def holds_key(b: bytes | None, depth: int) -> bool:
    """b is a key, or a text that is nothing but one, in armour, base64 or hex."""
    if not b or len(b) < SMALLEST:
        return False
    if is_key(b):
        return True
    if depth >= DEPTH or max(b) > 0x7E or b[0] <= 0x20:
        return False
    text = b.decode("ascii").strip()
    return any(s == 0 and e == len(text) for s, k, e in layered(text, depth + 1) if k >= 4)


def is_token(s: str) -> bool:
    head, _, _ = s.partition(".")
    try:
        x = json.loads(unbase64(head) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(x, dict) and isinstance(x.get("alg"), str)


def is_armoured(body: str, depth: int) -> bool:
    """What stands between the lines of PEM armour: headers, if any, up to an empty line, and the key."""
    head, blank, rest = body.strip("\r\n").replace("\r\n", "\n").partition("\n\n")
    if not blank or ":" not in head.partition("\n")[0]:
        head, rest = "", body
    data = unbase64("".join(rest.split()))
    if "ENCRYPTED" in head:
        return bool(DEK.search(head)) and data is not None and len(data) >= SMALLEST and len(data) % 8 == 0
    return holds_key(data, depth)


def base64_keys(text: str, depth: int) -> list[tuple[int, int]]:
    """(start, end) of the keys in words of base64, which may be wrapped. A key tells its own size, so it may begin at any line, and
    what follows it doesn't matter; for other layers the whole word counts."""
    out = []
    for m in BASE64.finditer(text):
        lines = [(x.start(), x.end()) for x in LINE.finditer(text, m.start(), m.end())]
        whole = "".join(text[i:j] for i, j in lines)
        begin, done = 0, 0  # places in whole
        for i, j in lines:
            size = None
            if begin >= done and whole[begin : begin + 1] in ("M", "b"):
                size = der_size(unbase64(whole[begin : begin + 8]) or b"")
                if whole.startswith("b3BlbnNzaC1rZXktdjEA", begin):
                    size = openssh_size(unbase64(whole[begin : len(whole) - (len(whole) - begin) % 4]) or b"")
            if size and size >= SMALLEST and (end := begin + -(-size * 4 // 3)) <= len(whole) and is_key(unbase64(whole[begin:end])):
                out.append((i, place(text, lines, end)))
                done = end
            begin += j - i
        if not done and len(whole) >= 32:
            data = unbase64(whole)
            if data is not None and data[0] != 0x30 and holds_key(data, depth):
                out.append((m.start(), place(text, lines, len(whole))))
    return out


def place(text: str, lines: list[tuple[int, int]], n: int) -> int:
    """Where the first n characters of the lines end in text, with the padding behind them."""
    for i, j in lines:
        if n <= j - i:
            end = i + n
            while text[end : end + 1] == "=" and end < i + n + 2:
                end += 1
            return end
        n -= j - i
    return lines[-1][1]


def layered(text: str, depth: int = 1) -> list[tuple[int, int, int]]:
    """(start, kind, end) of tokens, armour, base64 and hex."""
    out = []
    if "." in text:
        out += [(m.start(), 3, m.end()) for m in TOKEN.finditer(text) if is_token(m[0])]
    if "-----BEGIN " in text:
        out += [(m.start(), 4, m.end()) for m in PEM.finditer(text) if is_armoured(m[2], depth)]
    out += [(i, 5, j) for i, j in base64_keys(text, depth)]
    for m in HEX_ANY.finditer(text):
        if (m.end() - m.start()) % 2 == 0 and holds_key(bytes.fromhex(m[0]), depth):
            out.append((m.start(), 6, m.end()))
    return out


def find_secrets(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points, by start, then kind as listed."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(s, KINDS[k], e) for s, k, e in sorted(out + layered(text))]


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, the number of base spans by kind, their digest, and all spans as kind:start:end."""
    workers(docs.sparkSession)
    id_type = docs.schema[id_col].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for text in b.column(1):
                spans = find_secrets(text.as_py() or "")
                base = [x for x in spans if x[1] in BASE_KINDS]
                for c, k in zip(cols, BASE_KINDS, strict=False):
                    c.append(sum(x[1] == k for x in base))
                cols[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
                cols[4].append(joined(spans))
            yield pa.record_batch([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(id_col, text_col).mapInArrow(scan, f"`{id_col}` {id_type.simpleString()}, {SCHEMA}")
