"""Secret scans with structural confirmation.

Pattern matches give the base spans (assignments, access keys, hex runs).
Beyond them, base64 and hex candidates are decoded and reported only if the
bytes parse as a key: a DER private key whose nested lengths add up (also an
encrypted one), an OpenSSH private key with its length-prefixed fields, or a
signed token whose header and claims are JSON and whose signature has the length
its algorithm asks for.  Base64 keys are tried wherever the first characters of
one stand, whatever precedes them, and read on over line ends as far as their
lengths say; tokens are tried at every dotted segment.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_text

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "pkcs1", "pkcs8", "sec1", "dsa", "openssh", "pkcs8enc")
RANK = {k: i for i, k in enumerate(KINDS)}

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# Nothing is used up, so that a triple that fails does not hide the one that starts at its second or third part.
JWT = re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]{10,}+)\.([A-Za-z0-9_-]{2,}+)\.([A-Za-z0-9_-]*))")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----([A-Za-z0-9+/=\s\\]+?)-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----")
B64 = re.compile(r"[A-Za-z0-9+/_-]+")
LINE_END = r"(?:[\x20\t]*(?:\r?\n|\r|(?:\\r)?\\n|\\r)[\x20\t]*|\\(?=/))"  # also escaped, and the escape of a slash
JOIN = re.compile(LINE_END)
# The first characters of a DER sequence of up to 2**32 bytes and of an OpenSSH container.
KEY_START = re.compile(f"M{LINE_END}?[A-I]|b{LINE_END}?3{LINE_END}?B{LINE_END}?l")
HEXKEY = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{60,}(?![0-9A-Fa-f])")

# Signature bytes by algorithm; None: any length of a plausible RSA signature.
SIGNATURE_BYTES = {"HS256": {32}, "HS384": {48}, "HS512": {64}, "ES256": {64}, "ES256K": {64}, "ES384": {96},
                   "ES512": {132}, "EdDSA": {64, 114}, "RS256": None, "RS384": None, "RS512": None,
                   "PS256": None, "PS384": None, "PS512": None, "none": {0}}


MAGIC = b"openssh-key-v1\0"
KEY_ELEMENTS = 10  # a key of several primes has the most: nine numbers and the list of further primes
Bytes = Callable[[int, int], bytes]
# 1.2.840.113549.1.5 and 1.2.840.113549.1.12.1: encryption by a password.
PASSWORD_OIDS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def _b64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _der(read: Bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, content start and content end of one DER element inside the bytes from ``at`` to ``end``."""
    head = read(at, min(at + 6, end))
    if len(head) < 2:
        return None
    tag, n, at = head[0], head[1], at + 2
    if n == 0x80 or n > 0x84:
        return None
    if n > 0x80:
        k = n & 0x7F
        if len(head) < 2 + k:
            return None
        n, at = int.from_bytes(head[2:2 + k], "big"), at + k
        if n < 0x80:
            return None  # not the shortest form
    return (tag, at, at + n) if at + n <= end else None


def _children(read: Bytes, at: int, end: int, most: int) -> list[tuple[int, int, int]] | None:
    """The elements, ``most`` of them at most, that fill the bytes from ``at`` to ``end`` exactly, or None."""
    found = []
    while at < end:
        e = _der(read, at, end)
        if e is None or len(found) == most:
            return None
        found.append(e)
        at = e[2]
    return found


def der_kind(read: Bytes, size: int) -> str | None:
    """Kind of private key that the first ``size`` bytes hold in DER, if its nested lengths are right.

    Only the headers of its elements are read, and there are few: no key form has
    more than ten, and an algorithm is its name and its parameters."""
    top = _der(read, 0, size)
    if top is None or top[0] != 0x30 or top[2] != size:
        return None
    parts = _children(read, top[1], top[2], KEY_ELEMENTS)

    def algorithm(part):
        """The first bytes of the object identifier that begins ``part``, if it is an algorithm."""
        inner = _children(read, part[1], part[2], 2)
        return read(inner[0][1], min(inner[0][2], inner[0][1] + 16)) if inner and inner[0][0] == 0x06 else None

    if parts and [t for t, _, _ in parts] == [0x30, 0x04] and parts[1][2] > parts[1][1]:
        return "pkcs8enc" if (algorithm(parts[0]) or b"").startswith(PASSWORD_OIDS) else None
    if not parts or parts[0][0] != 0x02 or parts[0][2] - parts[0][1] != 1:
        return None
    tags, version = [t for t, _, _ in parts], read(parts[0][1], parts[0][2])[0]
    if version in (0, 1) and len(parts) >= 9 and set(tags[:9]) == {0x02}:
        return "pkcs1"
    if version == 0 and len(parts) == 6 and set(tags) == {0x02}:
        return "dsa"
    if version in (0, 1) and tags[1:3] == [0x30, 0x04]:
        return "pkcs8" if algorithm(parts[1]) is not None and parts[2][2] > parts[2][1] else None
    if version == 1 and tags[1:2] == [0x04] and all(t in (0xA0, 0xA1) for t in tags[2:]):
        return "sec1" if parts[1][2] - parts[1][1] >= 16 else None
    return None


def der_key(data: bytes) -> str | None:
    """Kind of private key that ``data`` holds in DER, if its nested lengths are right."""
    return der_kind(lambda a, b: data[a:b], len(data))


def openssh_end(read: Bytes, have: int) -> int | None:
    """Where an OpenSSH private key container ends within ``have`` bytes, if its fields have right lengths."""
    def after(at):
        """The number at ``at`` and the place after it; lengths point past what there is if they are wrong."""
        data = read(at, min(at + 4, have))
        return (int.from_bytes(data, "big"), at + 4) if len(data) == 4 else None

    at = len(MAGIC)
    if read(0, at) != MAGIC:
        return None
    for _ in range(3):  # cipher, key derivation and its options
        if (size := after(at)) is None:
            return None
        at = sum(size)
    if (count := after(at)) is None or not 1 <= count[0] <= 16:
        return None
    at = count[1]
    for _ in range(count[0] + 1):  # public keys, then the private part
        if (size := after(at)) is None:
            return None
        at = sum(size)
    return at if at <= have else None


def openssh_key(data: bytes) -> str | None:
    """'openssh' if ``data`` begins with an OpenSSH private key container."""
    return None if openssh_end(lambda a, b: data[a:b], len(data)) is None else "openssh"


def der_size(data: bytes) -> int | None:
    """Bytes of the DER sequence that ``data`` (its first 12 bytes) begins, if it may be a key by its first element."""
    n, at = data[1], 2
    if data[0] != 0x30 or n == 0x80 or n > 0x84:
        return None
    if n > 0x80:
        at = 2 + (n & 0x7F)
        n = int.from_bytes(data[2:at], "big")
    return at + n if data[at] == 0x30 or (data[at:at + 2] == b"\x02\x01" and data[at + 2] <= 1) else None


class Stretch:
    """The base64 characters of a text from ``at`` on, over line ends, up to the first thing that is neither."""

    def __init__(self, text: str, at: int):
        parts, self.joined, self.places, have = [], [], [], 0
        m = B64.match(text, at)
        while m:
            parts.append(m[0])
            self.joined.append(have)
            self.places.append(m.start())
            have, end = have + len(m[0]), m.end()
            gap = JOIN.match(text, end)
            m = gap and B64.match(text, gap.end())
        self.chars, self.end = "".join(parts), end

    def index(self, place: int) -> int:
        """Which of the characters stands at ``place`` in the text."""
        i = bisect.bisect_right(self.places, place) - 1
        return self.joined[i] + place - self.places[i]

    def place(self, index: int) -> int:
        """Where that character stands in the text."""
        i = bisect.bisect_right(self.joined, index) - 1
        return self.places[i] + index - self.joined[i]

    def reader(self, index: int) -> tuple[Bytes, int]:
        """Bytes ``a`` to ``b`` of what is encoded from character ``index`` on, and how many there are."""
        def read(a, b):
            lo = a // 3
            return (_b64(self.chars[index + 4 * lo:index - (-b * 4 // 3)]) or b"")[a - 3 * lo:b - 3 * lo]

        return read, (len(self.chars) - index) * 3 // 4


def base64_keys(text: str) -> list[tuple[str, int, int]]:
    """Keys (kind, start, end) in base64, each from where its first characters stand to its own end and padding.

    A stretch of base64 is joined once for all the starts within it, and a start
    reads a bounded number of headers, so the time is linear in the text."""
    found, done, stretch = [], 0, None
    for m in KEY_START.finditer(text):
        at = m.start()
        if at < done:
            continue
        if stretch is None or at >= stretch.end:
            stretch = Stretch(text, at)
        index, kind = stretch.index(at), None
        read, have = stretch.reader(index)
        if have < 12:
            continue
        head = read(0, 12)
        if MAGIC.startswith(head):
            size = openssh_end(read, have)
            kind = size and "openssh"
        else:
            size = der_size(head)
            kind = size and size <= have and der_kind(read, size)
        if kind:
            end = stretch.place(index - (-size * 4 // 3) - 1) + 1
            done = end + len(re.match("={0,2}", text[end:end + 2])[0])
            found.append((kind, at, done))
    return found


def key_kind(data: bytes | None) -> str | None:
    return None if not data else der_key(data) or openssh_key(data)


def signed_token(head: str, claims: str, signature: str) -> bool:
    """Whether the three parts form a signed token: JSON header with a known algorithm, JSON claims, a fitting signature."""
    try:
        h, c = (json.loads(_b64(x) or b"") for x in (head, claims))
    except (ValueError, RecursionError):
        return False
    if not isinstance(h, dict) or not isinstance(c, dict) or not isinstance(h.get("alg"), str) or h["alg"] not in SIGNATURE_BYTES:
        return False
    s, want = _b64(signature), SIGNATURE_BYTES[h["alg"]]
    return s is not None and (len(s) in want if want is not None else 128 <= len(s) <= 1024)


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end exclusive) of a text in code points, by start, then kind as listed."""
    found = set()
    if ":" in text or "=" in text:
        found.update(("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6)
    if "AKIA" in text:
        found.update(("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20)
    found.update(("hex", m.start(), m.end()) for m in HEX.finditer(text))
    covered = []
    if "PRIVATE KEY-----" in text:
        for m in PEM.finditer(text):
            kind = key_kind(_b64(re.sub(r"\\[nr]|\s|\\", "", m[1])))
            if kind:
                found.add((kind, m.start(), m.end()))
                covered.append((m.start(), m.end()))
    if "." in text:
        for m in JWT.finditer(text):
            if signed_token(m[1], m[2], m[3]):
                found.add(("jwt", m.start(1), m.end(3)))
                covered.append((m.start(1), m.end(3)))
    keys = base64_keys(text) + [(key_kind(bytes.fromhex(m[0])), m.start(), m.end()) for m in HEXKEY.finditer(text) if len(m[0]) % 2 == 0]
    found.update((k, x, y) for k, x, y in keys if k and not any(a <= x and y <= b for a, b in covered))
    return sorted(found, key=lambda s: (s[1], RANK[s[0]], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                                 T.StructField("end", T.IntegerType())]))
SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan_secrets(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None,
                 redacted_col: str | None = None) -> DataFrame:
    """Append ``secret_spans`` (kind, start, end) and, if asked for, the redacted text.

    Null and empty texts have no spans; a null text stays null when redacted.
    Whole texts are scanned, in time linear in their length whatever they hold;
    rows are independent, so repeated rows, ties and skewed columns change
    nothing, and an empty table gives an empty result.
    """
    new = [("secret_spans", SPAN)] + ([(redacted_col, T.StringType())] if redacted_col else [])

    def make():
        def work(texts):
            spans = [spans_of(t) if t else [] for t in texts]
            out = [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans], SPAN_ARROW)]
            if redacted_col:
                out.append(pa.array([redact(t, s) if s else t for t, s in zip(texts, spans)], pa.string()))
            return out
        return work

    return map_text(docs, make, new, text_col, keep)


def base_digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined([s for s in spans if s[0] in BASE_KINDS]).encode()).hexdigest()
