"""Secrets in texts: plain patterns, and encodings that are reported only when their structure holds.

Base kinds are found by pattern alone: ``assign``, ``access`` and ``hex``. The method adds ``key`` and ``jwt``, which are decoded
and parsed first:

* a base64 run, also over real or escaped line breaks, or a hex run that starts like an ASN.1 sequence is a ``key`` if its nested
  lengths fill it to the byte and its fields are those of a private key (RSA with n = p q, DSA with q | p - 1, EC, PKCS#8 around
  one of them, encrypted PKCS#8). The outer length says how many characters belong to it, so no end marker is needed;
* a run with the OpenSSH magic is a ``key`` if its length-prefixed fields are all there;
* three dotted base64url parts are a ``jwt`` if the header is a JSON object naming a known algorithm and the signature has the
  length of that algorithm. Public keys, unsigned tokens and look-alikes are not reported.

A key of more than ``MAX_KEY_BYTES`` is none (RSA keys of 16,384 bits have about 9,500).

Null and empty texts have no secrets; texts are scanned whole. Each row of the input gives one row, repeated ids too; null ids
stay null. Only the id and the text column are read, so other columns may have any name. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.llm.text import tidy

#: Kinds in the order in which spans with one start are listed.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "key", "jwt")
MAX_KEY_BYTES = 1 << 16
#: Bits of the least RSA or DSA modulus that counts as a key.
MIN_BITS = 512

# The base patterns. Letters of ``assign`` are ASCII in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# a run is matched whole, so a run that is too short holds no other match
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LENGTH = 12

#: What begins like an encoded sequence (0x30), at the start of a run, after a dashed line or after an escaped line break.
SEQUENCE_64 = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=-----)|(?<=\\n))M[A-Za-z0-9+/_-]{15}")
OPENSSH_64 = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=-----)|(?<=\\n))b3BlbnNzaC1rZXktdjEA")
SEQUENCE_16 = re.compile(r"(?:(?<![0-9A-Za-z])|(?<=0x))30[0-9a-fA-F]{30,}(?![0-9A-Za-z])")
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])(e[A-Za-z0-9_-]{11,})\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]{20,})(?![A-Za-z0-9_.-])")
RUN = re.compile(r"[A-Za-z0-9+/_-]+")
BREAK = re.compile(r"(?:\r?\n|(?:\\r)?\\n)[ \t]*")
#: Every text with a match of any pattern above matches this one.
ANY = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{14}|[0-9a-f]{16}|30[0-9a-fA-F]{30}"""
    r"""|M[A-Za-z0-9+/_-]{15}|b3BlbnNzaC1rZXktdjEA|e[A-Za-z0-9_-]{11,}\.[A-Za-z0-9_-]+\."""
)

# ASN.1 tags, object identifiers as stored, and the signature bytes of the signed-token algorithms.
INTEGER, BITS, OCTETS, OID, SEQUENCE, FIELD_0, FIELD_1 = 0x02, 0x03, 0x04, 0x06, 0x30, 0xA0, 0xA1
RSA_OID, DSA_OID, EC_OID = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce380401"), bytes.fromhex("2a8648ce3d0201")
EDWARDS_OIDS = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57}
SCHEME_OIDS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
SIGNATURE_BYTES = {
    "HS256": {32}, "HS384": {48}, "HS512": {64}, "ES256": {64}, "ES256K": {64}, "ES384": {96}, "ES512": {132}, "EdDSA": {64, 114},
    **{f"{kind}{bits}": set(range(128, 2049)) for kind in ("RS", "PS") for bits in (256, 384, 512)},
}

Element = tuple[int, int, int]


def element(data: bytes, at: int, end: int) -> Element | None:
    """Tag and content range of the element at ``at``; None if it has no shortest-form length or does not end by ``end``."""
    if at + 2 > end or data[at] & 0x1F == 0x1F:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size >= 0x80:
        count = size & 0x7F
        if not 0 < count <= 4 or at + count > end:
            return None
        size = int.from_bytes(data[at : at + count])
        if size < 0x80 or data[at] == 0:
            return None
        at += count
    return (tag, at, at + size) if at + size <= end else None


def elements(data: bytes, begin: int, end: int) -> list[Element] | None:
    """The elements that fill a range to the byte."""
    out = []
    while begin < end:
        found = element(data, begin, end)
        if found is None:
            return None
        out.append(found)
        begin = found[2]
    return out


def nested(data: bytes) -> list[Element] | None:
    """The fields of the one sequence that ``data`` is, if all lengths inside it hold."""
    whole = elements(data, 0, len(data))
    if whole is None or len(whole) != 1 or whole[0][0] != SEQUENCE:
        return None
    fields, waiting = None, whole
    while waiting:
        tag, begin, end = waiting.pop()
        if tag & 0x20:
            inner = elements(data, begin, end)
            if inner is None:
                return None
            fields = inner if fields is None else fields
            waiting += inner
    return fields


def private_key(data: bytes) -> str | None:
    """What kind of private key the bytes are, as their fields say."""
    fields = nested(data)
    if not fields:
        return None
    tags = [tag for tag, _, _ in fields]
    part = lambda n: data[fields[n][1] : fields[n][2]]
    number = lambda n: int.from_bytes(part(n), signed=True)
    if tags[:9] == [INTEGER] * 9 and len(tags) <= 10:
        sizes = [number(n) for n in range(9)]
        return "rsa" if sizes[0] in (0, 1) and sizes[1].bit_length() >= MIN_BITS and sizes[1] == sizes[4] * sizes[5] else None
    if tags == [INTEGER] * 6:
        p, q = number(1), number(2)
        return "dsa" if number(0) == 0 and p.bit_length() >= MIN_BITS and q > 1 and (p - 1) % q == 0 else None
    if tags[:2] == [INTEGER, OCTETS] and set(tags[2:]) <= {FIELD_0, FIELD_1}:
        return "ec" if number(0) == 1 and 20 <= len(part(1)) <= 72 else None
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS] and set(tags[3:]) <= {FIELD_0, FIELD_1} and number(0) in (0, 1):
        return _wrapped(data, fields[1], part(2))
    if tags == [SEQUENCE, OCTETS]:
        scheme = elements(data, *fields[0][1:]) or []
        named = scheme and scheme[0][0] == OID and data[scheme[0][1] : scheme[0][2]].startswith(SCHEME_OIDS)
        return "encrypted" if named and len(part(1)) >= 16 else None
    return None


def _wrapped(data: bytes, algorithm: Element, content: bytes) -> str | None:
    """A PKCS#8 key: the algorithm says what the content must be."""
    named = elements(data, *algorithm[1:])
    if not named or named[0][0] != OID:
        return None
    oid = data[named[0][1] : named[0][2]]
    if oid in (RSA_OID, EC_OID):
        kind = {RSA_OID: "rsa", EC_OID: "ec"}[oid]
        return f"pkcs8-{kind}" if private_key(content) == kind else None
    inner = elements(content, 0, len(content))
    if oid in EDWARDS_OIDS:
        good = inner and len(inner) == 1 and inner[0][0] == OCTETS and inner[0][2] - inner[0][1] == EDWARDS_OIDS[oid]
        return "pkcs8-edwards" if good else None
    if oid == DSA_OID:
        return "pkcs8-dsa" if inner and [e[0] for e in inner] == [INTEGER] else None
    return None


def gathered(text: str, at: int, count: int) -> tuple[str, int]:
    """Up to ``count`` base64 characters from ``at`` on, over line breaks, and where the last of them ends."""
    parts, end = [], at
    while count and (run := RUN.match(text, at, at + count)):
        parts.append(run[0])
        count -= len(run[0])
        end = run.end()
        line = BREAK.match(text, end)
        at = line.end() if line else end
    return "".join(parts), end


def decoded(chars: str) -> bytes | None:
    """Bytes of base64 characters of either alphabet, without padding."""
    try:
        return base64.b64decode(chars.replace("-", "+").replace("_", "/") + "=" * (-len(chars) % 4))
    except ValueError:
        return None


def exact_run(text: str, at: int, size: int) -> tuple[bytes, int] | None:
    """``size`` bytes written as base64 from ``at`` on, and the end with its padding; None if the run is shorter or goes on."""
    chars, end = gathered(text, at, -(-size * 4 // 3))
    data = decoded(chars)
    if data is None or len(data) != size:
        return None
    padding = -size % 3
    if text.startswith("=" * padding, end):
        end += padding
    return None if re.match(r"[A-Za-z0-9+/=]", text[end : end + 1]) else (data, end)


def openssh_bytes(data: bytes) -> int | None:
    """Length of the OpenSSH private key that ``data`` begins with: cipher, kdf, its options, public keys, private part."""
    at = 15

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4]) if at + 4 <= len(data) else MAX_KEY_BYTES
        begin, at = at + 4, at + 4 + size
        return data[begin:at] if at <= len(data) else None

    if any(field() is None for _ in range(3)) or at + 4 > len(data):
        return None
    keys = int.from_bytes(data[at : at + 4])
    at += 4
    if not 0 < keys <= 16 or any(not field() for _ in range(keys)):
        return None
    secret = field()
    return at if secret and len(secret) >= 16 else None


def signed(header: str, payload: str, signature: str) -> str | None:
    """The algorithm of a signed token."""
    try:
        fields = json.loads(decoded(header) or b"")
    except (ValueError, RecursionError):
        return None
    name = fields.get("alg") if isinstance(fields, dict) else None
    proof = decoded(signature)
    good = isinstance(name, str) and proof is not None and decoded(payload) is not None and len(proof) in SIGNATURE_BYTES.get(name, ())
    return name if good else None


def scan(text: str) -> list[tuple[str, int, int, str | None]]:
    """(kind, start, end, what the structure says) of a text's secrets, by start, then in the order of ``KINDS``."""
    out: list[tuple[str, int, int, str | None]] = []
    out += [("assign", *m.span(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    out += [("access", *m.span(), None) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span(), None) for m in HEX.finditer(text)]
    for m in SEQUENCE_64.finditer(text):
        head = decoded(m[0][:8])
        outer = element(head, 0, MAX_KEY_BYTES) if head and head[0] == SEQUENCE else None
        run = exact_run(text, m.start(), outer[2]) if outer else None
        kind = private_key(run[0]) if run else None
        if kind:
            out.append(("key", m.start(), run[1], kind))
    for m in OPENSSH_64.finditer(text):
        chars, _ = gathered(text, m.start(), MAX_KEY_BYTES * 4 // 3)
        size = openssh_bytes(decoded(chars[: len(chars) // 4 * 4]) or b"")
        run = exact_run(text, m.start(), size) if size else None
        if run:
            out.append(("key", m.start(), run[1], "openssh"))
    for m in SEQUENCE_16.finditer(text):
        if len(m[0]) % 2 == 0 and len(m[0]) <= 2 * MAX_KEY_BYTES and (kind := private_key(bytes.fromhex(m[0]))):
            out.append(("key", *m.span(), kind))
    for m in TOKEN.finditer(text):
        if kind := signed(*m.groups()):
            out.append(("jwt", *m.span(), kind))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


FOUND = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("detail", T.StringType())])
)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``found``, the secrets of the text: kind, start, end, detail."""
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("detail", pa.string())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string()).fill_null("")
            # most texts hold no candidate at all: one pass over the batch names those that may
            likely = pc.match_substring_regex(texts, ANY).to_numpy(zero_copy_only=False).nonzero()[0].tolist()
            found: list[list] = [[] for _ in range(len(texts))]
            for n in likely:
                found[n] = [dict(zip(("kind", "start", "end", "detail"), s)) for s in scan(texts[n].as_py())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, spans)], ["id", "found"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("found", FOUND)])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(search), schema).withColumnRenamed("id", id_col)
