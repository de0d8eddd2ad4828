import base64
import hashlib
import json
import random
import re

import pytest
from cases import documents, texts
from pyspark.sql import functions as F

from keelson.llm.secret_queries import joined, of_kind, op11_secret_scan
from keelson.llm.secret_scan import BASE, KINDS, find_secrets, private_key, scan

DATA = "/root/testdata/sf0.001"


def der(tag, content):
    n = len(content)
    size = bytes([n]) if n < 128 else bytes([0x80 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8)
    return bytes([tag]) + size + content


def integer(n):
    return der(2, n.to_bytes(n.bit_length() // 8 + 1))


def rsa(p=(1 << 521) - 1, q=(1 << 607) - 1, good=True):
    e, n = 65537, p * q + (0 if good else 2)
    d = pow(e, -1, (p - 1) * (q - 1))
    return der(0x30, b"".join(map(integer, (0, n, e, d, p, q, d % (p - 1), d % (q - 1), pow(q, -1, p)))))


RSA_OID, EC_OID = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201")
EC = der(0x30, integer(1) + der(4, bytes(range(32))) + der(0xA0, der(6, bytes.fromhex("2a8648ce3d030107"))))
Q = (1 << 160) - 47
KEYS = {
    "rsa": rsa(),
    "dsa": der(0x30, b"".join(map(integer, (0, (Q << 400) + 1, Q, 4, 9, 7)))),
    "ec": EC,
    "pkcs8-rsa": der(0x30, integer(0) + der(0x30, der(6, RSA_OID) + der(5, b"")) + der(4, rsa())),
    "pkcs8-ec": der(0x30, integer(0) + der(0x30, der(6, EC_OID)) + der(4, EC)),
    "pkcs8-edwards": der(0x30, integer(0) + der(0x30, der(6, bytes.fromhex("2b6570"))) + der(4, der(4, bytes(32)))),
    "encrypted": der(0x30, der(0x30, der(6, bytes.fromhex("2a864886f70d01050d")) + der(0x30, b"")) + der(4, bytes(48))),
}


def field(data):
    return len(data).to_bytes(4) + data


OPENSSH = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4) + field(b"k" * 51) + field(b"s" * 136)


def token(alg="HS256", size=32, header=None):
    part = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    return ".".join([part(json.dumps(header or {"alg": alg, "typ": "JWT"}).encode()), part(b'{"sub":"1"}'), part(bytes(range(size)))])


def lines(text, width=64, end="\n"):
    return end.join(text[k : k + width] for k in range(0, len(text), width))


@pytest.mark.parametrize("kind", KEYS)
def test_keys_are_told_by_their_fields(kind):
    data = KEYS[kind]
    assert private_key(data) == kind
    assert private_key(data + b"\0") is None and private_key(data[:-1]) is None
    hexed = "zz 0x" + data.hex().upper() + " zz"
    if len(data) > 16:
        assert ("key", 5, 5 + 2 * len(data), kind) in scan(hexed)
        body = base64.b64encode(data).decode()
        for end in ("\n", "\r\n", "\\n"):
            text = f"é -----BEGIN X-----{end}{lines(body, end=end)}{end}-----END X----- y"
            begin = text.index(body[:8])
            assert [s[1:] for s in scan(text) if s[0] == "key"] == [(begin, text.index(f"{end}-----END"), kind)]
        assert [s[3] for s in scan(base64.urlsafe_b64encode(data).decode().rstrip("=")) if s[0] == "key"] == [kind]
        for wrong in (body[:-5], body + "AAAA", "x" + body):
            assert not [s for s in scan(wrong) if s[0] == "key"]


def test_lengths_and_fields_that_do_not_hold():
    assert private_key(rsa(good=False)) is None
    assert private_key(rsa((1 << 61) - 1, (1 << 89) - 1)) is None  # too short to be in use
    public = der(0x30, der(0x30, der(6, RSA_OID) + der(5, b"")) + der(3, b"\0" + der(0x30, integer(35) + integer(3))))
    assert private_key(public) is None and not scan(base64.b64encode(public).decode())
    broken = bytearray(KEYS["pkcs8-ec"])
    broken[len(broken) - 34 - 12] ^= 1
    assert private_key(bytes(broken)) in (None, "pkcs8-ec")
    assert private_key(b"") is None and private_key(b"\x30") is None and private_key(b"\x30\x80\0\0") is None
    deep = b""
    for _ in range(3000):
        deep = der(0x30, deep)
    assert private_key(deep) is None
    for size in range(len(OPENSSH)):
        assert not [s for s in scan(base64.b64encode(OPENSSH[:size]).decode().rstrip("=")) if s[0] == "key"]
    text = f"a\n{lines(base64.b64encode(OPENSSH).decode(), 70)}\n-----END"
    assert [s[1:] for s in scan(text) if s[0] == "key"] == [(2, text.index("\n-----END"), "openssh")]


def test_tokens():
    good = [token(), token("ES256", 64), token("RS256", 256), token("EdDSA", 64)]
    bad = [token("none", 32), token("HS256", 31), token("XX", 32), token(header={"typ": "JWT"}), token(header=["alg"]), "eyJhbGciOiJIUzI1NiJ9xx.abc", "e" * 30 + ".a." + "b" * 30]
    for t in good:
        assert scan(f"by {t}, x") == [("jwt", 3, 3 + len(t), json.loads(base64.urlsafe_b64decode(t.split(".")[0] + "=="))["alg"])]
    for t in bad:
        assert not [s for s in scan(f"by {t}, x") if s[0] == "jwt"], t


def plain_spans(text):
    """The base kinds, letter by letter."""
    out, low = [], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    at = 0
    while at < len(text):
        end = None
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(word, at):
                # every optional part is taken if that lets the rest match
                for quote in (1, 0):
                    k = at + len(word)
                    if quote and text[k : k + 1] not in ("'", '"'):
                        continue
                    k += quote
                    while text[k : k + 1] == " ":
                        k += 1
                    if text[k : k + 1] not in (":", "="):
                        continue
                    k += 1
                    while text[k : k + 1] == " ":
                        k += 1
                    k += text[k : k + 1] in ("'", '"') and text[k : k + 1] != ""
                    begin = k
                    while k < len(text) and text[k] in value:
                        k += 1
                    if k > begin:
                        end = (begin, k)
                        break
                if end:
                    break
        if end:
            if end[1] - end[0] >= 12:
                out.append((at, 0, "assign", end[1]))
            at = end[1]
        else:
            at += 1
    for n, (kind, head, letters, size) in enumerate((("access", "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 18), ("hex", "", set("0123456789abcdef"), 16)), 1):
        at = 0
        while at < len(text):
            end = at + len(head)
            while text.startswith(head, at) and end < len(text) and text[end] in letters:
                end += 1
            if text.startswith(head, at) and end > at + len(head):
                if end - at >= size:
                    out.append((at, n, kind, end))
                at = end
            else:
                at += 1
    return [(kind, at, end) for at, _, kind, end in sorted(out)]


def made(seed, n=400):
    rnd = random.Random(seed)
    pieces = [
        "password", "PassWd", "secret", "ToKen", "api_key", "apikey", "API-key", "'", '"', " ", "   ", ":", "=", "==", "abcdefghijkl", "abc.def_ghi/jkl=", "AKIA", "AKIAABCDEFGHIJKLMN",
        "AKIAABCDEFGHIJKLM", "0123456789abcdef", "0123456789abcde", "deadbeef", "DEADBEEF", "\n", "\t", "é", "🙂", "ſecret", "toKen", "\0", token(), base64.b64encode(KEYS["ec"]).decode(),
    ]
    return ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 30))) for _ in range(n)]


def test_base_kinds_against_brute_force():
    for text in [*made(1), "token=password=abcdefghijkl", "token:password:abcdefghijkl", "secret := abcdefghijklmnop", 'api_key":"abcdefghijkl"', "token'='abcdefghijkl"]:
        found = scan(text)
        assert [s[:3] for s in found if s[0] in BASE] == plain_spans(text), text
        assert found == sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def check(spark, rows, wide):
    got = find_secrets(wide).select("doc_id", of_kind(*BASE).alias("base"), joined(F.col("found")).alias("spans")).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["spans"]) for r in got) == sorted(
        (-1 if i is None else i, ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in scan(t or ""))) for i, t in rows
    )


def test_rows(spark):
    long = "x " * 400_000 + "token = abcdefghijkl " + "z" * 700_000 + " AKIA" + "Q" * 16
    rows = [*texts(), *enumerate(made(2, 60), 1000), (5000, long), (5000, long), (5001, "a" * 300_000), (5002, "token" + " " * 200_000), (5003, "M" * 200_000), (5004, "e" * 100_000 + ".")]
    check(spark, rows, documents(spark, rows))
    clash = spark.createDataFrame([(1, "token=abcdefghijkl", "a", "b")], "doc_id long, text string, id string, found string")
    assert [(r["doc_id"], len(r["found"])) for r in find_secrets(clash).collect()] == [(1, 1)]
    assert find_secrets(documents(spark).limit(0)).count() == 0


def test_query(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = op11_secret_scan(spark, DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        base = plain_spans(docs[r["doc_id"]])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[0] == k for s in base) for k in BASE)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(",")) and not re.search(r"[A-Z ]", r["spans"])
