import base64
import hashlib
import json
import os
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shardflow.llm.queries import queries
from shardflow.llm.secret_scan import KINDS, key_encoding, scan, secrets
from tests.conftest import SMALL
from tests.llm import cases


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (k := (n.bit_length() + 7) // 8)]) + n.to_bytes(k, "big")
    return bytes([tag]) + size + body


def number(x):
    return der(2, x.to_bytes(x.bit_length() // 8 + 1, "big"))


BIG = int.from_bytes(hashlib.sha512(b"n").digest() * 2, "big") | 1
PKCS1 = der(0x30, b"".join(map(number, (0, BIG, 65537, BIG // 3, BIG >> 500, BIG >> 501, BIG >> 502, BIG >> 503, BIG >> 504))))
SEC1 = der(0x30, number(1) + der(4, bytes(range(32))))
ALGORITHM = der(0x30, der(6, bytes([42, 134, 72, 206, 61, 2, 1])))
PKCS8 = der(0x30, number(0) + ALGORITHM + der(4, SEC1))
ENCRYPTED = der(0x30, ALGORITHM + der(4, bytes(48)))


def lp(b):
    return len(b).to_bytes(4, "big") + b


OPENSSH = b"openssh-key-v1\0" + lp(b"none") + lp(b"none") + lp(b"") + (1).to_bytes(4, "big") + lp(b"p" * 51) + lp(b"q" * 136)


def url64(b):
    return base64.urlsafe_b64encode(b).decode().rstrip("=")


TOKEN = ".".join((url64(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()), url64(b'{"sub":"1"}'), url64(b"signature-of-it")))


def brute_base(text):
    """The three patterns, each by its own words."""
    text = text or ""
    found = []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def brute(rows):
    out = []
    for r in rows:
        base = brute_base(r[1])
        n = [sum(k == j for _, k, _ in base) for j in range(3)]
        out.append((r[0], *n, hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def test_awkward_rows(spark):
    assert cases.rows(secrets(cases.docs(spark)).select(*COLUMNS)) == brute(cases.awkward())


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = queries()["op1_secrets"](spark, SMALL)
    assert cases.rows(got.select(*COLUMNS)) == brute(rows)
    for r in got.collect():
        text = next(t for i, t in rows if i == r["doc_id"]) or ""
        assert r["spans"] == ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in scan(text))


@given(st.lists(st.sampled_from(["password", "PASSWD", "api_key", "ApiKey", "token", "ſecret", "Key", "'", '"', " ", ":", "=", "AKIA", "ABCDEF0123456789", "abcdef0123456789", "xY+/_.=-", "0", "\n", "é", "\U0001f600"]), max_size=14))
@settings(max_examples=400, deadline=None)
def test_base_patterns(parts):
    text = "".join(parts)
    assert [x for x in scan(text) if x[1] < 3] == brute_base(text)


@pytest.mark.parametrize("name, data", [("pkcs1", PKCS1), ("sec1", SEC1), ("pkcs8", PKCS8), ("encrypted", ENCRYPTED), ("openssh", OPENSSH)])
def test_key_encodings(name, data):
    assert key_encoding(data) == name
    for bad in (data[:-1], data + b"\0", data[:1] + bytes([data[1] ^ 1]) + data[2:]):
        assert key_encoding(bad) is None
    kinds = lambda t: {KINDS[k] for _, k, _ in scan(t)}
    wrapped = "\n".join(re.findall(".{1,64}", base64.b64encode(data).decode()))
    assert "key_base64" in kinds(f"see {base64.b64encode(data).decode()} there")
    assert "key_base64" in kinds(f"see {url64(data)} there")
    assert "key_hex" in kinds(f"see {data.hex()} there") and "key_hex" in kinds(f"see {data.hex().upper()} there")
    assert "pem" in kinds(f"x\n-----BEGIN PRIVATE KEY-----\n{wrapped}\n-----END PRIVATE KEY-----\ny")
    assert not kinds(base64.b64encode(data[:-2]).decode()) - {"hex"}


@pytest.mark.parametrize("data", [PKCS1, SEC1, PKCS8, ENCRYPTED, OPENSSH])
def test_split_and_prefixed_candidates(data):
    def spans(text, kind):
        return [text[a:b] for a, k, b in scan(text) if KINDS[k] == kind]

    h, b = data.hex(), base64.b64encode(data).decode()
    assert spans(f"k = 0x{h};", "key_hex") == [h]
    colons = ":".join(re.findall("..", h))
    assert spans(f"k {colons} x", "key_hex") == [colons]
    for by in ("\n", "\r\n", "\n    ", "\\n"):
        lines = by.join(re.findall(".{1,32}", h))
        assert spans(f"k {lines} x", "key_hex") == [lines]
        lines = by.join(re.findall(".{1,64}", b))
        if len(b) > 64:
            assert spans(f"k {lines} x", "key_base64") == [lines]
    rows = ":\n    ".join(re.findall(".{1,44}(?=:|$)", colons)).replace("::", ":").replace("    :", "    ")
    assert spans(f"priv:\n    {rows}\nend", "key_hex") == [rows]
    assert spans(f"see /{b} there", "key_base64") == [b]
    assert spans(f"see data/keys/{b} there", "key_base64") == [b]
    assert spans(f'"key\\n{b}"', "key_base64") == [b]


def test_token_behind_a_dotted_name():
    for name in ("endpoint.auth", "eyelid1234.auth", "e.e", "extremes.x"):
        text = f"{name}.{TOKEN}"
        assert scan(text) == [(len(name) + 1, 4, len(text))]


def test_split_candidates_take_linear_time():
    for piece in ("30:82:", "/MIIE", "30:82:01:", "ab\n", "65:79:", "MIIE" + "A" * 60 + "\n", "eyaaaaaa.", "\\nMIIE"):
        scan(piece * (300_000 // len(piece)))


def test_random_bytes_are_no_keys():
    for i in range(300):
        b = b"\x30" + os.urandom(60 + i)
        assert not {KINDS[k] for _, k, _ in scan(base64.b64encode(b).decode())} - {"hex", "assign"}
    assert not scan("-----BEGIN PRIVATE KEY-----\nbm90IGEga2V5\n-----END PRIVATE KEY-----")


def test_signed_tokens():
    at = scan(f"bearer {TOKEN}, done")
    assert at == [(7, 4, 7 + len(TOKEN))]
    head, body, sign = TOKEN.split(".")
    assert not scan(f"{head}.{url64(b'plain words')}.{sign}") and not scan(f"{url64(b'{}')}aaaa.{body}.{sign}")
    assert not scan("e.g. this.that.other and eyes.are.not tokens")
    inner = base64.b64encode(TOKEN.encode()).decode()
    assert [KINDS[k] for _, k, _ in scan(inner)] == ["key_base64"]


def test_places_are_code_points():
    text = f"\U0001f600\U0001f600 {TOKEN}"
    assert scan(text)[0][0] == 3 and text[slice(scan(text)[0][0], scan(text)[0][2])] == TOKEN


def test_long_texts_take_linear_time():
    for piece in ("token", "eyJ", "a.", "A" * 31 + " ", "ab" * 20, "-----BEGIN PRIVATE KEY-----", "password  ", "AKIA"):
        scan(piece * (1_000_000 // len(piece)))


def test_empty_and_clashes(spark):
    assert cases.rows(secrets(cases.docs(spark, []))) == []
    cases.same_with_clashes(cases.docs(spark), secrets)


def naive_key(b):
    """Private keys by a second parser, which builds a tree: (tag, bytes or children) or None."""

    def tree(b):
        out = []
        while b:
            if len(b) < 2:
                return None
            tag, n, b = b[0], b[1], b[2:]
            if n > 127:
                k = n - 128
                if not 1 <= k <= 4 or len(b) < k or b[0] == 0 or (n := int.from_bytes(b[:k], "big")) < 128:
                    return None
                b = b[k:]
            if len(b) < n:
                return None
            out.append((tag, b[:n]))
            b = b[n:]
        return out

    def whole(b):
        t = tree(b)
        return t is not None and len(t) == 1 and t[0][0] == 0x30 and tree(t[0][1])

    parts = whole(b)
    if not parts:
        return False
    tags = [t for t, _ in parts]
    small = lambda k: int.from_bytes(parts[k][1], "big")
    algorithm = lambda k: (t := tree(parts[k][1])) and t[0][0] == 6 and len(t[0][1]) > 0
    if tags[:9] == [2] * 9:
        return small(0) < 2 and small(1) >> 255 > 0 and small(2) % 2 == 1
    if tags == [2] * 6:
        return small(0) == 0 and small(1) >> 255 > 0
    if tags[:2] == [2, 4]:
        return small(0) == 1 and 16 <= len(parts[1][1]) <= 80 and all(t in (0xA0, 0xA1) for t in tags[2:])
    if tags[:3] == [2, 0x30, 4]:
        return bool(small(0) < 2 and algorithm(1) and tree(parts[2][1]))
    return bool(tags == [0x30, 4] and algorithm(0) and len(parts[1][1]) % 8 == 0 and len(parts[1][1]) >= 32)


def test_added_spans_by_brute_force():
    """Texts of words that are keys, tokens, and damaged ones: a word's span is there if a second parser takes its bytes
    for a key, or json reads its parts as a token's, and no other span is added."""
    r = random.Random(4)
    whole = [PKCS1, SEC1, PKCS8, ENCRYPTED]

    def damaged(b):
        b = bytearray(b)
        for _ in range(r.choice((0, 0, 1, 1, 2, 3))):
            way, at = r.randrange(4), r.choice((r.randrange(min(12, len(b))), r.randrange(len(b))))
            if way == 0:
                b[at] = r.randrange(256)
            elif way == 1:
                del b[at]
            elif way == 2:
                b.insert(at, r.randrange(256))
            else:
                b[at] ^= 1
        return bytes(b)

    seen = {"key_base64": 0, "key_hex": 0, "token": 0}
    for _ in range(400):
        text, want = "", set()
        for _ in range(r.randint(1, 6)):
            kind = r.choice(("key_base64", "key_hex", "token", ""))
            if kind == "":
                word = cases.prose(r.randint(1, 9), r.randrange(99)).replace("\n", " ")
                good = False
            elif kind == "token":
                head = r.choice(({"alg": "HS256"}, {"alg": 5}, {"typ": "JWT"}, ["alg"], {"alg": "RS256", "kid": "k"}))
                body = r.choice((b'{"sub":"1","n":12345}', b'{"sub":', b"plain text here", b'["a"]'))
                word = ".".join((url64(json.dumps(head).encode()), url64(body), url64(b"signed by someone")))
                good = isinstance(head, dict) and isinstance(head.get("alg"), str) and body[-1:] in b"}]"
            else:
                data = damaged(r.choice(whole))
                word = r.choice((data.hex(), data.hex().upper())) if kind == "key_hex" else r.choice((base64.b64encode(data).decode(), url64(data)))
                good = naive_key(data)
            text += r.choice((" ", "\n\n", "\u00e9 ", "; "))
            if good:
                want.add((len(text), kind, len(text) + len(word)))
                seen[kind] += 1
            text += word + r.choice((" ", ", ", "\n. "))
        got = {(a, KINDS[k], b) for a, k, b in scan(text) if k > 2}
        assert got == want, text
    assert min(seen.values()) > 60


@pytest.mark.parametrize(
    "heads, size, good",
    [
        ("Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{iv16}", 64, True),
        ("Proc-Type: 4,ENCRYPTED\nDEK-Info: DES-EDE3-CBC,{iv8}", 40, True),
        ("Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{iv16}", 60, False),
        ("Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{iv8}", 64, False),
        ("Proc-Type: 4,ENCRYPTED\nDEK-Info: NONE,{iv16}", 64, False),
        ("Proc-Type: 4,ENCRYPTED", 64, False),
        ("Proc-Type: 4,CLEAR\nDEK-Info: AES-128-CBC,{iv16}", 64, False),
        ("DEK-Info: AES-128-CBC,{iv16}", 64, False),
        ("Proc-Type", 64, False),
    ],
)
def test_enciphered_blocks_say_how(heads, size, good):
    """Old-style enciphered keys count only with their fields parsed and a body of whole blocks."""
    body = base64.b64encode(bytes(i * 7 % 251 for i in range(size))).decode()
    heads = heads.format(iv16="0123456789abcdef" * 2, iv8="0123456789ABCDEF")
    text = f"x -----BEGIN RSA PRIVATE KEY-----\n{heads}\n\n{body[:64]}\n{body[64:]}\n-----END RSA PRIVATE KEY----- y"
    for t in (text, text.replace("\n", "\\n"), text.replace("\n", "\r\n")):
        assert (3 in [k for _, k, _ in scan(t)]) == good
