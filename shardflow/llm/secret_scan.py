"""Secret scans with structural confirmation: candidates are decoded and parsed before they are reported."""

from __future__ import annotations

import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from shardflow.llm.common import on_batches, pick

#: In the order in which equal starts are listed; the last four are confirmed by structure.
KINDS = ("assign", "access", "hex", "pem", "token", "key_base64", "key_hex")

# Over the text with A-Z lower-cased, which keeps every place.
_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
_NAMES = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_LONG_HEX = re.compile(r"(?<![0-9A-Za-z])(?:0[xX])?((?:[0-9a-fA-F]{2}){24,})(?![0-9A-Za-z])")
#: Hex digits with colons or line breaks (escaped ones, too) between them.
_SPLIT_HEX = re.compile(r"(?<![0-9A-Za-z])(?:0[xX])?([0-9a-fA-F](?:(?::|:?(?:\\r)?\\n|:?\r?\n[ \t]*)?[0-9a-fA-F]){47,}+)")
_DIGIT = re.compile(r"(?<!\\)[0-9a-fA-F]")
#: How keys, tokens and PEM blocks begin in hex, besides DER.
_HEX_HEADS = re.compile(r"6f70656e737368|657[7-a]|2d2d2d2d2d42")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}")
#: A line that goes on with a base64 string.
_NEXT = re.compile(r"(?:\r?\n[ \t]*|(?:\\r)?\\n)([A-Za-z0-9+/_-]+={0,2})")
_CUT = re.compile(r"[/+_-]")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(e[w-z][A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)(?:\.[A-Za-z0-9_-]+){0,2}")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----")
#: Ciphers that DEK-Info names, by how their names begin, and the bytes of a block.
_CIPHERS = (("AES-", 16), ("CAMELLIA-", 16), ("SEED-", 16), ("DES-", 8), ("RC2-", 8), ("BF-", 8), ("CAST5-", 8), ("IDEA-", 8))
_URL = str.maketrans("-_", "+/")


def unbase64(s: str) -> bytes | None:
    """Bytes of a standard or URL-safe base64 string, with or without padding; None if it isn't one."""
    s = s.rstrip("=").translate(_URL)
    if len(s) % 4 == 1:
        return None
    try:
        return binascii.a2b_base64(s + "=" * (-len(s) % 4), strict_mode=True)
    except (binascii.Error, ValueError):
        return None


def elements(b: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, stop) of the DER elements that fill b[at:end] exactly; None if lengths don't nest."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, n = b[at], b[at + 1]
        at += 2
        if n & 0x80:
            size = n & 0x7F
            if not 1 <= size <= 4 or at + size > end or not b[at]:
                return None
            n = int.from_bytes(b[at : at + size], "big")
            at += size
            if n < 0x80:
                return None
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        at += n
    return out


def key_encoding(b: bytes) -> str | None:
    """Which private key's encoding fills b: pkcs1, dsa, sec1, pkcs8, encrypted or openssh."""
    if b.startswith(b"openssh-key-v1\0"):
        at = 15
        for k in range(6):  # cipher, kdf, its options, how many keys, public key, private part
            if at + 4 > len(b):
                return None
            n = int.from_bytes(b[at : at + 4], "big")
            at += 4
            if k == 3:
                if not 1 <= n <= 16:
                    return None
                continue
            if at + n > len(b):
                return None
            at += n
        return "openssh" if at == len(b) else None
    if not b.startswith(b"\x30"):
        return None
    top = elements(b, 0, len(b))
    if not top or len(top) != 1 or not (inner := elements(b, *top[0][1:])):
        return None
    tags = [t for t, _, _ in inner]
    value = lambda k: int.from_bytes(b[inner[k][1] : inner[k][2]], "big")
    if len(tags) >= 9 and tags[:9] == [2] * 9 and value(0) in (0, 1) and value(1).bit_length() >= 256 and value(2) & 1:
        return "pkcs1"
    if tags == [2] * 6 and value(0) == 0 and value(1).bit_length() >= 256:
        return "dsa"
    if len(tags) >= 2 and tags[0] == 2 and value(0) == 1 and tags[1] == 4 and 16 <= inner[1][2] - inner[1][1] <= 80 and set(tags[2:]) <= {0xA0, 0xA1}:
        return "sec1"

    def algorithm(k: int) -> bool:
        parts = elements(b, *inner[k][1:])
        return bool(parts) and parts[0][0] == 6 and parts[0][2] > parts[0][1]

    if len(tags) >= 3 and tags[:3] == [2, 0x30, 4] and value(0) in (0, 1) and algorithm(1) and elements(b, *inner[2][1:]):
        return "pkcs8"
    if tags == [0x30, 4] and algorithm(0) and (inner[1][2] - inner[1][1]) % 8 == 0 and inner[1][2] - inner[1][1] >= 32:
        return "encrypted"
    return None


def signed_token(head: str, body: str) -> bool:
    """Whether the parts are those of a signed or encrypted token: a JSON header that names an algorithm, and JSON
    claims (for encrypted ones, whose header names the content's algorithm, any base64)."""
    raw, rest = unbase64(head), unbase64(body)
    try:
        header = json.loads(raw) if raw is not None and rest is not None else None
        if not isinstance(header, dict) or not isinstance(header.get("alg"), str):
            return False
        return "enc" in header or isinstance(json.loads(rest), (dict, list))
    except (ValueError, RecursionError):
        return False


def _inside(b: bytes | None) -> bool:
    """Whether decoded bytes are a key, a PEM block or a signed token."""
    if not b:
        return False
    if b[:1] == b"0" or b.startswith(b"openssh-key-v1\0"):
        return key_encoding(b) is not None
    if b[:1] in (b"e", b"-"):
        try:
            text = b.decode("ascii")
        except UnicodeDecodeError:
            return False
        m = _TOKEN.fullmatch(text.strip())
        return bool(m and signed_token(m[1], m[2])) or any(True for _ in _pems(text))
    return False


def _pems(text: str) -> Iterator[tuple[int, int]]:
    for m in _PEM.finditer(text):
        end = f"-----END {m[1]}PRIVATE KEY-----"
        again = text.find("-----BEGIN ", m.end())
        stop = text.find(end, m.end(), again if again >= 0 else len(text))
        if stop < 0:
            continue
        lines = [x.strip() for x in text[m.end() : stop].replace("\\r", "").replace("\\n", "\n").split("\n")]
        heads = dict(x.split(":", 1) for x in lines if ":" in x)
        body = unbase64("".join("".join(x for x in lines if ":" not in x).split()))
        if body and (key_encoding(body) or _enciphered(heads, body)):
            yield m.start(), stop + len(end)


def _enciphered(heads: dict[str, str], body: bytes) -> bool:
    """Whether a PEM block's header fields say that its body is enciphered, by which cipher, with an initial vector of that
    cipher's block, and whether the body has whole blocks."""
    kind = [x.strip() for x in heads.get("Proc-Type", "").split(",")]
    name, _, vector = heads.get("DEK-Info", "").strip().partition(",")
    block = next((n for c, n in _CIPHERS if name.upper().startswith(c)), 0)
    if kind != ["4", "ENCRYPTED"] or not block or not re.fullmatch(rf"[0-9A-Fa-f]{{{2 * block}}}", vector.strip()):
        return False
    return len(body) >= 32 and len(body) % block == 0


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Signed tokens; what fails gives up its first part alone."""
    at = 0
    while m := _TOKEN.search(text, at):
        good = signed_token(m[1], m[2])
        if good:
            yield m.start(), m.end()
        at = m.end() if good else m.end(1)


def _der_size(head: bytes) -> int | None:
    """Bytes of a DER sequence by its first bytes; None if they aren't such, or those of more than 64 KB."""
    if len(head) < 4 or head[0] != 0x30:
        return None
    n, size = head[1], head[1] & 0x7F
    if n < 0x80:
        return 2 + n
    return 2 + size + int.from_bytes(head[2 : 2 + size], "big") if 1 <= size <= 2 else None


def _wrapped(text: str, at: int, end: int, head: bytes) -> int | None:
    """Where a base64 string ends that begins at `at` and goes on in the lines after `end`: DER tells its length, others end
    with a line shorter than the first."""
    size = _der_size(head)
    if head[:1] == b"0" and size is None or head[:1] == b"e" and head[1:2] not in (b"w", b"x", b"y", b"z") or head[:1] == b"-" and not head.startswith(b"-----BEGIN"):
        return None
    need = -(-size * 4 // 3) if size else None
    if need and end - at > need + 2 or not _NEXT.match(text, end):
        return None
    pieces, n = [text[at:end]], end - at
    while (n < need if need else len(pieces) == 1 or len(pieces[-1]) >= len(pieces[0])) and (m := _NEXT.match(text, end)):
        pieces.append(m[1])
        n, end = n + len(m[1]), m.end()
    return end if len(pieces) > 1 and _inside(unbase64("".join(pieces))) else None


def _base64(text: str, pems: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Base64 of keys, in one line or several. A candidate that fails is tried again behind each sign that may also stand
    before base64, and behind the letter of an escaped line break."""
    done = 0
    for m in _BASE64.finditer(text):
        if m.end() <= done or any(a <= m.start() < b for a, b in pems):
            continue
        starts = [m.start()] if m.start() >= done else []
        if text[m.start() - 1 : m.start()] == "\\" and m[0][0] in "nrt":
            starts.append(m.start() + 1)
        starts += [m.start() + c.end() for c in _CUT.finditer(m[0])]
        full = m.start() + len(m[0].rstrip("="))
        for k, at in enumerate(starts):
            if at < done or k and text[at : at + 1] not in ("M", "Z", "L", "b"):
                continue
            head = unbase64(text[at : min(at + 16, m.end())])
            if not head or not (head[:1] in b"0e-" or head.startswith(b"openssh")):
                continue
            if k and at != starts[-1] and head[:1] in b"e-":
                continue  # base64 of tokens and PEM blocks has none of the signs
            size = _der_size(head)
            whole = not k or (size is None and head[:1] != b"0") or (size is not None and -(-size * 4 // 3) == full - at)
            end = m.end() if whole and _inside(unbase64(text[at : m.end()])) else _wrapped(text, at, m.end(), head)
            if end:
                yield at, end
                done = end
                break


def _split_hex(text: str) -> Iterator[tuple[int, int]]:
    """Hex of keys with separators. A key begins a candidate or follows a separator; DER tells its length, others fill the
    rest of the candidate."""
    for m in _SPLIT_HEX.finditer(text):
        places = [d.start() + m.start(1) for d in _DIGIT.finditer(m[1])]
        if places[-1] - places[0] == len(places) - 1:
            continue  # no separator
        digits, done = "".join(text[p] for p in places).lower(), 0
        for i, p in enumerate(places):
            if i < done or i and places[i - 1] == p - 1:
                continue
            if digits[i] == "6" and digits.startswith("65", i) and i > 1 and re.match("[A-Za-z0-9_-]", chr(int(digits[i - 2 : i], 16))):
                continue  # a token doesn't begin inside a word, in hex as in text
            if digits.startswith("30", i):
                size = _der_size(bytes.fromhex(digits[i : i + 8])) if len(digits) - i >= 8 else None
                end = i + 2 * size if size else 0
            else:
                end = i + (len(digits) - i) // 2 * 2 if _HEX_HEADS.match(digits, i) else 0
            if not i + 48 <= end <= len(digits) or not _inside(bytes.fromhex(digits[i:end])):
                continue
            stop = places[end - 1] + 1
            if places[end - 1] - p > end - 1 - i and not re.match("[0-9A-Za-z]", text[stop : stop + 1]):
                yield p, stop
                done = end


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) in code points, sorted."""
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    out = []
    if any(n in low for n in _NAMES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(low) if m.end(1) - m.start(1) >= 12]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "PRIVATE KEY-----" in text:
        out += [(a, 3, b) for a, b in _pems(text)]
    if "." in text and "e" in text:
        out += [(a, 4, b) for a, b in _tokens(text)]
    out += [(a, 5, b) for a, b in _base64(text, [(a, b) for a, k, b in out if k == 3])]
    for m in _LONG_HEX.finditer(text):
        if m[1][:2] in ("30", "65", "2d", "2D", "6f", "6F") and _inside(bytes.fromhex(m[1])):
            out.append((m.start(1), 6, m.end()))
    out += [(a, 6, b) for a, b in _split_hex(text)]
    return sorted(out)


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_confirmed, base_sha256, spans for every row.

    assign, access and hex are found by pattern. Base64 and hex candidates, PEM blocks and dotted triples are
    decoded and reported only if their structure holds: DER whose nested lengths fill the bytes exactly and whose
    members are those of a private key, an OpenSSH container, or a token whose header is JSON that names an
    algorithm. Work is linear in the text. Null texts count as empty: no spans, the digest of nothing. Rows that repeat
    give equal rows; ids aren't interpreted; an empty table gives no rows; other columns are ignored.
    """
    base = pick(docs, doc_id=id_col, text=text_col)
    kind = base.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_confirmed", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1):
                found = scan(t.as_py() or "")
                n = [sum(k == j for _, k, _ in found) for j in range(3)]
                plain = digest([x for x in found if x[1] < 3])
                rows.append((*n, len(found) - sum(n), hashlib.sha256(plain.encode()).hexdigest(), digest(found)))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    return on_batches(base, run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_confirmed bigint, base_sha256 string, spans string")
