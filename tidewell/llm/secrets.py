"""9. Secret scan with structural confirmation.

Three plain patterns give the base spans.  The method then adds spans whose
*structure* proves what they are: a candidate run of base64 or hex characters is
decoded and reported only if it parses as

* `der`  - ASN.1: a SEQUENCE whose nested lengths add up exactly and whose first
  members fit a key, an encrypted key or a certificate;
* `ssh`  - a public key blob or private key container of length-prefixed strings
  that fill it exactly, with a known algorithm name;
* `jwt`  - three dot-joined base64url parts whose header is a JSON object that
  names an algorithm and whose payload is a JSON object;
* `pem`  - a private key in PEM form whose headers say that it is encrypted and name a
  cipher, and whose body decodes to whole cipher blocks.

A run may be wrapped over lines or joined from quoted pieces; its own lengths say where it
ends.  One pass over whole texts, no shuffle; the work is linear in the text, whatever it
holds, but that each line of a wrapped run may claim to begin a key of up to 64 KB.
Nulls count as empty texts (no spans), repeated rows each get a row, an empty table
gives an empty result; spans are in code points, end exclusive, and of spans that start
alike the kinds come as listed.  Further columns are neither read nor returned
(mask_secrets returns them as they are, nulls included).
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewell.llm.common import column_at, map_text, pick, text_batches

Span = tuple[str, int, int]
KINDS = ("assign", "access", "hex", "der", "ssh", "jwt", "pem")

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A maximal run of 24 or more: the same as dropping the shorter ones of all maximal runs.
HEX = re.compile(r"[0-9a-f]{24,}")
#: A value may stand right after '='; runs that are cut wrongly do not decode to a structure.
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}")
HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{48,}")
#: The first letter says that the header begins with a brace or white space.
JWT = re.compile(r"(?<![A-Za-z0-9_.-])([eICD][A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
#: The body may be escaped as in JSON: line ends as \n, \r or \u000a, slashes as \/.
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----((?:[A-Za-z0-9+/=\s]|\\+(?:[nrt/]|u000[9aAdD]))+)-----END \1-----")
#: PEM headers say how the body is encrypted: the body follows an empty line.
BEGIN_LOCKED = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,30}PRIVATE KEY)-----[ \t\r]*\n")
BODY_LINE = re.compile(r"[A-Za-z0-9+/=]*").fullmatch
HEADER_NAME = re.compile(r"[A-Za-z-]{1,30}").fullmatch
#: What may stand between two pieces of a value: a line end, or the quotes of two string literals that are joined.
GAP = r"""(?:\r?\n[ \t]{0,80}|["'][ \t]{0,80}(?:[+.\\][ \t]{0,80})?(?:\r?\n[ \t]{0,80})?(?:[+.][ \t]{0,80})?["'])"""
#: Runs of base64 or hex in two pieces or more, the last of which may be short.
WRAPPED = {
    "base64": re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/]{{40,}}(?:{GAP}[A-Za-z0-9+/]+)+={{0,2}}"),
    "hex": re.compile(rf"(?<![0-9A-Fa-f])[0-9A-Fa-f]{{32,}}(?:{GAP}[0-9A-Fa-f]+)+"),
}
GAP_AT = re.compile(GAP)
PEM_GAPS = re.compile(r"\\+(?:[nrt]|u000[9aAdD])|\\+(?=/)|\s+")
#: Names of SSH key types, and of how many fields a public key of the type has.
SSH_FIELDS = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"ecdsa-sha2-": 3, b"sk-ssh-": 3, b"sk-ecdsa-": 4}
SSH_NAMES = tuple(SSH_FIELDS)


def decode64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_parts(data: bytes, a: int, b: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill data[a:b] exactly, or None."""
    parts = []
    while a < b:
        if b - a < 2:
            return None
        tag, n, a = data[a], data[a + 1], a + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or a + k > b:
                return None
            n, a = int.from_bytes(data[a : a + k], "big"), a + k
        if a + n > b:
            return None
        parts.append((tag, a, a + n))
        a += n
    return parts


def nested(data: bytes, parts: list[tuple[int, int, int]], depth: int = 0) -> bool:
    """Do all constructed values below divide up exactly too?"""
    for tag, a, b in parts:
        if tag & 0x20 and depth < 12:
            inner = der_parts(data, a, b)
            if inner is None or not nested(data, inner, depth + 1):
                return False
    return True


def is_der_key(data: bytes) -> bool:
    if len(data) < 16 or data[0] != 0x30:
        return False
    top = der_parts(data, 0, len(data))
    if top is None or len(top) != 1:
        return False
    parts = der_parts(data, *top[0][1:])
    if not parts or len(parts) < 2 or not nested(data, parts):
        return False
    tags = [t for t, _, _ in parts]
    inner = lambda k: [t for t, _, _ in der_parts(data, *parts[k][1:]) or []]
    if all(t == 0x02 for t in tags):  # numbers only: an RSA or DSA key
        return len(tags) == 2 or len(tags) in (6, 9)
    if tags[0] == 0x02 and tags[1] == 0x04:  # an elliptic-curve private key
        return True
    if tags[0] == 0x02 and tags[1] == 0x30 and 0x04 in tags[2:3]:  # a wrapped private key
        return inner(1)[:1] == [0x06]
    if tags[0] == 0x30 and tags[1] in (0x03, 0x04):  # a public key, or an encrypted private one
        return inner(0)[:1] == [0x06]
    return tags == [0x30, 0x30, 0x03] and inner(1)[:1] == [0x06]  # a certificate


def is_ssh_key(data: bytes) -> bool:
    if data.startswith(b"openssh-key-v1\0"):
        return len(data) >= 40
    if len(data) < 15 or data[:3] != b"\0\0\0":
        return False
    fields, a = [], 0
    while a < len(data):
        n = int.from_bytes(data[a : a + 4], "big")
        if a + 4 + n > len(data):
            return False
        fields.append(data[a + 4 : a + 4 + n])
        a += 4 + n
    return len(fields) >= 2 and fields[0].startswith(SSH_NAMES)


def is_signed_token(header: str, payload: str) -> bool:
    try:
        h, p = (json.loads(decode64(x) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(h, dict) and isinstance(h.get("alg"), str) and isinstance(p, dict)


def decode(chars: str, alphabet: str) -> bytes | None:
    if alphabet == "base64":
        return decode64(chars)
    return bytes.fromhex(chars) if len(chars) % 2 == 0 else None


def key_length(head: bytes) -> int | None:
    """Bytes of the key that begins with `head`, as its own first lengths say, or None if none begins so; SSH public keys need all their fields in `head`."""
    if len(head) >= 16 and head[0] == 0x30 and head[1] in (0x81, 0x82):
        k = head[1] & 0x7F
        return 2 + k + int.from_bytes(head[2 : 2 + k], "big")
    if head[:3] == b"\0\0\0" and head[4:].startswith(SSH_NAMES):
        fields = next(n for name, n in SSH_FIELDS.items() if head[4:].startswith(name))
        at = 0
        for _ in range(fields):
            if at + 4 > len(head):
                return None
            at += 4 + int.from_bytes(head[at : at + 4], "big")
        return at
    return None


def wrapped_keys(text: str, start: int, end: int, alphabet: str) -> list[Span]:
    """Keys among the pieces of text[start:end], each from the start of a piece to the end of one.

    A key's own lengths say where it ends, so lines after it, whatever they hold, do no
    harm.  They are at most 65,539 bytes; each piece is tried as a start once.
    """
    pieces, at = [], start
    for gap in GAP_AT.finditer(text, start, end):
        pieces.append((at, gap.start()))
        at = gap.end()
    pieces.append((at, end))

    def chars(i: int, most: int) -> str:
        out, n = [], 0
        while i < len(pieces) and n < most:
            out.append(text[pieces[i][0] : pieces[i][1]])
            n, i = n + len(out[-1]), i + 1
        return "".join(out)[:most]

    spans, i = [], 0
    while i < len(pieces):
        per = (4, 3) if alphabet == "base64" else (2, 1)
        first = chars(i, 32)
        head = decode(first[: len(first) // 4 * 4].rstrip("="), alphabet) or b""
        if head[:3] == b"\0\0\0" and head[4:].startswith(SSH_NAMES):  # all fields may be needed
            whole = chars(i, 24_000).rstrip("=")
            head = decode(whole[: len(whole) // 4 * 4], alphabet) or b""
        length = key_length(head)
        if length is None:
            i += 1
            continue
        need, j = -(-length * per[0] // per[1]), i
        while j < len(pieces) and need > (n := len(text[pieces[j][0] : pieces[j][1]].rstrip("="))):
            need, j = need - n, j + 1
        kind = None
        if j > i and j < len(pieces) and need == n:  # it ends where a piece ends, and is not in one piece alone
            data = decode("".join(text[a:b] for a, b in pieces[i : j + 1]), alphabet)
            kind = ("der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None) if data else None
        if kind:
            spans.append((kind, pieces[i][0], pieces[j][1]))
        i = j + 1 if kind else i + 1
    return spans


def locked_keys(text: str) -> list[Span]:
    """Encrypted PEM bodies, line by line: a marker, headers, an empty line, the body, the same marker's end.

    Reading stops at the first line that does not fit, and no line fits that has a marker, so
    no line is read for two markers.
    """
    spans = []
    for m in BEGIN_LOCKED.finditer(text):
        at, headers, state, body = m.end(), [], "headers", None
        stop = f"-----END {m[1]}-----"
        while at < len(text):
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            line = text[at:end].strip(" \t\r\f\v")
            if state == "headers":
                name, colon, value = line.partition(":")
                if colon and HEADER_NAME(name) and value.strip():
                    headers.append((name, value))
                elif not line:
                    state = "body" if headers else state
                else:
                    break
            elif line.startswith(stop) and body:
                data = decode64("".join(text[body[0] : body[1]].split()))
                said = dict(headers)
                if data and len(data) % 8 == 0 and "ENCRYPTED" in said.get("Proc-Type", "") and "DEK-Info" in said:
                    spans.append(("pem", body[0], at + text[at:end].index(stop)))
                break
            elif not BODY_LINE(line):
                break
            elif line or body:
                body = (body[0] if body else at, end)
            at = end + 1
    return spans


def base_spans(text: str) -> list[Span]:
    spans: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return spans


def confirmed_spans(text: str) -> list[Span]:
    spans: set[Span] = set()
    spans |= {("jwt", m.start(), m.end()) for m in JWT.finditer(text) if is_signed_token(m[1], m[2])}
    blocks = [(m.start(2), m.end(2), PEM_GAPS.sub("", m[2])) for m in PEM.finditer(text)] if "-----BEGIN " in text else []
    blocks += [(m.start(), m.end(), m[0]) for m in RUN.finditer(text)]
    for a, b, run in blocks:
        data = decode64(run)
        if data and is_der_key(data):
            spans.add(("der", a, b))
        elif data and is_ssh_key(data):
            spans.add(("ssh", a, b))
    armoured = [(a, b) for a, b, _ in blocks if text[a:b].strip() != text[a:b] or "\\" in text[a:b]]
    for alphabet, pattern in WRAPPED.items():
        inside = 0  # armoured blocks and matches both come in order
        for m in pattern.finditer(text):
            while inside < len(armoured) and armoured[inside][1] < m.end():
                inside += 1
            if inside < len(armoured) and armoured[inside][0] <= m.start():
                continue
            data = decode("".join(GAP_AT.split(m[0])), alphabet)
            if data and (is_der_key(data) or is_ssh_key(data)):
                spans.add(("der" if is_der_key(data) else "ssh", m.start(), m.end()))
            else:
                spans.update(wrapped_keys(text, m.start(), m.end(), alphabet))
    if "PRIVATE KEY-----" in text:
        spans.update(locked_keys(text))
    for m in HEX_RUN.finditer(text):
        if len(m[0]) % 2 == 0:
            data = bytes.fromhex(m[0])
            if is_der_key(data):
                spans.add(("der", m.start(), m.end()))
            elif is_ssh_key(data):
                spans.add(("ssh", m.start(), m.end()))
    return list(spans)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, all): the base spans and all spans of each row, as arrays of (kind, start, end)."""
    one = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            base = [in_order(base_spans(t)) for t in texts]
            every = [in_order(b + confirmed_spans(t)) for b, t in zip(base, texts, strict=True)]
            rows = lambda x: pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans] for spans in x], pa.list_(one))
            yield pa.record_batch([batch.column(0), rows(base), rows(every)], names=["doc_id", "base", "all"])

    spans = "array<struct<kind:string,start:long,end:long>>"
    return map_text(pick(df, id_col, text_col), run, f"doc_id long, base {spans}, `all` {spans}")


def digest(base: str) -> str:
    return hashlib.sha256(base.encode()).hexdigest()


def mask(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """The text with each span, or run of overlapping spans, replaced by a mark."""
    out, at, end = [], 0, -1
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if a >= end:
            out += [text[max(at, end, 0) : a], mark]
        at = end = max(end, b)
    return "".join(out) + text[max(end, 0) :] if out else text


def mask_secrets(df: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """`df` with the secrets in its text masked; rows without any, and further columns of any name, are unchanged.

    `length_col` names an integer column, if there is one, that holds the text's length; it is kept true.
    """
    names, schema = df.columns, df.schema
    at = column_at(df, text_col)
    n = column_at(df, length_col) if length_col else None
    if n is not None and not isinstance(schema[n].dataType, T.IntegralType):
        raise TypeError(f"{names[n]} is no integer column")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in text_batches(batches, name=names[at]):
            texts = batch.column(at).to_pylist()
            masked = [t and mask(t, base_spans(t) + confirmed_spans(t)) for t in texts]
            columns = list(batch.columns)
            columns[at] = pa.array(masked, batch.column(at).type)
            if n is not None:
                columns[n] = pa.array([old if m == t else len(m) for old, m, t in zip(batch.column(n).to_pylist(), masked, texts, strict=True)], batch.column(n).type)
            yield pa.record_batch(columns, names=batch.schema.names)

    return df.mapInArrow(run, schema)
