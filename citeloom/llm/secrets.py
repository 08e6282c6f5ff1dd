"""Secret scans: patterns, and candidates whose decoded structure confirms them."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns, and the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE, LEAST_ACCESS = 8, 16

#: Kinds in the order in which spans of one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")

_TOKEN = re.compile(r"(?<![\w.-])[\w-]{10,}+\.[\w-]{2,}+\.[\w-]*+", re.A)
_MARK = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ ){0,4}PRIVATE KEY)-----")
_HEADER = re.compile(r"[A-Za-z-]+: ?(.*)")
_DEK = re.compile(r"[A-Z0-9-]+,(?:[0-9A-Fa-f]{2}){8,16}")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{48,}+={0,2}")
_NEXT_LINE = re.compile(r"\r?\n[ \t]*")
_LAST_LINE = re.compile(r"\r?\n[ \t]*([A-Za-z0-9+/]++={0,2})(?![A-Za-z0-9+/=_-])")
_HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9a-f]{96,}|[0-9A-F]{96,})(?![0-9A-Fa-f])")

_SSH_MAGIC = b"openssh-key-v1\0"

# Object identifiers of private-key algorithms (RSA, RSA-PSS, DSA, EC, X25519, X448, Ed25519, Ed448) in DER.
_KEY_ALGORITHMS = tuple(map(bytes.fromhex, ("2a864886f70d010101", "2a864886f70d01010a", "2a8648ce380401", "2a8648ce3d0201", "2b656e", "2b656f", "2b6570", "2b6571")))


def decode64(s: str) -> bytes | None:
    """Base64 of either alphabet, with or without padding; None if it isn't."""
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of DER items that fill ``data`` exactly; None if lengths don't nest that way."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            size = n & 0x7F
            if not 1 <= size <= 4 or at + size > len(data):
                return None
            n = int.from_bytes(data[at : at + size], "big")
            if n < 0x80 or data[at] == 0:  # DER has the shortest form only
                return None
            at += size
        if at + n > len(data):
            return None
        items.append((tag, data[at : at + n]))
        at += n
    return items


def is_der_key(data: bytes) -> bool:
    """Whether ``data`` is one whole private key: PKCS 1, PKCS 8 (also encrypted), SEC 1 or of DSA."""
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = der_items(outer[0][1])
    if not inner:
        return False
    tags = [t for t, _ in inner]
    if tags[:9] == [0x02] * 9 and inner[0][1] in (b"\0", b"\1"):
        return all(len(v) >= 16 for _, v in (inner[1], inner[3]))
    if tags == [0x02] * 6 and inner[0][1] == b"\0":  # DSA: p, q, g, public and private value
        return len(inner[1][1]) >= 64 and all(len(v) >= 16 for _, v in inner[2:])
    if tags[:3] == [0x02, 0x30, 0x04] and inner[0][1] in (b"\0", b"\1"):
        algorithm = der_items(inner[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06 and algorithm[0][1] in _KEY_ALGORITHMS and bool(der_items(inner[2][1]))
    if tags[:2] == [0x02, 0x04] and inner[0][1] == b"\1":
        return len(inner[1][1]) in (20, 24, 28, 32, 48, 66)
    if tags == [0x30, 0x04]:
        algorithm = der_items(inner[0][1])
        return bool(algorithm) and algorithm[0][0] == 0x06 and algorithm[0][1].startswith(bytes.fromhex("2a864886f70d0105")) and len(inner[1][1]) % 8 == 0
    return False


def is_ssh_key(data: bytes) -> bool:
    """Whether ``data`` is one OpenSSH private key: magic, then strings whose lengths add up."""
    if not data.startswith(_SSH_MAGIC):
        return False
    at, parts = len(_SSH_MAGIC), []
    while at < len(data) and len(parts) < 6:
        if len(parts) == 3:  # how many keys
            parts.append(data[at : at + 4])
            at += 4
            continue
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return False
        parts.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return len(parts) == 6 and at == len(data) and parts[3] == b"\0\0\0\1" and bool(parts[5])


def is_signed_token(s: str) -> bool:
    """Whether the parts are those of a signed token: header and claims are JSON objects, the header names an algorithm, and there is a signature."""
    head, claims, signature = s.split(".", 2)
    if not decode64(signature):
        return False
    try:
        h, c = (json.loads(decode64(x) or b"") for x in (head, claims))
    except (ValueError, RecursionError):
        return False
    return isinstance(h, dict) and isinstance(c, dict) and isinstance(h.get("alg"), str) and h["alg"].lower() not in ("", "none")


def is_armoured_key(body: str) -> bool:
    """Whether what stands between the marks of an armoured key is one: base64 of a known structure, or headers of encryption and a ciphertext of whole blocks."""
    lines = [x.strip() for x in body.replace("\\r", "").replace("\\n", "\n").split("\n")]
    headers = {}
    while lines and (not lines[0] or ":" in lines[0]):
        name, _, value = lines.pop(0).partition(":")
        headers[name.strip()] = value.strip()
    data = decode64("".join("".join(lines).split()))
    if not data:
        return False
    if headers.get("Proc-Type") == "4,ENCRYPTED":
        return bool(_DEK.fullmatch(headers.get("DEK-Info", ""))) and len(data) >= 48 and len(data) % 8 == 0
    return is_der_key(data) or is_ssh_key(data)


def armoured(text: str) -> list[tuple[int, int, str]]:
    """Armoured keys: a begin mark and the end mark of its label that follows it, without another mark between."""
    found, begin = [], None
    for m in _MARK.finditer(text):
        if m[1] == "BEGIN":
            begin = m
        else:
            if begin and begin[2] == m[2] and is_armoured_key(text[begin.end() : m.start()]):
                found.append((begin.start(), m.end(), "pem"))
            begin = None
    return found


def tokens(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "jwt") for m in _TOKEN.finditer(text) if is_signed_token(m[0])] if "." in text else []


def _kind(data: bytes | None, *, nested: bool = True) -> str | None:
    """What decoded bytes are: a key, or a text that holds an armoured key or a signed token."""
    if not data:
        return None
    if is_der_key(data):
        return "der"
    if is_ssh_key(data):
        return "ssh"
    if nested and data.isascii() and (b"-----BEGIN " in data or data.count(b".") >= 2):
        inner = data.decode()
        return next((kind for _, _, kind in armoured(inner) + tokens(inner)), None)
    return None


def _wrapped(text: str) -> Iterator[tuple[int, int]]:
    """Runs of base64: single ones, then those of two lines or more, all as long as the first, with and without a shorter line after them."""
    lines: list[re.Match] = []

    def block() -> Iterator[tuple[int, int]]:
        begin, end = lines[0].start(), lines[-1].end()
        last = _LAST_LINE.match(text, end) if text[end - 1] != "=" else None
        if last and len(last[1]) <= len(lines[0][0]):
            yield begin, last.end()
        if len(lines) > 1:
            yield begin, end

    for m in _BASE64.finditer(text):
        yield m.span()
        if lines:
            gap = _NEXT_LINE.fullmatch(text, lines[-1].end(), m.start())
            if not gap or len(m[0].rstrip("=")) > len(lines[0][0]) or len(lines[-1][0]) != len(lines[0][0]):
                yield from block()
                lines = []
        lines.append(m)
    if lines:
        yield from block()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans whose content decodes to a key or signed token."""
    found = tokens(text)
    if "-----BEGIN " in text:
        found += armoured(text)
    for start, end in _wrapped(text):
        if kind := _kind(decode64("".join(text[start:end].split()))):
            found.append((start, end, kind))
    for m in _HEX_RUN.finditer(text):
        if kind := _kind(bytes.fromhex(m[0])) if len(m[0]) % 2 == 0 else None:
            found.append((m.start(), m.end(), kind))
    return found


def ordered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in every whole text: the base patterns, and what decoding confirms.

    Base: assignments, access ids and hex runs, leftmost and non-overlapping by kind. Added: signed tokens whose
    header and claims decode to JSON (jwt), armoured private keys (pem), base64 (of one line or wrapped over lines of one length) or hex runs that
    decode to a private key in DER (der) or OpenSSH's form (ssh), with all nested lengths right, or to a text that holds an armoured key or a
    signed token (of that kind). No span suppresses another. The time is in proportion to a text's length.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256 (hex of the base spans, kind:start:end by start and kind, joined by
    commas; code points, end exclusive), spans (all spans, joined likewise); one row for each input row. Null texts count as
    empty. Other columns are not carried; an empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, body in zip(batch.column("doc_id").to_pylist(), batch.column("body")):
                text = body.as_py()
                base = base_spans(text)
                kinds = [kind for _, _, kind in base]
                digest = hashlib.sha256(listed(ordered(base)).encode()).hexdigest()
                for column, x in zip(out, (doc_id, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), digest, listed(ordered(base + confirmed_spans(text))))):
                    column.append(x)
            yield pa.record_batch([pa.array(x, t) for x, t in zip(out, [pa.int64()] * 4 + [pa.string()] * 2)], names=names)

    return source.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str) -> str:
    """``text`` with what is secret in its spans, for assignments the value alone, replaced by ``[secret]``."""
    spans = [m.span(2) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    spans += [(s, e) for s, e, kind in base_spans(text) + confirmed_spans(text) if kind != "assign"]
    out, at, end = [], 0, -1
    for s, e in sorted(spans):
        if s > end:
            out += [text[at:s], "[secret]"]
        end = max(end, e)
        at = end
    return "".join([*out, text[at:]]) if spans else text


def redact_secrets(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with secrets in ``text_col`` redacted; all rows and columns stay, null texts null and an empty table empty."""

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(redact, na_action="ignore")

    return docs.withColumn(text_col, clean(F.col(text_col)))
