"""Secret scan: pattern candidates, then structural confirmation of what base64 and hex runs decode to."""

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

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Candidates for the structural checks.
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{10,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
#: Everything between the lines of a block, up to the next line of either kind.
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----((?:(?!-----(?:BEGIN|END) ).)*)-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----", re.DOTALL)
#: Line ends of a body: real ones, or their escapes in strings, any number of backslashes deep.
LINE_END = re.compile(r"\r\n?|\n|(?:\\+[rn])+")
#: What stands before the text of quoted, commented or concatenated lines, and after it.
LINE_LEAD = re.compile(r"""^[\s>#*;|"'`.,(-]*(?:(?:/+|\+)\s+)?["'`]*""")
LINE_TAIL = re.compile(r"""(?:\s\+)?[\s"'`.,;>#|)(\\*-]*$""")
PEM_HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*:\s")
DEK_INFO = re.compile(r"DEK-Info:\s*[A-Za-z0-9-]+,\s*(?:[0-9A-Fa-f]{2}){8,}\b")
#: The letter of an escaped line end before a run is not part of it.
BASE64_RUN = re.compile(r"(?:(?<=\\)[rn])?([A-Za-z0-9+/_-]{40,}={0,2})")
#: Lines of one width and a last one not wider, joined by real or escaped line ends and by what quotes or indents lines.
WRAP = r"""(?:[\x20\t"'`+.,)]|\\(?![rn]))*(?:\r\n?|\n|(?:\\+[rn])+)[\x20\t"'`+.,>#*;|(]*(?:/[/*]+\x20+)?(?:\r\n?|\n)?[\x20\t"'`>#*;|(]*"""
WIDE_LINE = re.compile(r"(?:(?<=\\)[rn])?([A-Za-z0-9+/_-]{40,})")
JOIN = re.compile(WRAP)
LAST_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}|={1,2}")
HEX_RUN = re.compile(r"(?<![0-9A-Za-z])(?:0[xX])?((?:[0-9a-fA-F]{2}){24,})(?![0-9A-Za-z])")
#: Order of kinds among spans that start at the same place.
KINDS = ("assign", "access", "hex", "pem", "signed", "openssh", "der")
OPENSSH_MAGIC = b"openssh-key-v1\x00"
SCHEMA = "spans array<struct<kind:string,start:int,end:int>>"


def decode_base64(run: str) -> bytes | None:
    """The bytes of a standard or URL-safe base64 run; None where it is not one."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """The (tag, content) items that fill ``data`` exactly under DER's definite, shortest lengths; else None."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, first = data[at], data[at + 1]
        at += 2
        if first < 0x80:
            n = first
        else:
            width = first & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            n = int.from_bytes(data[at : at + width], "big")
            at += width
            if n < 0x80 or n >> (8 * (width - 1)) == 0:
                return None
        if at + n > len(data):
            return None
        items.append((tag, data[at : at + n]))
        at += n
    return items


def is_private_der(data: bytes) -> bool:
    """A SEQUENCE whose nested lengths add up and that starts as a private key does: PKCS#1, PKCS#8, encrypted PKCS#8 or SEC 1."""
    if len(data) < 24 or data[0] != 0x30:
        return False
    outer = der_items(data)
    if not outer or len(outer) != 1:
        return False
    items = der_items(outer[0][1])
    if not items:
        return False
    tags = [tag for tag, _ in items]
    if tags[:1] == [0x02] and items[0][1] in (b"\x00", b"\x01"):
        integers = len(tags) >= 6 and all(tag == 0x02 for tag in tags[:6])  # PKCS#1 (9 integers) and DSA (6)
        wrapped = tags[1:3] == [0x30, 0x04] and bool(der_items(items[1][1]))  # PKCS#8
        curve = tags[1:2] == [0x04] and items[0][1] == b"\x01" and len(items[1][1]) >= 20  # SEC 1
        return integers or wrapped or curve
    return tags == [0x30, 0x04] and (der_items(items[0][1]) or [(0, b"")])[0][0] == 0x06 and len(items[1][1]) >= 16


def is_openssh(data: bytes) -> bool:
    """The magic, then length-prefixed cipher, key derivation and options, a key count and as many public keys."""
    if not data.startswith(OPENSSH_MAGIC):
        return False
    at = len(OPENSSH_MAGIC)

    def field() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data) or at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    if any(field() is None for _ in range(3)) or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return 1 <= keys <= 16 and all(field() is not None for _ in range(keys + 1))


def is_signed_token(header: str, payload: str, signature: str) -> bool:
    """The header decodes to a JSON object with "alg" and the payload to a JSON object; unsigned tokens only with alg none."""
    try:
        head, body = (json.loads(decode_base64(x) or b"") for x in (header, payload))
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(body, dict) or not isinstance(head.get("alg"), str):
        return False
    return bool(signature) or head["alg"].lower() == "none"


def key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "openssh" if is_openssh(data) else "der" if is_private_der(data) else None


def pem_kind(body: str) -> str | None:
    """What the body of a private-key block is, without escapes, line prefixes and headers; None where it does not parse.

    A body that its DEK-Info header calls encrypted has no structure left: the header and whole cipher blocks stand for it.
    """
    lines, sealed = [], False
    for line in LINE_END.split(body):
        line = LINE_TAIL.sub("", LINE_LEAD.sub("", line, count=1))
        if PEM_HEADER.match(line):
            sealed = sealed or bool(DEK_INFO.match(line))
        elif len(line) > 3 or re.search("[A-Za-z0-9=]", line):  # else only a comment sign or an operator
            lines.append(line)
    text = re.sub(r"\s+", "", "".join(lines))
    data = decode_base64(text)
    if sealed and data and len(data) >= 48 and len(data) % 8 == 0:
        return "encrypted"
    return key_kind(data)


def wrapped_runs(text: str) -> Iterator[tuple[str, int, int]]:
    """(base64, start, end) of full-width lines that follow each other, the last one of any width up to theirs.

    The run is tried from each line that can begin a key, and ends where the key's outer length says.
    """
    at = 0
    while m := WIDE_LINE.search(text, at):
        width, pieces = len(m[1]), [m.span(1)]
        at = m.end()
        while (j := JOIN.match(text, at)) and (n := LAST_LINE.match(text, j.end())) and len(n[0]) <= width:
            pieces.append(n.span())
            at = n.end()
            if len(n[0]) < width or n[0].endswith("="):
                break
        for k, (start, _) in enumerate(pieces[:-1]):
            head = decode_base64(text[start : start + 8]) or b""
            if head[:1] == b"\x30" and 0x81 <= head[1] <= 0x83:
                size = head[1] & 0x7F
                chars = -(-8 * (2 + size + int.from_bytes(head[2 : 2 + size], "big")) // 6)  # without padding
            elif text.startswith("b3BlbnNzaC1rZXktdjE", start):
                chars = sum(b - a for a, b in pieces[k:])
            else:
                continue
            last = k + -(-chars // width)
            if k + 1 < last <= len(pieces):
                yield "".join(text[a:b] for a, b in pieces[k:last]), start, pieces[last - 1][1]


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then in the order of KINDS.

    assign, access and hex are patterns alone. The others are reported only if their bytes parse: ``pem`` (a private-key
    block whose body is a key), ``signed`` (a three-part signed token), ``openssh`` and ``der`` (bare base64, on one line or wrapped,
    or hex).
    """
    if not text:
        return []
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    inside: list[tuple[int, int]] = []
    if "PRIVATE KEY-----" in text:
        for m in PEM.finditer(text):
            if pem_kind(m[1]):
                found.append(("pem", m.start(), m.end()))
                inside.append((m.start(), m.end()))
    if "eyJ" in text or "ew" in text:
        found += [("signed", m.start(), m.end()) for m in SIGNED.finditer(text) if m[1].startswith(("ey", "ew")) and is_signed_token(m[1], m[2], m[3])]
    outside = lambda at: not any(a <= at < b for a, b in inside)
    for m in BASE64_RUN.finditer(text):
        if outside(m.start(1)) and (kind := key_kind(decode_base64(m[1]))):
            found.append((kind, m.start(1), m.end(1)))
    for m in HEX_RUN.finditer(text):
        if outside(m.start()) and (kind := key_kind(binascii.unhexlify(m[1]))):
            found.append((kind, m.start(1), m.end(1)))
    for run, start, end in wrapped_runs(text):
        if outside(start) and (kind := key_kind(decode_base64(run))):
            found.append((kind, start, end))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(found), key=lambda x: (x[1], order[x[0]], x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans, n_assign, n_access, n_hex, n_confirmed, spans_text, base_sha256) per document; one pass, no shuffle.

    * null and empty texts have no spans; a text of any length is scanned as a whole
    * repeated rows are scanned each; ids are carried as they are, null included
    * an empty table gives an empty result; other columns are ignored
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_spans(t) for t in batch.column(1).to_pylist()]
            base = [[s for s in x if s[0] in KINDS[:3]] for x in found]
            columns = {"id": batch.column(0)}
            columns["spans"] = pa.array(
                [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in found],
                pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])),
            )
            for kind in KINDS[:3]:
                columns[f"n_{kind}"] = pa.array([sum(s[0] == kind for s in x) for x in base], pa.int64())
            columns["n_confirmed"] = pa.array([len(x) - len(b) for x, b in zip(found, base, strict=True)], pa.int64())
            columns["spans_text"] = pa.array([joined(x) for x in found], pa.string())
            columns["base_sha256"] = pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        scan, f"id {kind}, {SCHEMA}, n_assign long, n_access long, n_hex long, n_confirmed long, spans_text string, base_sha256 string"
    ).withColumnRenamed("id", id_col)
