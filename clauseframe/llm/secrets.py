"""Secret scan with structural confirmation.

Three pattern kinds (``assign``, ``access``, ``hex``) are reported as they match. Encoded candidates are reported only
after they have been decoded and their structure holds: ``jwt`` (three parts in a row of a dotted run, of which the first
two are JSON objects and the first names an algorithm), ``pem`` (an armoured private key, also with its line ends spelt
``\\n``, or encrypted), ``b64_key`` and ``hex_key`` (a bare base64 or hex string, plain, url-safe or in lines, that is a
whole DER private key, an OpenSSH one or an armoured one, with every nested length adding up).

Every candidate search is linear in the text, however long its runs are.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, schema_with

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "pem", "b64_key", "hex_key")
ORDER = {k: i for i, k in enumerate(KINDS)}
SPAN = "array<struct<kind:string,start:int,end:int>>"

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Begins where a run begins and gives nothing back, so that a long run without full stops is read once.
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++){2,}")
BEGIN = re.compile(r"-----BEGIN ((?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY)-----")
B64 = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
URL_B64 = re.compile(r"[A-Za-z0-9_-]{40,}={0,2}")
LINES_B64 = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{40,80}\r?\n[\x20\t]*)+[A-Za-z0-9+/]{1,80}={0,2}")
ANY_HEX = re.compile(r"[0-9A-Fa-f]{64,}")
URL_SAFE = str.maketrans("-_", "+/")
WORDS = ("passw", "secret", "token", "apikey", "api_key")

INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of each element in ``data``; None unless the lengths fill it exactly."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            size = n & 0x7F
            if not 1 <= size <= 4 or at + size > len(data):
                return None
            n, at = int.from_bytes(data[at : at + size], "big"), at + size
        if at + n > len(data):
            return None
        out.append((tag, data[at : at + n]))
        at += n
    return out


def is_sequence_of(data: bytes) -> list[tuple[int, bytes]]:
    """The items of the one SEQUENCE that fills ``data``, or none."""
    top = der_items(data) if data[:1] == b"\x30" else None
    return (der_items(top[0][1]) or []) if top and len(top) == 1 else []


def is_algorithm(data: bytes) -> bool:
    items = der_items(data)
    return bool(items) and items[0][0] == OID and len(items[0][1]) > 0


def is_der_key(data: bytes) -> bool:
    """A private key that fills ``data``: PKCS#1, PKCS#8 with a key inside its octets, SEC 1 or DSA."""
    inner = is_sequence_of(data)
    tags = [t for t, _ in inner]
    if len(tags) < 2 or tags[0] != INTEGER or inner[0][1] not in (b"\0", b"\1"):
        return False
    if tags[1] == SEQUENCE:
        octets = inner[2][1] if len(tags) > 2 and tags[2] == OCTETS else b""
        return is_algorithm(inner[1][1]) and bool(der_items(octets))
    if tags[1] == OCTETS:
        return len(inner[1][1]) >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])
    # PKCS#1 has eight numbers behind its version, and more behind version 1; DSA has five
    return set(tags[: 9 if len(tags) > 6 else 6]) == {INTEGER} and (len(tags) in (6, 9) or len(tags) == 10 and inner[0][1] == b"\1")


def is_encrypted_key(data: bytes) -> bool:
    """PKCS#8, encrypted: an algorithm, and octets."""
    inner = is_sequence_of(data)
    return [t for t, _ in inner] == [SEQUENCE, OCTETS] and is_algorithm(inner[0][1]) and len(inner[1][1]) >= 16


def is_openssh_key(data: bytes) -> bool:
    """The OpenSSH container: its magic, three strings, a key count, and that many public and one private string."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, left, seen = len(magic), 3, 0
    while left:
        if at + 4 > len(data):
            return False
        n = int.from_bytes(data[at : at + 4], "big")
        at, left, seen = at + 4 + n, left - 1, seen + 1
        if at > len(data):
            return False
        if seen == 3:
            keys = int.from_bytes(data[at : at + 4], "big")
            at, left = at + 4, keys + 1
            if not 1 <= keys <= 64:
                return False
    return at == len(data)


def unbase64(text: str) -> bytes | None:
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_key(data: bytes | None) -> bool:
    if not data:
        return False
    if data.lstrip()[:11] == b"-----BEGIN ":
        text = data.decode("latin-1").strip()
        return [(0, len(text))] == armoured(text)
    return is_der_key(data) or is_openssh_key(data)


def armoured(text: str) -> list[tuple[int, int]]:
    """(start, end) of each armoured private key. A body ends at the next dashes, so each is read once."""
    out, at = [], 0
    while m := BEGIN.search(text, at):
        stop = text.find("-----", m.end())
        end = f"-----END {m[1]}-----"
        if stop >= 0 and text.startswith(end, stop):
            at = stop + len(end)
            if is_body(text[m.end() : stop], m[1]):
                out.append((m.start(), at))
        else:
            at = m.end()
    return out


def is_body(body: str, label: str) -> bool:
    lines = [x.strip() for x in body.replace("\\r", "\n").replace("\\n", "\n").split("\n")]
    headers, data = [x for x in lines if ":" in x], unbase64("".join("".join(x.split()) for x in lines if ":" not in x).rstrip("="))
    if not data:
        return False
    if any(h.startswith("Proc-Type:") and "ENCRYPTED" in h for h in headers):  # whole cipher blocks; the lengths inside are not to be seen
        return len(data) % 8 == 0 and any(re.fullmatch(r"DEK-Info: ?[A-Z0-9-]+,[0-9A-Fa-f]{16,}", h) for h in headers)
    return is_encrypted_key(data) if label.startswith("ENCRYPTED") else is_key(data)


def as_object(part: str) -> dict | None:
    """The JSON object that a token's part holds."""
    if len(part) < 8 or part[0] not in "eIDC":  # what an opening brace, or white space before one, begins with
        return None
    try:
        data = base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)).strip()
        value = json.loads(data) if data[:1] == b"{" and data[-1:] == b"}" else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def signed_tokens(text: str) -> list[tuple[int, int]]:
    """(start, end) of header, payload and signature wherever they stand in a dotted run; each part is decoded once."""
    out = []
    for m in DOTTED.finditer(text):
        parts, at, held = m[0].split("."), m.start(), None
        starts = []
        for p in parts:
            starts.append(at)
            at += len(p) + 1
        i, held = 0, as_object(parts[0])
        while i + 2 < len(parts):
            following = as_object(parts[i + 1])
            if held is not None and following is not None and isinstance(held.get("alg"), str) and len(parts[i + 2]) >= 8:
                out.append((starts[i], starts[i + 2] + len(parts[i + 2])))
                i += 3
                held = as_object(parts[i]) if i < len(parts) else None
            else:
                i, held = i + 1, following
    return out


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans of one text, by start, then kind; code points, end exclusive. The cheap tests in front lose nothing."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    longest = max(map(len, text.split()), default=0)
    if longest >= 20 and "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if longest >= 24:
        out += [("hex", *m.span()) for m in HEX.finditer(text)]
        if "." in text:
            out += [("jwt", *s) for s in signed_tokens(text)]
    if longest >= 40:
        keys = {m.span() for kind in (B64, URL_B64) for m in kind.finditer(text) if is_key(unbase64(m[0].rstrip("=").translate(URL_SAFE)))}
        if "\n" in text:
            keys |= {m.span() for m in LINES_B64.finditer(text) if is_key(unbase64("".join(m[0].split()).rstrip("=")))}
        out += [("b64_key", *s) for s in keys]
        out += [("hex_key", *m.span()) for m in ANY_HEX.finditer(text) if len(m[0]) % 2 == 0 and is_key(bytes.fromhex(m[0]))]
    if "-----BEGIN " in text:
        out += [("pem", *s) for s in armoured(text)]
    return sorted(out, key=lambda x: (x[1], ORDER[x[0]], x[2]))


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """``text`` with each span, or run of overlapping spans, replaced by ``mark``."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``docs`` with the column ``spans``: every secret of the whole text, in order.

    Narrow: one pass, no shuffle. A null text counts as empty and has no spans. Repeated rows each get their spans. All
    columns stay; one that is already called ``spans`` is replaced. An empty table gives an empty table.
    """
    kept = docs.drop(spans)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in find(x or "")] for x in batch.column(text).to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, spans])

        return step

    return arrow_map(kept, schema_with(kept, **{spans: SPAN}), make)


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with its secrets replaced by ``mark``; nulls stay null. The columns stay as they are."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = batch.schema.get_field_index(text)
            clean = [x and redacted(x, find(x), mark) for x in batch.column(at).to_pylist()]
            return batch.set_column(at, text, pa.array(clean, batch.schema.field(at).type))

        return step

    return arrow_map(docs, docs.schema, make)


def secret_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, from ``scan_secrets``."""
    line = lambda kept: F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    found = scan_secrets(docs.select("doc_id", "text")).drop("text")
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(F.encode(line(base), "UTF-8"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))

