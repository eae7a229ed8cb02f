"""Secret scans confirmed by structure.

Three plain patterns give the base findings. Beyond them, runs that could be
base64 or hex are decoded and reported only if what comes out has the structure
of a key or token: nested ASN.1 lengths that fit to the last byte, the length
fields of an OpenSSH key, or a signed token whose header is JSON with an "alg".
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.llm import arrays
from tillscope.llm.registry import query

KINDS = ("assign", "access", "hex", "token", "der", "ssh")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(e[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
# The body may have header lines, and line breaks escaped once or more, as in JSON or .env files.
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----((?:[\x20-\x2c\x2e-\x7e\s]|-(?!----))+)-----END \1-----")
_BREAK = re.compile(r"\\+[nrt]")
_HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*:")
_CIPHER = re.compile(r"[A-Za-z0-9-]+,([0-9A-Fa-f]{16,32})")
# A DER sequence starts with the byte 0x30, so its base64 starts with M and its hex with 30; OpenSSH blobs start with a length.
_B64 = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\[nrt]))(?:M[A-Za-z0-9]|AAAA|b3Bl)[A-Za-z0-9+/_-]{30,}={0,2}")
# The same over lines, and a whole key file in base64, as clusters and build systems keep them.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M[A-Za-z0-9]|AAAA|b3Bl|LS0t)[A-Za-z0-9+/]{30,}={0,2}(?:\r?\n[\x20\t]*[A-Za-z0-9+/]+={0,2})*")
_FILE_START = b"-----BEGIN "
_HEX_DER = re.compile(r"(?<![0-9A-Fa-f])30(?:[0-9A-Fa-f]{2}){23,}(?![0-9A-Fa-f])")
_OPENSSH_MAGIC = b"openssh-key-v1\x00"


def _unpadded(text: str) -> bytes | None:
    """Base64 of either alphabet, padding optional; None if it is none."""
    body = text.rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _elements(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the ASN.1 elements that fill data[start:end] exactly; None if they don't."""
    found = []
    while start < end:
        if end - start < 2:
            return None
        tag, length, body = data[start], data[start + 1], start + 2
        if length & 0x80:
            more = length & 0x7F
            if not 1 <= more <= 4 or body + more > end:
                return None
            length, body = int.from_bytes(data[body : body + more], "big"), body + more
        if body + length > end:
            return None
        found.append((tag, body, body + length))
        start = body + length
    return found


def is_key_encoding(data: bytes | None) -> bool:
    """A DER sequence whose nested lengths fit: it opens with a version number or an algorithm, and holds key material."""
    if not data or len(data) < 24 or data[0] != 0x30:
        return False
    outer = _elements(data, 0, len(data))
    if not outer or len(outer) != 1:
        return False
    parts = _elements(data, outer[0][1], outer[0][2])
    if not parts or len(parts) < 2:
        return False
    for tag, start, end in parts:
        if tag == 0x30 and _elements(data, start, end) is None:
            return False
    tag, start, end = parts[0]
    if tag == 0x02:
        rest = {p[0] for p in parts[1:]}
        return end - start >= 1 and (bool(rest & {0x04, 0x30}) or len(parts) >= 8 and rest == {0x02} or len(parts) == 2 and rest == {0x02})
    # A public key is a bit string after its algorithm; an encrypted private key is an octet string, and nothing else.
    return tag == 0x30 and data[start : start + 1] == b"\x06" and (any(t == 0x03 for t, _, _ in parts) or [t for t, _, _ in parts[1:]] == [0x04])


def block_kind(label: str, body: str) -> str | None:
    """The kind of a PEM block, None if its body is no key."""
    lines = [line.strip() for line in _BREAK.sub("\n", body).replace("\\/", "/").split("\n")]
    headers: dict[str, str] = {}
    while lines and (not lines[0] or _HEADER.match(lines[0])):
        name, _, value = lines.pop(0).partition(":")
        headers[name.lower()] = value.strip()
    raw = _unpadded("".join("".join(lines).split()))
    if is_ssh_key(raw):
        return "ssh"
    if is_key_encoding(raw):
        return "der"
    # Encrypted as a whole, so only the headers and the length, whole blocks of the cipher, can confirm it.
    sealed = label.endswith("PRIVATE KEY") and headers.get("proc-type", "").replace(" ", "") == "4,ENCRYPTED" and (cipher := _CIPHER.fullmatch(headers.get("dek-info", "")))
    return "der" if sealed and raw and len(raw) >= 24 and len(raw) % (len(cipher[1]) // 2) == 0 else None


def is_ssh_key(data: bytes | None) -> bool:
    """An OpenSSH private key file, or a public key blob whose length-prefixed fields fill it exactly."""
    if not data:
        return False
    if data.startswith(_OPENSSH_MAGIC):
        return True
    position, fields = 0, []
    while position + 4 <= len(data):
        length = int.from_bytes(data[position : position + 4], "big")
        if position + 4 + length > len(data):
            return False
        fields.append(data[position + 4 : position + 4 + length])
        position += 4 + length
    return position == len(data) and len(fields) >= 2 and re.match(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+$", fields[0]) is not None


def is_signed_token(header: str, payload: str) -> bool:
    """A token header is base64 of a JSON object with "alg"; the payload decodes too."""
    raw = _unpadded(header)
    if raw is None or _unpadded(payload) is None or not raw.lstrip().startswith(b"{"):
        return False
    try:
        fields = json.loads(raw)
    except (ValueError, RecursionError):
        return False
    return isinstance(fields, dict) and isinstance(fields.get("alg"), str)


def encoded_kind(raw: bytes | None) -> str | None:
    """The kind of key in decoded bytes: a key itself, or a key file."""
    if raw is None:
        return None
    if raw.lstrip().startswith(_FILE_START):
        block = _PEM.search(raw.decode("latin-1"))
        return block_kind(block[1], block[2]) if block else None
    return "ssh" if is_ssh_key(raw) else "der" if is_key_encoding(raw) else None


def wrapped_end(text: str) -> tuple[str, int] | None:
    """The kind and length of a key in base64 that begins the text, over as many lines as it fills: lines alike in width, and a last one."""
    lines = re.split(r"(\r?\n[\x20\t]*)", text)
    count, width = 1, len(lines[0])
    while count + 1 < len(lines) and len(lines[count - 1]) == width and len(lines[count + 1]) <= width:
        count += 2
    for stop in (count, count - 2):  # the last line may be the text's own
        kind = encoded_kind(_unpadded("".join(lines[:stop:2]))) if stop > 0 else None
        if kind:
            return kind, sum(map(len, lines[:stop]))
    return None


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base findings."""
    found = []
    low = text.lower()
    if any(word in low for word in _ASSIGN_WORDS):
        found += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return found


def confirmed_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of candidates that decode to a key or token."""
    found = []
    if "." in text and ("eyJ" in text or "ey" in text or "ew" in text):
        found += [(m.start(), "token", m.end()) for m in _TOKEN.finditer(text) if len(m[1]) >= 12 and is_signed_token(m[1], m[2])]
    blocks = []
    if "-----BEGIN" in text:
        for m in _PEM.finditer(text):
            kind = block_kind(m[1], m[2])
            if kind:
                found.append((m.start(), kind, m.end()))
                blocks.append((m.start(), m.end()))
    outside = lambda m: not any(a <= m.start() < b for a, b in blocks)
    for m in _WRAPPED.finditer(text):
        if outside(m) and (key := wrapped_end(m[0])):
            found.append((m.start(), key[0], m.start() + key[1]))
            blocks.append((m.start(), m.start() + key[1]))
    for m in _B64.finditer(text):
        if outside(m) and (kind := encoded_kind(_unpadded(m[0]))):
            found.append((m.start(), kind, m.end()))
    for m in _HEX_DER.finditer(text):
        if is_key_encoding(bytes.fromhex(m[0])):
            found.append((m.start(), "der", m.end()))
    return found


def _ordered(spans: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in _ordered(spans))


def masked(text: str, spans: list[tuple[int, str, int]], mask: str) -> str:
    """The text with each run of touching or overlapping spans replaced by ``mask``."""
    out, position = [], 0
    for start, _, end in _ordered(spans):
        if start >= position or not out:
            out += [text[position:start], mask]
        position = max(position, end)
    return "".join(out) + text[position:]


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Findings of every whole text: id, n_assign, n_access, n_hex, base_sha256, spans.

    Offsets are code points, ends exclusive. Null and empty texts have no findings
    (base_sha256 is then the digest of the empty string); null and repeated ids are
    kept row by row; an empty table gives no rows. Other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text in batch.column(1).to_pylist():
                base = base_spans(text) if text else []
                more = confirmed_spans(text) if text else []
                for kind, column in zip(KINDS[:3], out):
                    column.append(sum(s[1] == kind for s in base))
                out[3].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                out[4].append(_joined(base + more))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), *(pa.array(c, pa.string()) for c in out[3:])],
                names=["_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text"))
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return rows.mapInArrow(arrays.lean(work), schema).withColumnRenamed("_id", id_column)


def redact(docs: DataFrame, text_column: str = "text", length_column: str = "n_chars", mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every finding masked; the length column, if there, counts the new text.

    Rows without findings pass unchanged, null texts too.
    """
    columns = docs.columns
    at = columns.index(text_column)
    at_length = columns.index(length_column) if length_column in columns else None
    length_type = docs.schema[length_column].dataType.simpleString() if at_length is not None else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            changed = [False] * len(texts)
            for i, text in enumerate(texts):
                spans = base_spans(text) + confirmed_spans(text) if text else []
                if spans:
                    texts[i], changed[i] = masked(text, spans, mask), True
            columns_ = list(batch.columns)
            if any(changed):
                columns_[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns_, pa.array(changed)], schema=batch.schema.append(pa.field(flag, pa.bool_())))

    flag = "_masked"
    while flag in columns:
        flag += "_"
    out = docs.mapInArrow(arrays.lean(work), T.StructType([*docs.schema.fields, T.StructField(flag, T.BooleanType())]))
    if length_type:
        # Only a masked text changes its count: rows whose count was null or meant otherwise keep it.
        out = out.withColumn(length_column, F.when(F.col(flag), F.char_length(text_column)).otherwise(F.col(length_column)).cast(length_type))
    return out.select(*[F.col(f"`{c}`") for c in columns])


@query("op10_secret_scan")
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, base findings and structurally confirmed ones."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
