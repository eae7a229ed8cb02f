"""Web archives inside ZIP packages: written by tasks, read back by ranges.

A package holds one stored (not deflated) archive member of gzipped WARC records
and one stored index member with the place of every record. The reader never
unpacks it: it reads the end of the file, follows the ZIP64 locator where there is
one, parses the central directory, finds the data of the members behind their
local headers, reads the index, and then fetches single records by byte range.

Packages lie in the shared folder, under names of their own per attempt; only the
packages named in the written manifest count, so a task that ran twice does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.registry import query
from tillscope.operators.lookup import fits_broadcast
from tillscope.session import work_folder, written

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_BYTES, PACKAGE_RECORDS = 1 << 30, 200_000  # a task starts another package beyond either
READ_BYTES = 4 << 20
TASK_BYTES = 32 << 20  # of packages, read by one task
REVISIT_FROM = 1000  # payloads of fewer bytes are never revisits
_DATE = "2024-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a URI; a plain path is a local one."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    if "://" in uri:
        return pyarrow.fs.FileSystem.from_uri(uri)
    return pyarrow.fs.LocalFileSystem(), uri


# Writing


def record(identity: str, url: str | None, payload: bytes, digest: bytes, refers_to: str | None) -> bytes:
    """One WARC record; with ``refers_to`` a revisit, which carries the headers of its payload but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{identity}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_URL_SIGNS)}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_REVISIT}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_URL_SIGNS = "".join(chr(c) for c in range(0x21, 0x7F) if c != 0x25)  # all visible ASCII but the percent sign


class _Package:
    """An open package: records are appended to the archive member, the index follows at the end."""

    def __init__(self, folder: str) -> None:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        name = f"pages-{uuid.uuid4().hex}.wacz"
        self.path, self.offset, self.index = f"{folder}/{name}", 0, []
        self._stream = store.open_output_stream(f"{root}/{name}", compression=None)
        self._zip = zipfile.ZipFile(self._stream, "w", zipfile.ZIP_STORED)
        self._member = self._zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)

    def add(self, raw: bytes, key: str) -> None:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = packer.compress(raw) + packer.flush()
        self._member.write(packed)
        self.index.append(f"{key} {json.dumps({'offset': self.offset, 'length': len(packed), 'filename': ARCHIVE})}\n")
        self.offset += len(packed)

    def full(self) -> bool:
        return self.offset >= PACKAGE_BYTES or len(self.index) >= PACKAGE_RECORDS

    def close(self) -> tuple[str, int, int]:
        self._member.close()
        with self._zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as member:
            member.write("".join(self.index).encode())
        self._zip.close()
        self._stream.close()
        return self.path, len(self.index), self.offset


def with_record_types(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """_id, _url, _payload, _digest and _refers_to of every page.

    Among pages with equal payloads of ``REVISIT_FROM`` bytes or more the one with the
    largest id is the response and the others refer to it. Repeated rows of that id
    are all responses; rows with a null id are revisits; a group with null ids alone
    has no revisits. A null html is an empty payload.
    """
    payload = F.coalesce(F.col(html_column).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_column).alias("_id"), F.col(url_column).cast("string").alias("_url"), payload.alias("_payload")).withColumn("_digest", F.sha1("_payload"))
    # Only digests, lengths and ids are shuffled, summed up before; the payloads stay where they are unless the groups are too many to broadcast.
    repeated = written(
        rows.where(F.octet_length("_payload") >= REVISIT_FROM)
        .groupBy("_digest")
        .agg(F.max("_id").alias("_response"), F.count(F.lit(1)).alias("_n"))
        .where((F.col("_n") > 1) & F.col("_response").isNotNull())
        .select("_digest", "_response"),
        "repeated-payloads",
    )
    joined = rows.join(F.broadcast(repeated) if fits_broadcast(repeated) else repeated, "_digest", "left")
    own = F.col("_id").eqNullSafe(F.col("_response"))
    # SHA-1 decides equality for payloads long enough; shorter ones never match, whatever their digest.
    revisit = F.col("_response").isNotNull() & ~own & (F.octet_length("_payload") >= REVISIT_FROM)
    return joined.select("_id", "_url", "_payload", "_digest", F.when(revisit, F.col("_response")).alias("_refers_to"))


def write_packages(pages: DataFrame, folder: str, **columns: str) -> DataFrame:
    """Write one record per page into packages below ``folder``; returns the written manifest (path, records, bytes).

    No rows, no packages. Each task writes its own pages, so nothing is shuffled.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            for identity, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                package = package or _Package(folder)
                name, target = (None if x is None else quote(str(x), safe="") for x in (identity, refers_to))
                package.add(record(name or "", url, payload, bytes.fromhex(digest), target), name or "-")
                if package.full():
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pa.RecordBatch.from_pydict({"path": pa.array([d[0] for d in done], pa.string()), "records": pa.array([d[1] for d in done], pa.int64()), "bytes": pa.array([d[2] for d in done], pa.int64())})

    return written(with_record_types(pages, **columns).mapInArrow(work, "path string, records long, bytes long"), "package-manifest")


# Reading


class Member(NamedTuple):
    """A member of a package: its name, whether it is stored, and where its bytes lie."""

    name: str
    stored: bool
    offset: int
    size: int


def central_directory(source: pa.NativeFile) -> list[Member]:
    """All members of a ZIP file, 32- or 64-bit, from its end record and central directory."""
    size = source.size()
    tail_start = max(0, size - (1 << 16) - 22 - 20)
    tail = source.read_at(size - tail_start, tail_start)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("not a ZIP file: no end record")
    count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
        (wide_at,) = struct.unpack("<Q", tail[at - 12 : at - 4])
        wide = source.read_at(56, wide_at)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("broken ZIP64 end record")
        count, length, start = struct.unpack("<QQQ", wide[32:56])
    directory = source.read_at(length, start)
    members, place = [], 0
    for _ in range(count):
        if directory[place : place + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method = struct.unpack("<H", directory[place + 10 : place + 12])[0]
        packed, plain, names, extras, comments = struct.unpack("<IIHHH", directory[place + 20 : place + 34])
        local = struct.unpack("<I", directory[place + 42 : place + 46])[0]
        name = directory[place + 46 : place + 46 + names].decode("utf-8", "replace")
        extra = directory[place + 46 + names : place + 46 + names + extras]
        while len(extra) >= 4:
            kind, width = struct.unpack("<HH", extra[:4])
            if kind == 1:  # ZIP64: the fields that are all ones above, in this order
                fields = iter(struct.unpack(f"<{width // 8}Q", extra[4 : 4 + width // 8 * 8]))
                plain = next(fields) if plain == 0xFFFFFFFF else plain
                packed = next(fields) if packed == 0xFFFFFFFF else packed
                local = next(fields) if local == 0xFFFFFFFF else local
            extra = extra[4 + width :]
        header = source.read_at(30, local)
        if header[:4] != b"PK\x03\x04":
            raise ValueError(f"broken local header of {name}")
        own_name, own_extra = struct.unpack("<HH", header[26:30])
        members.append(Member(name, method == 0, local + 30 + own_name + own_extra, packed))
        place += 46 + names + extras + comments
    return members


def record_places(source: pa.NativeFile) -> Iterator[tuple[int, int]]:
    """(offset in the file, length) of every record its indexes name."""
    members = {m.name: m for m in central_directory(source)}
    for member in members.values():
        if not member.name.startswith("indexes/") or not member.size:
            continue
        if not member.stored:
            raise ValueError(f"{member.name} is compressed: only stored members can be read by range")
        rest, done = b"", 0
        while done < member.size:
            piece = source.read_at(min(READ_BYTES, member.size - done), member.offset + done)
            done += len(piece)
            *lines, rest = (rest + piece).split(b"\n")
            for line in lines + [rest] * (done >= member.size and bool(rest)):
                entry = json.loads(line[line.index(b"{") :])
                archive = members.get(entry["filename"])
                if archive is None or not archive.stored:
                    raise ValueError(f"{entry['filename']} is missing or compressed")
                if int(entry["offset"]) + int(entry["length"]) > archive.size:
                    raise ValueError(f"the index points beyond {archive.name}")
                yield archive.offset + int(entry["offset"]), int(entry["length"])


def parse_record(raw: bytes) -> dict:
    """Fields of one WARC record. The digest of a payload is checked against its header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in http.decode("latin-1").split("\r\n")[1:])}
    length = int(headers["content-length"])
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).digest() != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its headers")
    name = lambda field: unquote(fields[field].removeprefix("<urn:page:").removesuffix(">")) if field in fields else None
    return {
        "page": name("warc-record-id") or None,
        "url": unquote(fields["warc-target-uri"]) if "warc-target-uri" in fields else None,
        "payload_bytes": length,
        "payload_digest": digest.hex(),
        "record_type": kind,
        "refers_to": name("warc-refers-to"),
        "payload": payload if kind == "response" else None,
    }


def read_packages(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the packages named in column ``path``.

    Returns page and refers_to (text), url, payload_bytes, payload_digest, record_type
    and, with ``payloads``, the payload (null for revisits). A broken package or
    record fails the query rather than losing rows.
    """

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, root = open_store(path)
                with store.open_input_file(root) as source:
                    places = list(record_places(source))  # a package holds PACKAGE_RECORDS at most when written here
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(places), pa.string()), "begin": pa.array([p[0] for p in places], pa.int64()), "length": pa.array([p[1] for p in places], pa.int64())})

    kinds = {"page": pa.string(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.string()}
    if payloads:
        kinds["payload"] = pa.binary()

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_path, source = None, None
        for batch in batches:
            places = list(zip(*(c.to_pylist() for c in batch.columns)))
            found, at = [], 0
            while at < len(places):
                path, begin, length = places[at]
                if path != open_path:
                    store, root = open_store(path)
                    open_path, source = path, store.open_input_file(root)
                stop, end = at + 1, begin + length  # records that follow each other are one read
                while stop < len(places) and places[stop][0] == path and places[stop][1] == end and end - begin < READ_BYTES:
                    end, stop = end + places[stop][2], stop + 1
                held = source.read_at(end - begin, begin)
                for _, start, size in places[at:stop]:
                    found.append(parse_record(zlib.decompress(held[start - begin : start - begin + size], 31)))
                at = stop
                if len(found) >= 512:
                    yield pa.RecordBatch.from_pydict({k: pa.array([f[k] for f in found], t) for k, t in kinds.items()})
                    found = []
            yield pa.RecordBatch.from_pydict({k: pa.array([f[k] for f in found], t) for k, t in kinds.items()})

    places = packages.select("path").repartition("path").mapInArrow(locate, "path string, begin long, length long")
    places = written(places, "package-members")
    total = places.agg(F.sum("length")).first()[0] or 0
    # The number is given: by their own bytes the places would all be merged into one task.
    tasks = max(1, -(-total // TASK_BYTES))
    spread = places.repartition(tasks, "path", F.floor(F.col("begin") / F.lit(READ_BYTES))).sortWithinPartitions("path", "begin")
    schema = "page string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    return spread.mapInArrow(fetch, schema + ", payload binary" * payloads)


@query(
    "op6_zip_warc",
    """with p as (select page_id, coalesce(html, '') as h from pages),
    q as (select page_id, strlen(h) as n, sha1(h) as d, max(page_id) over (partition by sha1(h)) as last from p)
    select page_id, n as payload_bytes, d as payload_digest, case when n >= 1000 and page_id <> last then 'revisit' else 'response' end as record_type,
    case when n >= 1000 and page_id <> last then last end as refers_to from q""",
)
def op6_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as records into ZIP packages, then read back from them."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    kind = pages.schema["page_id"].dataType
    found = read_packages(write_packages(pages, work_folder(spark, "packages")), payloads=False)
    return found.select(
        F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )
