"""WARC archives in ZIP packages: written by tasks, read back by byte ranges.

A package holds ``archive/data.warc.gz`` (one gzip member a record) and
``indexes/index.cdxj``, both stored, so that a record is a byte range of the package. The reader
finds the central directory from the end of the file (ZIP64 too), locates the
stored members, reads the index, and then only the ranges of records; nothing is unpacked to disk.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, new_path

#: Payloads from this size on are written once.
REVISIT_BYTES = 1000
#: Bytes of records after which a task begins another package, and bytes of a package that one task reads at least.
PACKAGE_BYTES, CHUNK_BYTES = 256 << 20, 8 << 20
DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
DATE, STAMP = "2024-01-01T00:00:00Z", "20240101000000"
_NAMESPACE = 0x6D0F2A4C8B3E4F17


def sort_key(url: str) -> str:
    """The index key of a URL: its host's labels in reverse, then the rest, without blanks."""
    rest = url.partition("://")[2] or url
    host, slash, tail = rest.partition("/")
    name, colon, port = host.lower().partition(":")
    key = f"{','.join(reversed(name.split('.')))}{colon}{port}){slash}{tail}"
    return re.sub(r"\s", "%20", key)


def record_id(page_id: int | None) -> str:
    """A URN that holds a 64-bit page id; of its own for null."""
    high, low = (_NAMESPACE, page_id & (1 << 64) - 1) if page_id is not None else (_NAMESPACE + 1, 0)
    return f"<urn:uuid:{uuid.UUID(int=high << 64 | low)}>"


def page_of(urn: str) -> int | None:
    x = uuid.UUID(urn.strip().removeprefix("<urn:uuid:").removesuffix(">")).int
    low = x & (1 << 64) - 1
    return None if x >> 64 != _NAMESPACE else low - (1 << 64) if low >> 63 else low


def warc_record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: a response with ``payload``, or a revisit of page ``refers_to``."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to)}",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers (lower-case names), HTTP head and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def open_file(path: str, mode: str):
    """A stream on ``path`` in any store that Arrow knows; ``w`` or ``r``."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    if mode == "w":
        store.create_dir(at.rpartition("/")[0], recursive=True)
        return store.open_output_stream(at)
    return store.open_input_file(at)


def members(f) -> dict[str, tuple[int, int]]:
    """``name: (offset, size)`` of the stored members of a ZIP file."""
    return {name: (at, n) for name, (at, n, method) in directory(f).items() if method == 0}


def directory(f) -> dict[str, tuple[int, int, int]]:
    """``name: (offset, packed size, method)`` of the members of a ZIP file, from its central directory (ZIP64 too)."""
    size = f.size()

    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    tail = read(max(0, size - 65557), min(size, 65557))
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF in (count,) or 0xFFFFFFFF in (length, at):
        where = max(0, size - 65557) + end - 20
        mark, _, at64 = struct.unpack("<4sIQ", read(where, 16))
        if mark != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        count, length, at = struct.unpack_from("<QQQ", read(at64, 56), 32)
    held, out, i = read(at, length), {}, 0
    while i < len(held):
        if held[i : i + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, plain, n_name, n_extra, n_note, local = struct.unpack_from("<H8xIIHHH8xI", held, i + 10)
        name = held[i + 46 : i + 46 + n_name].decode()
        extra, j = held[i + 46 + n_name : i + 46 + n_name + n_extra], 0
        while j + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, j)
            if kind == 1:
                large, k = extra[j + 4 : j + 4 + n], 0
                for field in ("plain", "packed", "local"):
                    if {"plain": plain, "packed": packed, "local": local}[field] == 0xFFFFFFFF:
                        (value,) = struct.unpack_from("<Q", large, k)
                        k += 8
                        plain, packed, local = (value if field == "plain" else plain), (
                            value if field == "packed" else packed
                        ), (value if field == "local" else local)
            j += 4 + n
        own_name, own_extra = struct.unpack("<HH", read(local + 26, 4))
        out[name] = (local + 30 + own_name + own_extra, packed, method)
        i += 46 + n_name + n_extra + n_note
    if len(out) > count:
        raise ValueError("broken central directory")
    return out


def stored(held: dict, name: str, path: str) -> tuple[int, int]:
    """Place and length of a member that must be there as it is."""
    if name not in held:
        raise ValueError(f"{path} has no member {name}")
    at, n, method = held[name]
    if method:
        raise ValueError(f"{path}: member {name} is compressed (method {method}); byte ranges need a stored one")
    return at, n


def _write(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        state: dict = {}

        def close() -> pa.RecordBatch:
            state["member"].close()
            with state["zip"].open(INDEX, "w", force_zip64=True) as f:
                index = "".join(sorted(state["index"])).encode()
                f.write(index)
            listed = [
                (DATA, state["at"], state["sum"].hexdigest()), (INDEX, len(index), hashlib.sha256(index).hexdigest())
            ]
            state["zip"].writestr(PACKAGE, json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"name": n.split("/")[-1], "path": n, "bytes": b, "hash": f"sha256:{h}"} for n, b, h in listed]}))
            state["zip"].close()
            state["file"].close()
            out = pa.record_batch(
                [pa.array([state["path"]]), pa.array([len(state["index"])], pa.int64())], names=["path", "records"]
            )
            state.clear()
            return out

        n = 0
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if not state:
                    # another attempt of the task writes other files; only those of the one that succeeds are listed
                    state["path"] = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{n:04d}.wacz"
                    n += 1
                    state["file"] = open_file(state["path"], "w")
                    state["zip"] = zipfile.ZipFile(state["file"], "w", zipfile.ZIP_STORED, allowZip64=True)
                    state["member"], state["at"], state["index"], state["sum"] = state["zip"].open(
                        DATA, "w", force_zip64=True
                    ), 0, [], hashlib.sha256()
                gz = zlib.compressobj(1, zlib.DEFLATED, 31)
                raw = gz.compress(
                    warc_record(page_id, url or "", (html or "").encode(), digest, refers_to)
                ) + gz.flush()
                state["member"].write(raw)
                state["sum"].update(raw)
                place = {
                    "url": url,
                    "mime": "text/html",
                    "status": "200",
                    "digest": f"sha1:{digest}",
                    "length": str(len(raw)),
                    "offset": str(state["at"]),
                    "filename": DATA.split("/")[-1],
                }
                state["index"].append(f"{sort_key(url or '')} {STAMP} {json.dumps(place)}\n")
                state["at"] += len(raw)
                if state["at"] >= PACKAGE_BYTES:
                    yield close()
        if state:
            yield close()

    return run


def write_packages(
    pages: DataFrame,
    root: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    revisit_bytes: int = REVISIT_BYTES,
) -> DataFrame:
    """Write a record per row to packages below ``root`` (a folder that all executors share); ``(path, records)`` of each.

    The payload is the html in UTF-8 (null: empty). Of equal payloads of ``revisit_bytes`` or more
    the one with the largest page id is a response and the others revisit it; of rows that share that largest id the last one
    in the order of the table is the response. A null id is a page of its own; it is a response unless an equal payload has an id.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        payload.alias("html"),
        F.sha1(payload.cast("binary")).alias("digest"),
        F.monotonically_increasing_id().alias("at"),  # tells rows of one id apart; the table is read in the same parts each time
    )
    large = F.octet_length("html") >= revisit_bytes
    first = rows.where(large).groupBy("digest").agg(
        F.max(F.struct("page_id", F.when(F.col("page_id").isNotNull(), F.col("at")).alias("last"))).alias("m"), F.count(F.lit(1)).alias("n")
    ).where("n > 1").select("digest", F.col("m.page_id").alias("first"), "m.last")
    # small payloads, all the empty ones among them, take no part in the join
    told = rows.where(large).join(materialize(first, "copies"), "digest", "left")
    none = F.lit(None).cast("long")
    told = told.unionByName(rows.where(~large).withColumns({"first": none, "last": none}))
    refers = F.when(F.col("first").isNotNull() & ~(F.col("page_id").eqNullSafe(F.col("first")) & (F.col("at") == F.col("last"))), F.col("first"))
    return materialize(
        told.select(
            "page_id", "url", "html", "digest", refers.alias("refers_to")
        ).mapInArrow(_write(root), "path string, records long"),
        "packages",
    )


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with open_file(path, "r") as f:
                held = directory(f)
                (data, _), (at, n) = stored(held, DATA, path), stored(held, INDEX, path)
                f.seek(at)
                spans = [json.loads(line.split(b" ", 2)[2]) for line in f.read(n).splitlines()]
            yield pa.record_batch(
                [
                    pa.array([path] * len(spans), pa.string()),
                    pa.array([data + int(s["offset"]) for s in spans], pa.int64()),
                    pa.array([int(s["length"]) for s in spans], pa.int64())
                ],
                names=["path", "offset", "length"],
            )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, f = None, None
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    for batch in batches:
        rows = []
        for path, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
            if path != now:
                if f is not None:
                    f.close()
                now, f = path, open_file(path, "r")
            f.seek(offset)
            headers, http, payload = parse_record(zlib.decompress(f.read(length), 31))
            kind = headers["warc-type"]
            digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
            size = int(
                next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).partition(b":")[2]
            )
            if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                raise ValueError(f"a record of {path} at {offset} does not match its digest")
            refers = page_of(headers["warc-refers-to"]) if kind == "revisit" else None
            rows.append(
                (
                    page_of(headers["warc-record-id"]),
                    headers["warc-target-uri"],
                    size,
                    digest,
                    kind,
                    refers,
                    payload.decode() if kind == "response" else None,
                )
            )
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, types)], names=names)
    if f is not None:
        f.close()


def locate_records(packages: DataFrame) -> DataFrame:
    """``(path, offset, length)`` of each record of the packages in ``path``, from their directories and indexes."""
    return packages.select("path").mapInArrow(_locate, "path string, offset long, length long")


def read_packages(packages: DataFrame) -> DataFrame:
    """The records of the packages in ``path``: page id, url, size and digest of the full payload, type, the page it refers to, and a response's payload."""
    spans = materialize(locate_records(packages), "spans")
    # offsets are few bytes, records many: partitions are counted by what the records weigh
    parts = max(1, -(-(spans.agg(F.sum("length")).first()[0] or 0) // CHUNK_BYTES))
    dealt = spans.withColumn(
        "_chunk", F.floor(F.col("offset") / CHUNK_BYTES)
    ).repartition(parts, "path", "_chunk").sortWithinPartitions("path", "offset").drop("_chunk")
    return dealt.mapInArrow(
        _read,
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string",
    )


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """The digest of each page's record, read back from packages in the shared folder.

    An empty table writes no package and gives no rows; null urls and html are empty, texts of any length are one record, repeated rows are records each, other columns are not read.
    """
    return read_packages(write_packages(pages, new_path(pages.sparkSession, "warc"))).drop("payload", "url")
