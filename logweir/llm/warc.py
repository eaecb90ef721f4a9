r"""WARC derivatives: every response record becomes a linked metadata record and a plain-text conversion.

Both new records name the response in ``WARC-Refers-To`` and repeat its target URI, its date and its payload
digest; the metadata record keeps the source's HTTP status and header lines as ``application/warc-fields``.
Record ids are UUIDs of version 5 over the response's id and the record type, so a repeated or retried task
makes the same records. Digests are ``sha1:`` with base 32, as crawlers write them.

Work is one narrow pass over the responses (``mapInPandas``): no shuffle, one page in memory at a time beside
its Arrow batch. ``to_bytes`` and ``read_records`` write and read the records as WARC/1.1, one gzip member each.

Defined results: a response without payload (NULL or empty) has an empty conversion and both records; NULL
headers are none; a NULL target URI is left out of the records' headers; repeated rows give repeated records
with equal ids; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.html import blocks, parse

NAMESPACE = uuid.UUID("6f0a6a0e-8d0b-5a53-9b53-1a5b6f6f2a11")
DATE = "1970-01-01T00:00:00Z"
COLUMNS = ("record_id", "target_uri", "warc_date", "http_headers", "payload")
SCHEMA = ("key bigint, record_type string, record_id string, refers_to string, target_uri string, warc_date string, "
          "content_type string, n_bytes bigint, block_digest string, source_digest string, headers string, block string")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_uri(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(parts))}>"


def plain_text(html: str) -> str:
    """All visible text, one line per block."""
    return "".join(f"{block.text}\n" for block in blocks(parse(html)))


def header_block(fields: Iterable[tuple[str, str | None]]) -> str:
    """Header lines; line breaks inside a value become spaces, fields without a value are left out."""
    lines = (f"{name}: {' '.join(value.splitlines())}\r\n" for name, value in fields if value is not None)
    return "WARC/1.1\r\n" + "".join(lines)


def derive_record(record_id: str, uri: str | None, date: str, http: str, payload: str) -> list[dict]:
    """The metadata and the conversion record of one response."""
    source = digest(payload.encode())
    status, _, fields = http.partition("\r\n")
    code = status.split(" ")[1] if status.startswith("HTTP/") and " " in status else None
    noted = [("http-status", code), ("source-digest", source), ("source-length", str(len(payload.encode())))]
    metadata = "".join(f"{name}: {value}\r\n" for name, value in noted if value is not None)
    metadata += "".join(f"source-header: {line}\r\n" for line in fields.split("\r\n") if line)
    made = []
    for kind, content_type, block in (("metadata", "application/warc-fields", metadata),
                                      ("conversion", "text/plain; charset=utf-8", plain_text(payload))):
        data = block.encode()
        new_id, own = record_uri(record_id, kind), digest(data)
        made.append({
            "record_type": kind, "record_id": new_id, "refers_to": record_id, "target_uri": uri, "warc_date": date,
            "content_type": content_type, "n_bytes": len(data), "block_digest": own, "source_digest": source,
            "headers": header_block([
                ("WARC-Type", kind), ("WARC-Record-ID", new_id), ("WARC-Date", date), ("WARC-Target-URI", uri),
                ("WARC-Refers-To", record_id), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date),
                ("WARC-Block-Digest", own), ("WARC-Source-Payload-Digest", source),
                ("Content-Type", content_type), ("Content-Length", str(len(data)))]),
            "block": block,
        })
    return made


def _derive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [field.split()[0] for field in SCHEMA.split(", ")]
    for batch in batches:
        made = [{"key": key} | record
                for key, record_id, uri, date, http, payload in batch.itertuples(index=False, name=None)
                for record in derive_record(record_id, uri, date or DATE, http or "", payload or "")]
        yield pd.DataFrame(made, columns=columns)


def derive(responses: DataFrame, key: str) -> DataFrame:
    """Two records per response; ``key`` is the column that ties them to the caller's rows."""
    return responses.select(F.col(key).cast("bigint").alias("key"), *COLUMNS).mapInPandas(_derive, SCHEMA)


def responses_of_pages(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Pages as response records: ids follow from the page's id and url, headers from the html."""
    size = F.octet_length(F.coalesce("html", F.lit("")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    size.cast("string"), F.lit("\r\n"))
    seed = F.sha1(F.concat_ws("\0", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))))
    part = [F.substring(seed, at, size) for at, size in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    name = F.concat(part[0], F.lit("-"), part[1], F.lit("-5"), part[2], F.lit("-8"), part[3], F.lit("-"), part[4])
    return pages.select(
        "page_id", F.concat(F.lit("<urn:uuid:"), name, F.lit(">")).alias("record_id"), F.col("url").alias("target_uri"),
        F.lit(date).alias("warc_date"), http.alias("http_headers"), F.col("html").alias("payload"))


def to_bytes(headers: str, block: str) -> bytes:
    """A record as one gzip member; the time stamp is left out, so equal records are equal bytes."""
    return gzip.compress(headers.encode() + b"\r\n" + block.encode() + b"\r\n\r\n", mtime=0)


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a WARC file, gzipped per record or plain."""
    stream = io.BytesIO(data)
    if data[:2] == b"\x1f\x8b":
        stream = io.BytesIO(_members(data))
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.strip()] = value.strip()
        size = int(fields["Content-Length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("the last record is cut off")
        yield fields, block


def _members(data: bytes) -> bytes:
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out)
