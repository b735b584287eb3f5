"""WARC archives: write, normalise monolithic gzip files, read back by offset.

``write_archives`` leaves files that are one gzip stream each. ``normalise`` inflates such a stream
once, rewrites every record as a gzip member of its own and writes a sidecar index of offsets, so
that ``read_archives`` can open any record alone. Files lie in the shared folder; the tables of their
paths are written too, so a lost executor neither loses nor doubles an archive.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.llm.scratch import materialize, new_path

#: Payload bytes after which a task begins another archive; bytes read from a file at once.
ARCHIVE_BYTES, READ_BYTES = 32 << 20, 1 << 20
#: Compression of the streams that are soon read again, and of the members that stay; tasks that archives are dealt to at most.
FAST, SMALL, MOST_TASKS = 1, 6, 1 << 14
#: Payloads below this size are never replaced by a revisit record.
LEAST_REVISIT = 100
DATE = "1970-01-01T00:00:00Z"


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


def record_id(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def format_record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit names the response it repeats and carries no payload."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def roles(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload an earlier page has; few narrow columns move.

    Digests and first pages are written, so adaptive execution can split a payload with very many pages.
    """
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    d = pages.select(F.col(id_col).cast("long").alias("page_id"), F.octet_length(payload).alias("size"), F.sha2(payload, 256).alias("digest"))
    d = materialize(d.where((F.col("size") >= LEAST_REVISIT) & F.col("page_id").isNotNull()).select("page_id", "digest"), "digests")
    first = d.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return d.join(materialize(first, "first"), "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every page as a record; ``(path, records)`` of the archives, one gzip stream each.

    Null html is an empty payload, a null url an empty target. Of equal payloads of LEAST_REVISIT
    bytes or more the smallest id is a response, the others are revisits. Pages without an id are
    left out; a repeated id gives repeated records, each judged by its own payload; an empty table
    writes nothing.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = raw = None
        done, size, count, path = [], 0, 0, ""
        for f in frames:
            for page_id, digest, url, text, refers_to in f.itertuples(index=False):
                if out is None:
                    path, size, count = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    fs, local = _open(path)
                    raw = fs.open_output_stream(local, compression=None)
                    out = zlib.compressobj(FAST, zlib.DEFLATED, 31)
                payload = (text or "").encode("utf-8", "replace")
                refers = None if pd.isna(refers_to) else int(refers_to)
                raw.write(out.compress(format_record(int(page_id), url, payload, digest, refers)))
                size, count = size + len(payload), count + 1
                if size >= ARCHIVE_BYTES:
                    raw.write(out.flush())
                    raw.close()
                    done.append((path, count))
                    out = None
        if out is not None:
            raw.write(out.flush())
            raw.close()
            done.append((path, count))
        yield pd.DataFrame(done, columns=["path", "records"])

    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha2(F.encode(html, "UTF-8"), 256).alias("digest"), F.col(url_col).cast("string").alias("url"), html.alias("html")).where("page_id is not null")
    p = p.join(roles(pages, id_col, html_col), ["page_id", "digest"], "left").select("page_id", "digest", "url", "html", "refers_to")
    _make(folder)
    return materialize(p.mapInPandas(run, "path string, records long"), "archives")


def _make(folder: str) -> None:
    fs, local = _open(folder)
    fs.create_dir(local, recursive=True)


def records_of(stream) -> Iterator[bytes]:
    """Whole records of an open monolithic gzip file, inflated once from front to back.

    A cursor moves through the inflated bytes, and what lies behind it is let go in large pieces.
    """
    inflate, text, at, ended = zlib.decompressobj(31), bytearray(), 0, False
    while True:
        head = text.find(b"\r\n\r\n", at)
        end = head + 8 + int(re.search(rb"(?im)^content-length:\s*(\d+)", text[at:head])[1]) if head >= 0 else -1
        if head >= 0 and len(text) >= end:
            yield bytes(text[at:end])
            at = end
            if at > READ_BYTES:
                del text[:at]
                at = 0
            continue
        if ended:
            if at < len(text):
                raise ValueError("the archive ends inside a record")
            return
        need = max(READ_BYTES, end - len(text))
        while need > 0 and not ended:
            piece = stream.read(READ_BYTES)
            ended = not piece
            while piece:
                more = inflate.decompress(piece)
                text += more
                need -= len(more)
                piece = inflate.unused_data
                if inflate.eof:
                    inflate = zlib.decompressobj(31)


def _dealt(files: DataFrame) -> DataFrame:
    """One archive to a task. The number is given, so small file lists are not folded into one task."""
    return files.repartition(max(1, min(MOST_TASKS, files.count())))


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite archives with one gzip member per record; ``(path, index, records)``.

    The index is a sidecar file of JSON lines: record id, type, offset and length of its member.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            done = []
            for source in f.path:
                path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                fs, local = _open(path)
                from_fs, from_local = _open(source)
                offset, lines = 0, []
                with from_fs.open_input_stream(from_local, compression=None) as stream, fs.open_output_stream(local, compression=None) as out:
                    for record in records_of(stream):
                        head = parse_head(record[: record.index(b"\r\n\r\n")])
                        member = gzip.compress(record, SMALL, mtime=0)
                        out.write(member)
                        lines.append(json.dumps({"id": head["warc-record-id"], "type": head["warc-type"], "offset": offset, "length": len(member)}))
                        offset += len(member)
                with fs.open_output_stream(f"{local}.idx", compression=None) as out:
                    out.write("".join(x + "\n" for x in lines).encode())
                done.append((path, f"{path}.idx", len(lines)))
            yield pd.DataFrame(done, columns=["path", "index", "records"])

    _make(folder)
    return materialize(_dealt(archives.select("path")).mapInPandas(run, "path string, index string, records long"), "normalised")


def read_archives(normalised: DataFrame) -> DataFrame:
    """Every record, opened alone by its offset.

    ``(page_id, url, payload_bytes, payload_digest, record_type, refers_to, html)``; html is null for
    revisits, whose size and digest come from their header.
    """
    number = re.compile(r"(-?\d+)>$")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, index in zip(f["path"], f["index"]):
                fs, local = _open(path)
                with fs.open_input_stream(_open(index)[1], compression=None) as stream:
                    entries = [json.loads(x) for x in stream.read().decode().splitlines()]
                rows, size = [], 0
                with fs.open_input_file(local) as file:
                    for e in entries:
                        file.seek(e["offset"])
                        record = gzip.decompress(file.read(e["length"]))
                        at = record.index(b"\r\n\r\n")
                        head, body = parse_head(record[:at]), record[at + 4 : -4]
                        refers = head.get("warc-refers-to")
                        own = refers is None
                        digest = hashlib.sha256(body).hexdigest() if own else head["warc-payload-digest"].partition(":")[2]
                        rows.append((int(number.search(head["warc-record-id"])[1]), head["warc-target-uri"], len(body) if own else int(head["x-payload-length"]), digest, head["warc-type"], None if own else int(number.search(refers)[1]), body.decode("utf-8") if own else None))
                        size += len(body)
                        if size > READ_BYTES * 8:
                            yield _rows(rows)
                            rows, size = [], 0
                yield _rows(rows)

    return _dealt(normalised.select("path", "index")).mapInPandas(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


def _rows(rows: list[tuple]) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"])
    return f.astype({"refers_to": "Int64"})


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the pages, normalise the archives and read every record back; see ``read_archives``."""
    spark = pages.sparkSession
    archives = write_archives(pages, new_path(spark, "warc"), id_col, url_col, html_col)
    return read_archives(normalise(archives, new_path(spark, "warc-members")))
