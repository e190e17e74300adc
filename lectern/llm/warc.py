"""Web archives: write pages as legacy ARC files, convert those to WARC, read WARC back.

All files go through Spark's text writer with the format's own record end as line
separator, and come back through its binary reader, so they can lie in any store that
Spark reaches, and a lost task is written anew. Records are bytes from reader to writer,
whatever their encoding. ARC files begin with a version block that names the fields of
the record lines that follow; records are cut by the lengths they declare, never by
searching for separators. The converter keeps what ARC holds, the HTTP status and headers
among it, and makes up the rest: record ids from address, time and digest; times in
ISO 8601; record types from the protocol; SHA-1 digests in base 32. Revisits name the
record they repeat by its id, address and time.

Old archives are often damaged. A record that the file's end cuts short keeps what is
there and is marked WARC-Truncated; where no record line stands, lines are passed over up
to the next one. Files that do not begin with a version block are refused.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import materialise, remove, scratch_path

#: Payloads from this size on are stored once.
MIN_BYTES = 1000
#: Bytes of a file before compression, roughly.
FILE_BYTES = 16 << 20
#: ARC has a capture time for each record; the page table has none.
CAPTURED = "20240101000000"
#: Fixed values of the ARC format: the fields of a record's line, by version.
FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
EXTRA = "X-Row-Id"


def arc_version_block(version: str, name: str) -> bytes:
    """First record of a file, whose length it declares itself."""
    body = f"{version} 0 lectern\n{FIELDS[version]}\n"
    rest = "200 - - 0 " + name + " " if version == "2" else ""
    return f"filedesc://{name} 0.0.0.0 {CAPTURED} text/plain {rest}{len(body)}\n{body}".encode()


def arc_record(version: str, name: str, row: str, url: str | None, payload: bytes | None) -> bytes:
    """An HTTP response as an ARC record: line, headers, payload."""
    payload = payload or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{EXTRA}: {row}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    address = quote(url or "", safe="!#$&'()*+,/:;=?@[]~%-._") or "about:blank"
    sum_ = f"200 {hashlib.md5(payload).hexdigest()} - 0 {name} " if version == "2" else ""
    return f"{address} 0.0.0.0 {CAPTURED} text/html {sum_}{len(http) + len(payload)}\n".encode() + http + payload


def text_of(data: bytes) -> str:
    """UTF-8, or else Latin-1."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _fields(line: str, names: list[str]) -> dict[str, str] | None:
    """The fields of a record's line, whose address may hold spaces; None for another line."""
    values = line.rstrip("\r").split(" ")
    more = len(values) - len(names)
    if more < 0:
        return None
    out = dict(zip(names, [" ".join(values[: more + 1]), *values[more + 1 :]], strict=True))
    return out if re.fullmatch("[0-9]{1,15}", out["archive-length"]) and re.fullmatch("[0-9]{8,14}", out["archive-date"]) else None


def read_arc(data: bytes) -> Iterator[dict[str, str | bytes | bool]]:
    """Records after the version block: the named fields of each line, ``body``, and whether it is ``cut`` short."""
    if not data:
        return
    end = data.find(b"\n")
    first = text_of(data[: end if end >= 0 else len(data)]).rstrip("\r").split(" ")
    if not first[0].startswith("filedesc://") or not first[-1].isdigit():
        raise ValueError("an ARC file begins with a filedesc record")
    at = end + 1 + int(first[-1])
    block = text_of(data[end + 1 : at]).splitlines()
    if len(block) < 2 or block[0].split(" ")[0] not in FIELDS:
        raise ValueError(f"unknown ARC version {block[:1]!r}")
    names = [x.lower() for x in block[1].split(" ")]
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        record: dict | None = _fields(text_of(data[at:end]), names)
        at = end + 1
        if record is not None:
            size = int(record["archive-length"])
            body = data[at : at + size]
            yield record | {"body": body, "cut": len(body) < size}
            at += size


def http_parts(body: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """(head with the empty line that ends it, headers by lower-case name, payload); without an empty line, all is head."""
    found = re.search(rb"\r?\n\r?\n", body)
    at = found.end() if found else len(body)
    head = body[:at]
    return head, {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").splitlines()[1:])}, body[at:]


def sha1_base32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def iso_time(digits: str) -> str:
    """14, 12 or 8 digits of an ARC time in ISO 8601; what is missing is the earliest."""
    d = (re.sub(r"\D", "", digits) + "00000101000000"[len(digits) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(row: str, url: str, time: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join((row, url, time, digest)))}>"


def warc_record(headers: Iterable[tuple[str, str]], block: bytes) -> bytes:
    """Without the two line ends that close it; those are the writer's separator."""
    return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n").encode() + block


def warc_info(name: str) -> bytes:
    """The record that a file begins with."""
    block = b"software: lectern\r\nformat: WARC File Format 1.0\r\nconformsTo: http://bibnum.bnf.fr/WARC/WARC_ISO_28500_version1_latestdraft.pdf\r\n"
    return warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("", name, "", "")), ("WARC-Date", iso_time(CAPTURED)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.index(b"\r\n\r\n", at)
        lines = text_of(data[at:end]).split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC version line where a record should begin")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        at = end + 4 + int(headers["content-length"])
        block = data[end + 4 : at]
        if len(block) != int(headers["content-length"]):
            raise ValueError("the file ends inside a record")
        yield headers, block


def inflated(data: bytes) -> bytes:
    """Plain bytes, or all members of a gzip file one after the other."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data.lstrip(b"\0")
    return b"".join(out)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")


def _write(df: DataFrame, path: str, end: str) -> None:
    # bytes go into the text writer as they are
    df.select(F.col("value").cast("string")).write.option("lineSep", end).option("zlib.compress.level", "BEST_SPEED").text(path, compression="gzip")


def _spread(df: DataFrame, size: Column) -> DataFrame:
    """Dealt at random into files of about FILE_BYTES, so that no source or size gathers in one."""
    total = df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    return df.repartition(max(1, -(-int(total) // FILE_BYTES)))


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", version: str | None = None) -> None:
    """Write (id, url, payload) rows as gzipped ARC files; without a version, half of the files in each."""

    def records(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = None
        for p in parts:
            out = []
            for row, url, payload in zip(p["row"], p["url"], p["payload"], strict=True):
                if v is None:
                    v = version or "12"[zlib.crc32(str(row).encode()) & 1]
                    name = f"{uuid.uuid5(uuid.NAMESPACE_OID, str(row))}.arc"
                    out.append(arc_version_block(v, name))
                out.append(arc_record(v, name, row, url, payload))
            yield pd.DataFrame({"value": out}, dtype=object)

    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    d = pages.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("row"), F.col(url_col).alias("url"), payload.alias("payload"))
    _write(_spread(d, F.octet_length("payload")).mapInPandas(records, "value binary"), path, "\n")


def _frames(rows: Iterator[tuple], columns: list[str], whole: dict[str, str], most: int = 256, size: int = 4 << 20) -> Iterator[pd.DataFrame]:
    """Rows as frames of a few, or of some megabytes of payload (the last column)."""
    held: list[tuple] = []
    n = 0
    for r in rows:
        held.append(r)
        n += len(r[-1] or b"")
        if len(held) == most or n > size:
            yield pd.DataFrame(held, columns=columns, dtype=object).astype(whole)
            held, n = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns, dtype=object).astype(whole)


def read_arc_files(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, url, time, ip, kind, media, cut, bytes, digest, head, payload) of every ARC record below ``path``.

    ``head`` is what HTTP sent before the payload; size and digest are the payload's.
    """

    def found(data: bytes) -> Iterator[tuple]:
        for r in read_arc(inflated(data)):
            http = not re.match("(dns|ftp|file):", r["url"]) and r["body"].startswith(b"HTTP/")
            head, fields, payload = http_parts(r["body"]) if http else (b"", {}, r["body"])
            row = fields.get(EXTRA.lower(), "")
            yield int(row) if re.fullmatch(r"-?[0-9]{1,18}", row) else None, r["url"], iso_time(r["archive-date"]), r["ip-address"], "response" if http else "resource", r["content-type"], r["cut"], len(payload), hashlib.sha1(payload).hexdigest(), head, payload

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for data in p["content"]:
                yield from _frames(found(data), ["row_id", "url", "time", "ip", "kind", "media", "cut", "bytes", "digest", "head", "payload"], {"row_id": "Int64", "bytes": "int64", "cut": "bool"})

    return _files(spark, path).mapInPandas(run, "row_id long, url string, time string, ip string, kind string, media string, cut boolean, bytes long, digest string, head binary, payload binary")


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = MIN_BYTES) -> None:
    """Convert the ARC files below one folder to gzipped WARC files below another.

    Of records with equal payloads of ``min_bytes`` or more, the one with the largest
    row id becomes the response; the others revisit it, and keep their own HTTP
    headers. Records without a row id are archived in full.
    """

    def records(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun = False
        for p in parts:
            out = []
            for row, url, time, ip, kind, media, cut, size, digest, head, payload, first, first_url, first_time in zip(*(p[c] for c in ("row_id", "url", "time", "ip", "kind", "media", "cut", "bytes", "digest", "head", "payload", "first", "first_url", "first_time")), strict=True):
                own, to = (("" if pd.isna(x) else str(int(x))) for x in (row, first))
                if not begun:
                    begun = True
                    out.append(warc_info(f"{uuid.uuid5(uuid.NAMESPACE_OID, own + url)}.warc.gz"))
                headers = [("WARC-Type", "revisit" if to else kind), ("WARC-Record-ID", record_id(own, url, time, digest)), ("WARC-Target-URI", url), ("WARC-Date", time)]
                headers += [("WARC-IP-Address", ip)] * (ip not in ("0.0.0.0", "-", ""))
                headers += [("WARC-Payload-Digest", sha1_base32(digest)), ("X-Payload-Length", str(size)), (EXTRA, own)]
                if to:
                    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(to, first_url, first_time, digest))]
                    headers += [("WARC-Refers-To-Target-URI", first_url), ("WARC-Refers-To-Date", first_time), (f"{EXTRA}-Refers-To", to)]
                else:
                    headers += [("WARC-Identified-Payload-Type", media)] * (kind == "response")
                headers += [("WARC-Truncated", "unspecified")] * bool(cut)
                block = bytes(head) + (b"" if to else bytes(payload))
                headers += [("WARC-Block-Digest", sha1_base32(hashlib.sha1(block).hexdigest())), ("Content-Type", "application/http; msgtype=response" if kind == "response" else media)]
                out.append(warc_record(headers, block))
            yield pd.DataFrame({"value": out}, dtype=object)

    found = read_arc_files(spark, arc_path)
    keys = materialise(found.where((F.col("bytes") >= min_bytes) & F.col("row_id").isNotNull()).select("row_id", "digest", "url", "time"), "warc-digests")
    firsts = keys.groupBy("digest").agg(F.max(F.struct("row_id", "url", "time")).alias("f"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select("digest", F.col("f.row_id").alias("first"), F.col("f.url").alias("first_url"), F.col("f.time").alias("first_time"))
    refers = materialise(keys.select("row_id", "digest").distinct().join(firsts, "digest").where("row_id <> first"), "warc-refers")
    out = found.join(refers, ["row_id", "digest"], "left")  # written first, so that its size decides how they are joined
    _write(out.mapInPandas(records, "value binary"), warc_path, "\r\n\r\n")
    remove(spark, keys.scratch_path)
    remove(spark, refers.scratch_path)


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, record_id, type, url, time, payload_bytes, payload_digest, refers_to, refers_to_id, head, payload) of every record but those on the files.

    A record whose payload does not have the size and digest it declares stops the job.
    """

    def found(data: bytes) -> Iterator[tuple]:
        for h, block in read_warc(inflated(data)):
            if h["warc-type"] == "warcinfo":
                continue
            head, _, payload = (b"", {}, block) if h["warc-type"] == "resource" or not block.startswith(b"HTTP/") else http_parts(block)
            digest = base64.b32decode(h["warc-payload-digest"].partition(":")[2]).hex()
            full = h["warc-type"] != "revisit"
            if full and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(h["x-payload-length"])):
                raise ValueError(f"damaged record {h['warc-record-id']}")
            row, to = h[EXTRA.lower()], h.get(f"{EXTRA.lower()}-refers-to")
            yield int(row) if row else None, h["warc-record-id"], h["warc-type"], h["warc-target-uri"], h["warc-date"], int(h["x-payload-length"]), digest, int(to) if to else None, h.get("warc-refers-to"), head, payload if full else None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for data in p["content"]:
                yield from _frames(found(data), ["row_id", "record_id", "type", "url", "time", "payload_bytes", "payload_digest", "refers_to", "refers_to_id", "head", "payload"], {"row_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

    return _files(spark, path).mapInPandas(run, "row_id long, record_id string, type string, url string, time string, payload_bytes long, payload_digest string, refers_to long, refers_to_id string, head binary, payload binary")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write pages to ARC, convert to WARC, and return the records read back from WARC.

    One row per page: a null payload counts as empty, a null address becomes
    about:blank, a page without an id is archived in full and never referred to.
    Payloads are bytes, or text in UTF-8. Pages that share id and payload are each
    other's copies: all are responses. Other columns are ignored; an empty table gives
    no rows.
    """
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc, id_col, url_col, payload_col)
    arc_to_warc(spark, arc, warc, min_bytes)
    remove(spark, arc)
    return read_warc_files(spark, warc)


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= {MIN_BYTES} THEN max(page_id) OVER (PARTITION BY html) END AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""
