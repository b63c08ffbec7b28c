"""Archives: legacy ARC files are parsed by the header line of their version and converted to WARC records.

An archive is a table of chunks of bytes, each a whole number of records, so that Spark writes and reads it on any
store and commits it task by task; the chunks of an archive, one after another, are the file itself.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from base64 import b32decode, b32encode

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import chunks, need, scratch_path, table, written

#: Fixed values of the ARC format: the fields of a record's header line, by version.
ARC_FIELDS = {
    "1": ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    "2": ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
CHUNK_BYTES = 4 << 20
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nX-Page-Id: %s\r\nContent-Length: %d\r\n\r\n"


class BadArchive(ValueError):
    pass


def _ascii(text: str) -> str:
    """A header value: white space and control characters would end the field."""
    return re.sub(r"[\s\x00-\x1f\x7f]", lambda m: "%%%02X" % ord(m[0]) if ord(m[0]) < 256 else "%20", text) or "-"


def arc_header(version: str, name: str, date: str) -> bytes:
    """The version block that begins an ARC file."""
    fields = " ".join(ARC_FIELDS[version])
    body = f"{version} 0 attesta\n{fields}\n\n".encode()
    kind = "text/plain"
    line = f"filedesc://{name} 0.0.0.0 {date} {kind} {len(body)}" if version == "1" else f"filedesc://{name} 0.0.0.0 {date} {kind} 200 - - 0 {name} {len(body)}"
    return line.encode() + b"\n" + body + b"\n"


def arc_record(version: str, url: str, date: str, content: bytes, name: str = "-") -> bytes:
    url = _ascii(url)
    line = f"{url} 0.0.0.0 {date} text/html {len(content)}" if version == "1" else f"{url} 0.0.0.0 {date} text/html 200 - - 0 {name} {len(content)}"
    return line.encode() + b"\n" + content + b"\n"


_ADDRESS = r"(?P<ip>\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f]*:[0-9A-Fa-f:.]+|-) (?P<date>\d{8}(?:\d\d){0,3})"
#: Address and date, the length at the end and, in version 2, what stands before it are recognised; URL and type are what
#: is left, with any spaces.
ARC_LINES = {
    "1": re.compile(rf"(?P<url>.+) {_ADDRESS}(?: (?P<type>.*))? (?P<size>\d+)"),
    "2": re.compile(rf"(?P<url>.+) {_ADDRESS} (?P<type>.*?) ?(?P<code>\d{{3}}|-) (?P<sum>\S+) (?P<place>.*?) ?(?P<offset>\d+|-) (?P<file>\S+) (?P<size>\d+)"),
}
#: Bytes of a header line at most.
LINE_BYTES = 1 << 16


def arc_line(line: bytes, version: str | None) -> dict[str, str] | None:
    """The fields of a header line of ``version``, of either where that isn't known; None if it isn't one."""
    text = line.decode("utf-8", "replace").rstrip("\r")
    for v in (version,) if version else ("2", "1"):
        if m := ARC_LINES[v].fullmatch(text):
            values = [m["url"], m["ip"], m["date"], m["type"] or "-", *([m["code"], m["sum"], m["place"] or "-", m["offset"], m["file"]] if v == "2" else []), m["size"]]
            return dict(zip(ARC_FIELDS[v], values, strict=True))
    return None


def read_arc(data: bytes, skipped: list[str] | None = None):
    """(fields, content) of each record, the version block among them, whose URL begins with filedesc://.

    The version block names the version of the lines after it; without one each line is taken for what it looks like.
    A bad record (a line that is no header line, or a length that passes the end) is left out and told to ``skipped``:
    reading goes on behind its declared length if a header line or the end comes there, else at the next line that is one.
    """
    skipped = [] if skipped is None else skipped
    at, version = 0, None

    def header(start: int) -> tuple[dict[str, str] | None, int]:
        end = data.find(b"\n", start, start + LINE_BYTES)
        end = end if end >= 0 else len(data) if len(data) - start < LINE_BYTES else start + LINE_BYTES
        return arc_line(data[start:end], version), end + 1

    def next_line(start: int) -> int:
        """Behind the line feeds between records."""
        while start < len(data) and data[start] in b"\r\n":
            start += 1
        return start

    while (at := next_line(at)) < len(data):
        found, begin = header(at)
        stop = begin + int(found["Archive-length"]) if found else 0
        if found and stop <= len(data):
            content = data[begin:stop]
            if found["URL"].startswith("filedesc://") and content[:1].decode("latin-1") in ARC_FIELDS:
                version = content[:1].decode()
            yield found, content
            at = stop
            continue
        skipped.append("a declared length passes the end" if found else "no header line")
        size = re.search(rb" (\d{1,15})\r?$", data[at : begin - 1])
        if not found and size and (behind := begin + int(size[1])) <= len(data):
            behind = next_line(behind)
            if behind == len(data) or header(behind)[0]:
                at = behind
                continue
        at = begin
        while at < len(data) and not header(at)[0]:
            end = data.find(b"\n", at)
            at = end + 1 if end >= 0 else len(data)


def timestamp(arc_date: str) -> str:
    """YYYYMMDDhhmmss (or its first 8, 10 or 12 digits) as a WARC date."""
    d = (arc_date + "00000000000000")[:14] if len(arc_date) in (8, 10, 12, 14) and arc_date.isdigit() else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*parts: str) -> str:
    """The same parts give the same identifier, however often a task runs."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(parts))}>"


def warc_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_warc(data: bytes):
    """(headers, block) of each record."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        head = data[at:end].decode().split("\r\n") if end >= 0 else [""]
        if not head[0].startswith("WARC/"):
            raise BadArchive("no record begins here")
        headers = dict(x.split(": ", 1) for x in head[1:])
        size = int(headers["Content-Length"])
        at = end + 4 + size + 4
        if at > len(data) or data[at - 4 : at] != b"\r\n\r\n":
            raise BadArchive("a declared length doesn't end at a record's end")
        yield headers, data[end + 4 : end + 4 + size]


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP headers (lower-case names) and payload of a response; a block without a status line is all payload."""
    end = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or end < 0:
        return {}, block
    lines = block[:end].decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, block[end + 4 :]


def sha1_32(payload: bytes) -> str:
    return "sha1:" + b32encode(hashlib.sha1(payload).digest()).decode()


def page_record_id(page: str, date: str) -> str:
    return record_id("page", page, date)


def convert_info(record: dict[str, str], content: bytes, *names: str) -> tuple[str, bytes]:
    """The identifier and the record of type warcinfo that a version block becomes; ``names`` part equal blocks."""
    lines = content.decode("utf-8", "replace").splitlines()
    name, date = record["URL"].removeprefix("filedesc://"), timestamp(record["Archive-date"])
    about = [("software", "attesta"), ("format", "WARC File Format 1.1"), ("description", "converted from an ARC file"), ("arc-version", lines[0] if lines else "-"), ("arc-fields", lines[1] if len(lines) > 1 else "-")]
    block = "".join(f"{k}: {v}\r\n" for k, v in about).encode()
    own = record_id("warcinfo", name, date, *names)
    headers = [("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Filename", _ascii(name)), ("WARC-Block-Digest", sha1_32(block)), ("Content-Type", "application/warc-fields")]
    return own, warc_record("warcinfo", headers, block)


def convert(record: dict[str, str], content: bytes, original: int | None = None, original_url: str | None = None, info: str | None = None) -> bytes:
    """One ARC record as a WARC record: response, or revisit of the page ``original``, whose payload is left out.

    Content that is no HTTP message, as DNS answers, becomes a resource record. ``info`` is the record of its version block.
    """
    http, payload = split_http(content)
    url, date = _ascii(record["URL"]), timestamp(record["Archive-date"])
    page = http.get("x-page-id")
    name = record_id(url, date) if page is None else page_record_id(page, date)
    headers = [("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", url)]
    if (ip := record["IP-address"]) not in ("0.0.0.0", "-"):
        headers.append(("WARC-IP-Address", ip))
    if info:
        headers.append(("WARC-Warcinfo-ID", info))
    headers.append(("WARC-Payload-Digest", sha1_32(payload)))
    if len(payload) == len(content):  # an HTTP message has a head at least
        return warc_record("resource", [*headers, ("WARC-Block-Digest", sha1_32(content)), ("Content-Type", _line(record["Content-type"]))], content)
    kind = ("Content-Type", "application/http; msgtype=response")
    if original is None:
        return warc_record("response", [*headers, ("WARC-Block-Digest", sha1_32(content)), kind], content)
    block = content[: len(content) - len(payload)]
    refers = [("WARC-Refers-To", page_record_id(str(original), date)), ("WARC-Refers-To-Target-URI", _ascii(original_url or "")), ("WARC-Refers-To-Date", date)]
    return warc_record("revisit", [*headers, ("WARC-Block-Digest", sha1_32(block)), ("WARC-Profile", PROFILE), *refers, ("WARC-Truncated", "length"), kind], block)


def _line(text: str) -> str:
    """A header value of several words: control characters become spaces."""
    return re.sub(r"[\x00-\x1f\x7f]+", " ", text).strip() or "-"


#: ``skipped``: bad records of the source that were left out on the way to this chunk.
ARCHIVE = "archive int, chunk int, records int, skipped int, data binary"


def _archive_batch(rows):
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["archive", "chunk", "records", "skipped", "data"])


class _Chunks:
    """Collects records into chunks of an archive for each task."""

    def __init__(self):
        self.archive, self.chunk = TaskContext.get().partitionId(), 0
        self.held, self.size, self.infos, self.skipped = [], 0, 0, []

    def put(self, record: bytes):
        self.held.append(record)
        self.size += len(record)
        return self.take() if self.size >= CHUNK_BYTES else None

    def info(self, record: dict[str, str], content: bytes) -> str:
        """Puts the record of a version block, never as the last of a chunk, and gives its identifier."""
        self.infos += 1
        own, made = convert_info(record, content, str(self.archive), str(self.infos))
        self.held.append(made)
        self.size += len(made)
        return own

    def take(self):
        if not self.held and not self.skipped:
            return None
        row = (self.archive, self.chunk, len(self.held), len(self.skipped), b"".join(self.held))
        self.held, self.size, self.chunk = [], 0, self.chunk + 1
        self.skipped.clear()
        return _archive_batch([row])


def convert_archives(arcs: DataFrame, data_col: str = "data") -> DataFrame:
    """A table of WARC chunks from a table of whole ARC files or chunks (column ``data``), all as responses.

    A version block becomes a warcinfo record, which the records after it name. Bad records are left out and counted in
    ``skipped``, see :func:`read_arc`. A null or empty file has no records; other columns are ignored.
    """
    need(arcs, data_col)

    def run(batches):
        out = _Chunks()
        for batch in batches:
            for data in batch.column(0).to_pylist():
                info = None
                for record, content in read_arc(data or b"", out.skipped):
                    if record["URL"].startswith("filedesc://"):
                        info = out.info(record, content)
                    elif (done := out.put(convert(record, content, info=info))) is not None:
                        yield done
        if (done := out.take()) is not None:
            yield done

    return arcs.select(data_col).mapInArrow(run, ARCHIVE)


#: Parts of a key that many rows may share.
SALT = 16


def _salted(rows: DataFrame, small: DataFrame, key: str, place) -> DataFrame:
    """``rows`` left-joined with ``small``, one row a key: rows of a hot key are parted by a hash of ``place``."""
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(*place), F.lit(SALT)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return spread.join(copies, [key, "_salt"], "left").drop("_salt")


def with_originals(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """Adds payload (binary), digest (hex SHA-1), original and original_url: the largest id among rows with the same payload
    of at least ``least`` bytes, where there are several, and its url. Digests are counted before the shuffle; the rows of one digest
    meet its original in ``SALT`` parts."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8")
    sized = pages.withColumn("payload", payload).withColumn("digest", F.sha1("payload"))
    keyed = pages.select(F.sha1(payload).alias("digest"), F.length(payload).alias("n"), F.struct(F.col(id_col).alias("i"), F.col(url_col).alias("u")).alias("r"))
    copies = keyed.filter(F.col("n") >= least).groupBy("digest").agg(F.max("r").alias("r"), F.count(F.lit(1)).alias("copies"))
    copies = written(copies.filter("copies > 1").select("digest", F.col("r.i").alias("original"), F.col("r.u").alias("original_url")), "copies")
    return _salted(sized, copies, "digest", [F.col(id_col), F.monotonically_increasing_id()])


def _write(version: str, date: str):
    """Rows (id, url, payload, original id) become ARC records, which are parsed and converted to WARC records."""

    def run(batches):
        out = _Chunks()
        for batch in batches:
            ids, urls, payloads, originals, places = (batch.column(i).to_pylist() for i in range(5))
            for i, j in chunks([len(p) for p in payloads], CHUNK_BYTES):
                arc = [arc_header(version, "pages.arc", date)]
                for page, url, payload in zip(ids[i:j], urls[i:j], payloads[i:j], strict=True):
                    arc.append(arc_record(version, url or "", date, HTTP % (str(page).encode(), len(payload)) + payload))
                records = read_arc(b"".join(arc))
                info = out.info(*next(records))
                for (record, content), page, original, place in zip(records, ids[i:j], originals[i:j], places[i:j], strict=True):
                    if (done := out.put(convert(record, content, original if original != page else None, place, info))) is not None:
                        yield done
        if (done := out.take()) is not None:
            yield done

    return run


def write_pages(pages: DataFrame, path: str, version: str = "2", date: str = "20080430204825", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes the archive ``path`` with a record for each row of ``pages``.

    Rows are framed as ARC records of ``version`` and run through the converter. Of rows with equal payloads of
    1000 bytes or more the one with the largest id is the response, the others revisit it and carry no payload.
    Defined cases: a null html is an empty payload, a null url "-"; a null id is never an original and revisits
    one if its payload has one; repeated rows of the original are responses too; an empty table gives an empty
    archive; other columns are ignored.
    """
    need(pages, id_col, url_col, html_col)
    kept = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    ready = with_originals(kept, "id").select("id", "url", "payload", "original", "original_url")
    ready.mapInArrow(_write(version, date), ARCHIVE).write.parquet(path)


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers_to_id string, url string, date string, payload binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Per record of an archive but warcinfo: page_id, payload_bytes, payload_digest, record_type, record_id, refers_to_id, url,
    date, payload.

    A response's digest is computed again from its payload and held against the header; a revisit has no payload,
    its length and digest are those in its headers.
    """

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = []
                for headers, block in read_warc(data):
                    if sha1_32(block) != headers["WARC-Block-Digest"]:
                        raise BadArchive("a block's digest differs")
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    http, payload = split_http(block)
                    kind = headers["WARC-Type"]
                    digest = headers["WARC-Payload-Digest"]
                    if kind != "revisit" and sha1_32(payload) != digest:
                        raise BadArchive("a payload's digest differs")
                    page = http.get("x-page-id", "None")
                    n = int(http["content-length"]) if kind == "revisit" else len(payload)
                    rows.append((None if page == "None" else int(page), n, _hex(digest), kind, headers["WARC-Record-ID"], headers.get("WARC-Refers-To"), headers["WARC-Target-URI"], headers["WARC-Date"], payload))
                if not rows:
                    continue
                kinds = (pa.int64(), pa.int64(), *[pa.string()] * 6, pa.binary())
                names = [f.split()[0] for f in RECORDS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return spark.read.schema(ARCHIVE).parquet(path).select("data").mapInArrow(run, RECORDS)


def resolved(records: DataFrame, index: DataFrame) -> DataFrame:
    """``records`` with refers_to, the page whose record a revisit refers to, in place of both record ids.

    ``index``: the records without payloads. Only records that are referred to are looked up, each once; one that many
    revisits refer to is met in ``SALT`` parts. Revisits of a record that isn't in the archive have null.
    """
    wanted = index.filter("refers_to_id is not null").select(F.col("refers_to_id").alias("record_id")).distinct()
    pages = index.filter("record_type <> 'revisit'").join(wanted, "record_id", "left_semi")
    pages = pages.groupBy(F.col("record_id").alias("refers_to_id")).agg(F.min("page_id").alias("refers_to"))
    return _salted(records, pages, "refers_to_id", [F.col("page_id"), F.col("record_id")]).drop("record_id", "refers_to_id")


def read_pages(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """:func:`read_records` with revisits resolved to pages by an index of the archive, which is written once."""
    records = read_records(spark, path)
    index = written(records.drop("payload"), "index")
    return resolved(records if with_payload else index, index)


def _hex(digest: str) -> str:
    return b32decode(digest.partition(":")[2]).hex()


def op10_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archive")
    write_pages(table(spark, sf_dir, "pages"), path)
    return read_pages(spark, path, with_payload=False).drop("url", "date")


OP10_SQL = f"""
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
t as (select *, case when payload_bytes >= {REVISIT_BYTES} then max(page_id) over (partition by payload_digest) end as original from p)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
       case when original <> page_id then 'revisit' else 'response' end as record_type,
       case when original <> page_id then original end as refers_to
from t
"""
