"""WARC archives as a Python data source for reading and writing."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from tidemark.llm.common import load, scratch

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
#: Columns that a record's header gives, by the header's name.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path; file:/x is read as file:///x, a bare path as local, and Hadoop's names of S3 as s3."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith(("s3a://", "s3n://")):
        uri = "s3" + uri[3:]
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes, level: int) -> bytes:
    """A gzip member whose extra field holds its own length, so that readers can step over it undecoded."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    whole = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, whole, len(record) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(record_id: str, uri: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A response, or a revisit without the payload."""
    clean = lambda x: x.replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{clean(record_id)}>", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {clean(uri)}"] if uri is not None else []
    head += [f"WARC-Refers-To: <{clean(refers_to)}>", f"WARC-Profile: {REVISIT}"] if refers_to is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceWriter):
    """Files of gzip members, cut at max_bytes; the manifest names those of tasks that ended, so a retried task leaves no records twice."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.level, self.most, self.overwrite = options["path"], int(options.get("level", 6)), int(options.get("max_bytes", 1 << 30)), overwrite

    def write(self, rows: Iterator) -> _Written:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        for r in rows:
            if out is None or size >= self.most:
                if out:
                    out.close()
                files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                out, size = fs.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
            data = member(record(r["record_id"], r["target_uri"], bytes(r["payload"] or b""), r["refers_to"]), self.level)
            out.write(data)
            size += len(data)
        if out:
            out.close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        old = [] if self.overwrite or fs.get_file_info(f"{root}/_manifest.json").type != pafs.FileType.File else _manifest(self.path)
        with fs.open_output_stream(f"{root}/_manifest.json", compression=None) as f:
            f.write(json.dumps(old + [x for m in messages if m for x in m.files]).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        """Files of a failed job go; those of lost tasks stay, unnamed by the manifest."""
        fs, root = _fs(self.path)
        for m in messages:
            for x in m.files if m else ():
                fs.delete_file(f"{root}/{x}")


def _manifest(path: str) -> list[str]:
    fs, root = _fs(path)
    if fs.get_file_info(f"{root}/_manifest.json").type == pafs.FileType.File:
        with fs.open_input_stream(f"{root}/_manifest.json") as f:
            return json.loads(f.read())
    if fs.get_file_info(root).type == pafs.FileType.File:
        return [""]
    return sorted(x.base_name for x in fs.get_file_info(pafs.FileSelector(root)) if x.base_name.endswith((".warc", ".warc.gz")))


class WarcReader(DataSourceReader):
    """A partition for each file.  Predicates on header columns are tested on the parsed header, before the payload is decoded.

    Options: payload=false leaves payloads undecoded (null); verify=true checks response digests.  `decoded` counts the
    bytes that this reader unpacked from gzip members."""

    def __init__(self, options: dict):
        self.decoded = 0
        self.path, self.want, self.check, self.tests = options["path"], options.get("payload", "true") == "true", options.get("verify", "false") == "true", []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.tests.append((f.attribute[0], "prefix" if isinstance(f, StringStartsWith) else "in", (f.value,) if not isinstance(f, In) else tuple(f.value)))
            else:
                yield f

    def partitions(self):
        root = self.path.rstrip("/")
        return [_File(f"{root}/{x}" if x else root) for x in _manifest(self.path)]

    def keep(self, row: dict) -> bool:
        return all(row[c] is not None and (row[c] in v if how == "in" else row[c].startswith(v[0])) for c, how, v in self.tests)

    def read(self, partition: _File | None) -> Iterator[tuple]:
        if partition is None:  # what Spark hands out for an archive without files
            return
        fs, path = _fs(partition.path)
        with fs.open_input_stream(path, compression=None) as raw:
            yield from self._records(_Buffer(raw), path.endswith(".gz"))

    def _records(self, raw: _Buffer, packed: bool) -> Iterator[tuple]:
        while raw.more():
            start = raw.at
            source = _Member(raw) if packed else raw
            head = source.until(b"\r\n\r\n")
            lines = head.decode("utf-8", "replace").split("\r\n")
            got = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            row = {c: got.get(h.lower()) for c, h in HEADERS.items()}
            for c in ("record_id", "refers_to"):
                row[c] = row[c] and row[c].strip("<>")
            row["payload_digest"] = row["payload_digest"] and row["payload_digest"].removeprefix("sha1:")
            length = int(got.get("content-length", 0))
            if self.keep(row):
                http = source.until(b"\r\n\r\n", length) if "application/http" in got.get("content-type", "") else b""
                said = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length"), None)
                left = length - len(http)
                payload = None
                if row["record_type"] != "revisit" and (self.want or self.check):
                    payload = source.take(left)
                    if self.check and digest(payload) != row["payload_digest"]:
                        raise ValueError(f"record {row['record_id']}: the payload doesn't have the digest of its header")
                    length = 0
                else:
                    length = left
                size = said if row["record_type"] == "revisit" or payload is None and said is not None else left if payload is None else len(payload)
                yield (row["record_id"], row["record_type"], row["target_uri"], row["refers_to"], row["payload_digest"], size, payload if self.want else None)
            if packed:
                source.leave(start)
                self.decoded += source.decoded
            else:
                source.skip(length + 4)


class _Buffer:
    """Forward reader of a stream."""

    def __init__(self, raw, block: int = 1 << 20):
        self.raw, self.block, self.data, self.pos, self.at = raw, block, b"", 0, 0

    def fill(self, n: int) -> int:
        """Makes n bytes ready, if there are so many; how many are."""
        while len(self.data) - self.pos < n:
            got = self.raw.read(max(self.block, n - (len(self.data) - self.pos)))
            if not got:
                break
            self.data, self.pos = self.data[self.pos :] + got, 0
        return len(self.data) - self.pos

    def more(self) -> bool:
        return self.fill(1) > 0

    def take(self, n: int) -> bytes:
        if self.fill(n) < n:
            raise ValueError("the archive ends inside a record")
        out = self.data[self.pos : self.pos + n]
        self.pos += n
        self.at += n
        return out

    def skip(self, n: int) -> None:
        while n > 0:
            k = min(n, self.fill(min(n, self.block)))
            if not k:
                return
            self.pos += k
            self.at += k
            n -= k

    def until(self, mark: bytes, most: int | None = None) -> bytes:
        n = 1024
        while True:
            have = self.fill(n)
            i = self.data.find(mark, self.pos, self.pos + have)
            if i >= 0:
                return self.take(i + len(mark) - self.pos)
            if have < n or most is not None and have >= most:
                return self.take(min(have, most or have))
            n *= 2


class _Member(_Buffer):
    """The inside of a gzip member; decodes as far as it is asked to."""

    def __init__(self, outer: _Buffer):
        super().__init__(None, 1 << 12)
        self.decoded = 0
        self.outer, self.whole, self.z = outer, None, zlib.decompressobj(31)
        if outer.fill(24) >= 24 and outer.data[outer.pos + 3] & 4 and outer.data[outer.pos + 12 : outer.pos + 14] == b"sl":
            self.whole = struct.unpack_from("<I", outer.data, outer.pos + 16)[0]

    def fill(self, n: int) -> int:
        while len(self.data) - self.pos < n and not self.z.eof:
            src = self.z.unconsumed_tail or self.outer.take(min(self.outer.fill(1), 1 << 14))
            got = self.z.decompress(src, max(self.block, n - (len(self.data) - self.pos)))
            self.decoded += len(got)
            if self.z.eof and self.z.unused_data:
                back = len(self.z.unused_data)
                self.outer.pos -= back
                self.outer.at -= back
            self.data, self.pos = self.data[self.pos :] + got, 0
        return len(self.data) - self.pos

    def leave(self, start: int) -> None:
        """Goes to the next member: by the length in the header, or else by decoding the rest."""
        if self.whole is not None and not self.z.eof:
            left = start + self.whole - self.outer.at
            if left < 0:  # a short member: what was taken beyond it goes back
                self.outer.pos += left
                self.outer.at += left
            self.outer.skip(left)
            return
        while not self.z.eof:
            self.data, self.pos = b"", 0
            if not self.fill(1) and not self.z.eof:
                raise ValueError("the archive ends inside a record")


class WarcSource(DataSource):
    """spark.read.format("warc") and df.write.format("warc"); written columns: record_id, target_uri, refers_to, payload."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """A record for each page.  Of pages with equal payloads of at least min_bytes bytes, that with the largest page_id is a response and the others revisit it.

    A null html is an empty payload; rows that share the largest page_id are all responses; null page_ids are below
    all others.  An empty table makes an archive without records.
    """
    register(pages.sparkSession)
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("sha", F.sha1("payload"))
    groups = p.where(F.octet_length("payload") >= min_bytes).groupBy(F.col("sha").alias("_sha")).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("_sha", "first")
    p = p.join(groups.hint("shuffle_hash"), F.col("sha") == F.col("_sha"), "left")
    again = F.col("_sha").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    p.select(urn(F.col("page_id")).alias("record_id"), F.col("url").alias("target_uri"), F.when(again, urn(F.col("first"))).alias("refers_to"), "payload").write.format("warc").mode("append").option("path", path).save()


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pushed-down reads of the archive: responses are decoded and held against their digests, revisits are read from
    headers alone, past the responses' undecoded payloads."""
    path = scratch(spark)
    write_pages(load(spark, sf_dir, "pages"), path)
    read = lambda **o: spark.read.format("warc").option("path", path).options(payload="false", **o).load()
    r = read(verify="true").where("record_type = 'response'").unionByName(read().where("record_type = 'revisit'"))
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")
    return r.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h FROM p),
g AS (SELECT h, max(page_id) AS first_id FROM d GROUP BY h),
bits AS (SELECT page_id, h, unnest(range(0, 32)) AS i FROM d),
digits AS (SELECT page_id, i, list_sum(list_transform(range(0, 5), lambda k:
             (((strpos('0123456789abcdef', substr(h, CAST((5 * i + k) // 4 AS INT) + 1, 1)) - 1) >> (3 - CAST((5 * i + k) % 4 AS INT))) & 1) << (4 - CAST(k AS INT)))) AS v FROM bits),
b32 AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v AS INT) + 1, 1), '' ORDER BY i) AS payload_digest FROM digits GROUP BY page_id)
SELECT d.page_id, payload_bytes, payload_digest, CASE WHEN d.page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN d.page_id <> first_id THEN first_id END AS refers_to
FROM d JOIN g USING (h) JOIN b32 ON b32.page_id = d.page_id
"""
