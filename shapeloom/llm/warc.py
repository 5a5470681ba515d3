"""WARC archives as a Python data source, format "warc".

Files are gzip members, one per record; each member's header carries its compressed length in an extra field, so a
reader that doesn't want a record steps over it. A reader inflates a record's header block first, tests the pushed
filters on it, and inflates the payload only of records that pass, and only if payloads are asked for. Archives of
others are read too: plain records are stepped over by their length, and members without the extra field are inflated
in pieces to find their end, without being kept.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from .store import new_path, written

SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, payload_length bigint, file string, offset bigint, payload binary"
#: Header names of the columns that filters can be pushed on.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
_DATE = "2024-01-01T00:00:00Z"
_HEAD = 1 << 14


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri)


def _manifests(store: fs.FileSystem, root: str) -> dict[str, list[str]]:
    """The lists of all commits, and the files each names."""
    out = {}
    for i in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if i.type == fs.FileType.File and (i.base_name == "MANIFEST" or i.base_name.startswith("MANIFEST-")):
            with store.open_input_stream(i.path, compression=None) as f:
                out[i.base_name] = f.read().decode().split()
    return out


def _one_line(x: str) -> str:
    return x.replace("\r", "%0D").replace("\n", "%0A")


def member(block: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field LX holds its whole compressed length."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    data = z.compress(block) + z.flush()
    n = 10 + 2 + 8 + len(data) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHI", 8, b"LX", 4, n) + data + struct.pack("<II", zlib.crc32(block), len(block) & 0xFFFFFFFF)


def record(kind: str, record_id: str | None, uri: str | None, digest: str, payload: bytes | None, refers_to: str | None, length: int) -> bytes:
    """One record; a revisit has no payload but keeps the digest and length of the full one."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http + (payload if payload is not None else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", _DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Refers-To", refers_to), ("X-Payload-Length", str(length))]
    if kind == "revisit":
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {_one_line(v)}\r\n" for k, v in head if v is not None) + "\r\n").encode("utf-8", "replace") + body + b"\r\n\r\n"


@dataclass
class Part(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files of its own names. Every commit lists those of its tasks in a MANIFEST of its own, so a path holds what all commits appended; one that overwrites removes the earlier lists, and then their files."""

    def __init__(self, path: str, max_bytes: int, overwrite: bool = False):
        self.path, self.max_bytes, self.overwrite = path, max_bytes, overwrite

    def write(self, batches):
        files, out, size = [], None, 0
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        try:
            for b in batches:
                for r in b.to_pylist():
                    if out is None or size >= self.max_bytes:
                        if out is not None:
                            out.close()
                        files.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = store.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                    data = member(record(r["record_type"], r["record_id"], r["target_uri"], r["payload_digest"], r["payload"], r["refers_to"], r["payload_length"]))
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return Part(files)

    def commit(self, messages):
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        before = _manifests(store, root) if self.overwrite else {}
        with store.open_output_stream(f"{root}/MANIFEST-{uuid.uuid4().hex}", compression=None) as f:
            f.write("".join(f"{x}\n" for m in messages if m for x in m.files).encode())
        for name in before:
            store.delete_file(f"{root}/{name}")
        for names in before.values():
            for x in names:
                store.delete_file(f"{root}/{x}")

    def abort(self, messages):
        store, root = _open(self.path)
        for m in messages:
            for x in m.files if m else ():
                store.delete_file(f"{root}/{x}")


@dataclass
class File(InputPartition):
    names: list


class Bytes:
    """The bytes of a plain file or of the gzip members of one, read on demand. take(n) gives the next n bytes of a record, skip(n) passes them by, end() goes to the next record."""

    def __init__(self, f, size: int):
        self.f, self.size, self.at = f, size, 0
        self.plain = f.read(2) != b"\x1f\x8b"
        self.open()

    def open(self) -> None:
        """At the begin of a record."""
        self.f.seek(self.at)
        self.raw = b"" if self.plain else self.f.read(min(_HEAD, self.size - self.at))
        self.held, self.passed = b"", 0
        if self.plain:
            return
        if self.raw[:2] != b"\x1f\x8b":
            raise ValueError(f"no gzip member at {self.at}")
        self.length = struct.unpack("<I", self.raw[16:20])[0] if self.raw[3] & 4 and self.raw[12:14] == b"LX" else None
        self.z = zlib.decompressobj(31)

    def _more(self, most: int = 1 << 16) -> bytes:
        """Some more bytes of the record; none at its end."""
        if self.plain:
            return self.f.read(most)
        got = b""
        while not got and not self.z.eof:
            fed = self.z.unconsumed_tail or self.raw or self.f.read(_HEAD)
            self.raw = b""
            if not fed:
                raise ValueError(f"the record at {self.at} is cut off")
            got = self.z.decompress(fed, most)
        return got

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the mark, which is passed; None at the end of the file."""
        begin = 0
        while (k := self.held.find(mark, begin)) < 0:
            begin = max(0, len(self.held) - len(mark) + 1)
            got = self._more(4096)
            if not got:
                return None
            self.held += got
        out, self.held = self.held[:k], self.held[k + len(mark) :]
        self.passed += k + len(mark)
        return out

    def take(self, n: int) -> bytes:
        pieces, have = [self.held], len(self.held)
        while have < n and (got := self._more(max(1 << 16, n - have))):
            pieces.append(got)
            have += len(got)
        if have < n:
            raise ValueError(f"the record at {self.at} is cut off")
        every = b"".join(pieces)
        out, self.held = every[:n], every[n:]
        self.passed += n
        return out

    def end(self, rest: int) -> None:
        """To the next record; rest: bytes of this one's block that were not taken."""
        if self.plain:
            self.at += self.passed + rest
            self.f.seek(self.at)
            while (c := self.f.read(1)) in (b"\r", b"\n"):
                self.at += 1
        elif self.length is not None:
            self.at += self.length
        else:
            while not self.z.eof:
                self._more()
            self.held = b""
            self.at = self.f.tell() - len(self.z.unused_data)
        if self.at < self.size:
            self.open()


class WarcReader(DataSourceReader):
    """Options: path; payload (default true); verify (default false): a payload that does not have its digest is an error; partition_bytes: small files are read together up to this size.

    Below path, the files that writers listed in their MANIFESTs are read, or all .warc and .warc.gz files where there is none.
    """

    def __init__(self, path: str, payload: bool, partition_bytes: int, verify: bool = False):
        self.path, self.payload, self.partition_bytes, self.verify = path, payload, partition_bytes, verify
        self.tests: list[tuple[str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = ".".join(f.attribute) if isinstance(f, (EqualTo, In, IsNotNull)) else None
            if column not in HEADERS:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((column, {f.value}))
            elif isinstance(f, In):
                self.tests.append((column, set(f.value)))
            else:
                self.tests.append((column, None))

    def partitions(self):
        store, root = _open(self.path)
        listed = _manifests(store, root)
        names = sorted(x for names in listed.values() for x in names)
        if not listed:
            every = store.get_file_info(fs.FileSelector(root, recursive=True))
            names = sorted(i.path[len(root) :].lstrip("/") for i in every if i.type == fs.FileType.File and i.path.lower().endswith((".warc", ".warc.gz")))
        out, size = [], 0
        for name, info in zip(names, store.get_file_info([f"{root}/{n}" for n in names])):
            if not out or size + info.size > self.partition_bytes:
                out.append(File([]))
                size = 0
            out[-1].names.append(name)
            size += info.size
        return out or [File([])]

    def _passes(self, row: dict) -> bool:
        return all(row.get(c) is not None and (values is None or row[c] in values) for c, values in self.tests)

    def read(self, partition):
        store, root = _open(self.path)
        rows, held = [], 0
        for name in partition.names:
            with store.open_input_file(f"{root}/{name}") as f:
                size = f.size()
                source = Bytes(f, size) if size else None
                while source and source.at < size:
                    lines = source.until(b"\r\n\r\n")
                    if lines is None:
                        raise ValueError(f"{name}: the record at {source.at} ends in its header")
                    # names of headers have no case; a line that begins with white space goes on with the one before
                    fields = re.sub(r"\r\n[ \t]+", " ", lines.decode("utf-8", "replace")).split("\r\n")[1:]
                    h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in fields)}
                    row = {c: h.get(k.lower()) for c, k in HEADERS.items()}
                    row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha1:") or None
                    rest = int(h.get("content-length", 0))
                    if self._passes(row):
                        known = int(h.get("x-payload-length", -1))
                        row |= {"file": name, "offset": source.at, "payload": None, "payload_length": known}
                        if row["record_type"] == "response" and (self.payload or known < 0 or self.verify):
                            block, rest = source.take(rest), 0
                            body = block.partition(b"\r\n\r\n")[2] if h.get("content-type", "").lower().startswith("application/http") else block
                            row["payload_length"] = len(body)
                            if self.verify and row["payload_digest"] and len(row["payload_digest"]) == 32 and base64.b32encode(hashlib.sha1(body).digest()).decode() != row["payload_digest"].upper():
                                raise ValueError(f"{name}: the payload at {source.at} does not have its digest")
                            row["payload"] = body if self.payload else None
                            held += len(body) if self.payload else 0
                        rows.append(row)
                        if len(rows) >= 5000 or held > 8 << 20:
                            yield self._batch(rows)
                            rows, held = [], 0
                    source.end(rest)
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"payload_length": pa.int64(), "offset": pa.int64(), "payload": pa.binary()}
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names], names=names)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true", int(self.options.get("partition_bytes", 64 << 20)), self.options.get("verify", "false").lower() == "true")

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], int(self.options.get("max_bytes", 64 << 20)), overwrite)


def base32(hex_: Column) -> Column:
    """Bare upper-case base32 of 40 hexadecimal digits, in built-in functions."""
    chars = []
    for k in range(0, 40, 5):
        n = F.conv(F.substring(hex_, k + 1, 5), 16, 10).cast("int")
        chars += [F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*chars)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def planned(pages: DataFrame, least_bytes: int = 0, broadcast_rows: int = 250_000) -> DataFrame:
    """pages(page_id, url, html) as records: of equal payloads of at least least_bytes, the one with the largest page_id is the response, and the others revisit it.

    A null html is an empty payload. Rows that share the largest page_id and the payload are all responses; where all
    page_ids are null, so are all. A null page_id or url gives a record without that header. Digests that occur more
    than once are broadcast up to broadcast_rows of them; beyond, the join shuffles, rows of one digest spread by salts.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    x = pages.select("page_id", "url", body.alias("payload"), F.octet_length(body).cast("long").alias("payload_length"), F.sha1(body).alias("hex"))
    last = x.where(F.col("payload_length") >= least_bytes).groupBy("hex").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 and last is not null").select("hex", "last")
    last = written(last, "digests")
    if last.count() <= broadcast_rows:
        x = x.join(F.broadcast(last), "hex", "left")
    else:
        last = last.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        x = x.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(16)).cast("int")).join(last, ["hex", "salt"], "left")
    again = F.col("last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("last")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return x.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), urn(F.col("page_id")).alias("record_id"), F.col("url").alias("target_uri"), base32(F.col("hex")).alias("payload_digest"),
        F.when(again, urn(F.col("last"))).alias("refers_to"), "payload_length", F.when(~again, F.col("payload")).alias("payload"),
    )


def archive(pages: DataFrame, path: str, least_bytes: int = 0) -> str:
    """Writes the records below path and returns it."""
    register(pages.sparkSession)
    planned(pages, least_bytes).write.format("warc").mode("append").save(path)
    return path


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = archive(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), new_path(spark, "warc"))
    got = spark.read.format("warc").load(path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    size = F.when(F.col("record_type") == "response", F.octet_length("payload")).otherwise(F.col("payload_length")).cast("long")
    return got.select(number(F.col("record_id")).alias("page_id"), size.alias("payload_bytes"), "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))
