"""WARC archives as a Spark data source, and pages written as such with equal payloads stored once.

``spark.dataSource.register(WarcDataSource)``, then ``spark.read.format("warc").load(folder)`` and
``df.write.format("warc").mode("append").save(folder)``. Folders may be in any store that Arrow's file systems open.

Reading. Files are packed into partitions by their sizes. Of each record the headers are parsed first; predicates on them, which
Spark hands down (``PUSHDOWN`` must be on in the session), are tested on the headers alone. The rest of a record that they reject, or
whose payload isn't asked for, is passed over: plain files by a seek; compressed ones by a seek too where the gzip header says how long
the member is, as those that are written here do, else by inflating into nothing. Only payloads that are asked for are decoded.

Writing. A record is one gzip member whose extra field ``SL`` holds its compressed and plain lengths, which other readers ignore. Each
task writes files into a folder of its job; the job's commit moves them, so that of failed or repeated tasks nothing is seen.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from terrafolio.llm.common import small_batches

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, payload_length long, refers_to string, headers map<string,string>, payload binary"
#: Columns that headers give, by the header's name in lower case.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
LENGTH = "x-payload-length"
GZIP = b"\x1f\x8b\x08"
#: A gzip header with an extra field of 12 bytes: SL, 8, then two lengths.
MEMBER = GZIP + b"\x04\x00\x00\x00\x00\x00\xff\x0c\x00SL\x08\x00"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
UNDATED = "1970-01-01T00:00:00Z"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _location(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system and the path in it; paths without a scheme are local."""
    if "://" not in path and not path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return arrow_fs.FileSystem.from_uri(path)


class Bytes:
    """Bytes of a file by their offset, read in steps of ``step`` bytes."""

    def __init__(self, file: pa.NativeFile, step: int = 1 << 18) -> None:
        self.file, self.step, self.size, self.at, self.held = file, step, file.size(), 0, b""

    def read(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if not self.at <= at or at + n > self.at + len(self.held):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(max(n, self.step))
        return self.held[at - self.at : at - self.at + n]


def parse_headers(head: bytes) -> dict[str, str]:
    """Headers by name in lower case; lines that begin with white space go on with the one before."""
    found: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


#: What to do with a record once its headers are known.
SKIP, HEAD, ALL = 0, 1, 2


def read_records(data: Bytes, decide: Callable[[dict[str, str]], int]) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers of each record that ``decide`` doesn't skip, and its block if it says ALL. An empty file has none; a broken one raises."""
    at = 0
    while at < data.size:
        if data.read(at, 2) in (b"\r\n", b"\n\n"):  # blank lines between records
            at += 2
        elif data.read(at, 3) == GZIP:
            headers, block, what, at = _member(data, at, decide)
            if what:
                yield headers, block
        elif data.read(at, 5) == b"WARC/":
            n, head = 1 << 11, b""
            while (end := head.find(b"\r\n\r\n")) < 0:
                if at + len(head) >= data.size:
                    raise ValueError(f"the record at byte {at} has no end of headers")
                n *= 2
                head = data.read(at, n)
            headers = parse_headers(head[:end])
            length = int(headers.get("content-length", 0))
            if at + end + 4 + length > data.size:
                raise ValueError(f"the record at byte {at} is cut off")
            if what := decide(headers):
                yield headers, data.read(at + end + 4, length) if what == ALL else None
            at += end + 4 + length
        else:
            raise ValueError(f"no record begins at byte {at}")


def _member(data: Bytes, at: int, decide: Callable[[dict[str, str]], int]) -> tuple[dict[str, str], bytes | None, int, int]:
    """Headers, block if asked for, decision, and where the next member begins, of the gzip member at ``at``."""
    start = data.read(at, len(MEMBER) + 8)
    known = struct.unpack("<II", start[len(MEMBER) :])[0] if start.startswith(MEMBER) and len(start) == len(MEMBER) + 8 else 0
    inflate, read, out, end = zlib.decompressobj(31), at, b"", -1

    def more(n: int) -> bytes:
        nonlocal read
        chunk = data.read(read, n)
        if not chunk:
            raise ValueError(f"the member at byte {at} is cut off")
        read += len(chunk)
        return inflate.decompress(chunk)

    while end < 0 and not inflate.eof:
        out += more(1 << 10)
        end = out.find(b"\r\n\r\n")
    if end < 0 or not out.startswith(b"WARC/"):
        raise ValueError(f"the member at byte {at} holds no record")
    headers = parse_headers(out[:end])
    what = decide(headers)
    if what == ALL:
        parts = [out[end + 4 :]]
        while not inflate.eof:
            parts.append(more(1 << 16))
        block = b"".join(parts)[: int(headers.get("content-length", 0))]
        return headers, block, what, read - len(inflate.unused_data)
    if known:
        return headers, None, what, at + known
    while not inflate.eof:
        more(1 << 16)
    return headers, None, what, read - len(inflate.unused_data)


def payload_of(headers: dict[str, str], block: bytes) -> bytes | None:
    """What a block holds behind its HTTP headers, with chunks joined and gzip or deflate undone; null for revisits, whose payload is elsewhere."""
    if headers.get("warc-type") == "revisit":
        return None
    if not headers.get("content-type", "").startswith("application/http"):
        return block
    head, _, body = block.partition(b"\r\n\r\n")
    http = parse_headers(head)
    if "chunked" in http.get("transfer-encoding", "").lower():
        parts, at = [], 0
        while (end := body.find(b"\r\n", at)) >= 0 and (n := int(body[at:end].split(b";")[0] or b"0", 16)):
            parts.append(body[end + 2 : end + 2 + n])
            at = end + 4 + n
        body = b"".join(parts)
    coding = http.get("content-encoding", "").lower()
    if coding in ("gzip", "x-gzip"):
        return zlib.decompress(body, 31)
    return zlib.decompress(body) if coding == "deflate" else body


def values_of(headers: dict[str, str]) -> dict[str, str | None]:
    """The columns that headers give: record ids without their brackets, digests without the name of the function."""
    found = {column: headers.get(name) for column, name in HEADERS.items()}
    for column in ("record_id", "refers_to"):
        if found[column] is not None:
            found[column] = found[column].removeprefix("<").removesuffix(">")
    if found["payload_digest"] is not None:
        found["payload_digest"] = found["payload_digest"].rpartition(":")[2]
    return found


def _tester(wanted: Filter) -> Callable[[dict[str, str | None]], bool] | None:
    """The predicate on header columns as a function, with SQL's nulls as false; None if it can't be tested on headers."""
    if isinstance(wanted, Not):
        inner = _tester(wanted.child) if isinstance(wanted.child, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)) else None
        return inner and (lambda v, c=wanted.child.attribute[0]: v[c] is not None and not inner(v))
    if not isinstance(wanted, (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, StringStartsWith, StringEndsWith, StringContains)) or len(wanted.attribute) != 1 or wanted.attribute[0] not in HEADERS:
        return None
    column = wanted.attribute[0]
    if isinstance(wanted, (IsNull, IsNotNull)):
        return lambda v, null=isinstance(wanted, IsNull): (v[column] is None) == null
    if isinstance(wanted, EqualNullSafe):
        return lambda v: v[column] == wanted.value
    if isinstance(wanted, In):
        if None in wanted.value:  # null then makes a difference that a plain test doesn't show
            return None
        return lambda v, these=frozenset(wanted.value): v[column] in these
    test = {EqualTo: str.__eq__, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: str.__contains__}[type(wanted)]
    return lambda v: v[column] is not None and wanted.value is not None and test(v[column], wanted.value)


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.partition_bytes = int(options.get("partitionbytes", 128 << 20))
        self.batch_bytes = int(options.get("batchbytes", 8 << 20))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for wanted in filters:
            if _tester(wanted) is None:
                yield wanted
            else:
                self.filters.append(wanted)

    def partitions(self) -> list[Files]:
        """Files in the order of their names, packed up to ``partitionBytes``; larger ones alone."""
        store, path = _location(self.path)
        info = store.get_file_info(path)
        if info.type == arrow_fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == arrow_fs.FileType.File else store.get_file_info(arrow_fs.FileSelector(path, recursive=True))
        packed: list[Files] = []
        room = -1
        for f in sorted((f for f in found if f.type == arrow_fs.FileType.File and f.path.endswith((".warc", ".warc.gz")) and not any(x.startswith(("_", ".")) for x in f.path.removeprefix(path).split("/"))), key=lambda f: f.path):
            if room < f.size:
                packed.append(Files([]))
                room = self.partition_bytes
            packed[-1].paths.append(f.path)
            room -= f.size
        return packed or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        tests = [_tester(f) for f in self.filters]
        whole = ALL if self.payload else HEAD
        decide = lambda headers: whole if not tests or all(map((lambda v: lambda t: t(v))(values_of(headers)), tests)) else SKIP
        store, _ = _location(self.path)
        rows: list[dict] = []
        size = 0
        for path in partition.paths:
            with store.open_input_file(path) as file:
                try:
                    for headers, block in read_records(Bytes(file), decide):
                        payload = None if block is None else payload_of(headers, block)
                        rows.append(values_of(headers) | {"payload_length": int(headers[LENGTH]) if headers.get(LENGTH, "").isdigit() else None, "headers": list(headers.items()), "payload": payload})
                        size += 500 + len(payload or b"")
                        if size >= self.batch_bytes:
                            yield self._batch(rows)
                            rows, size = [], 0
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from e
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"payload_length": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names], names=names)


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


def one_line(value: str) -> str:
    """A header's value, which can't hold line ends: they are percent-encoded, white space around it goes."""
    return value.replace("\r", "%0D").replace("\n", "%0A").strip()


def record_bytes(row: dict, payload: bytes) -> bytes:
    """A response or revisit record of HTTP, plain; a revisit's block ends with its HTTP headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {row.get('content_type') or 'text/html; charset=utf-8'}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if row["record_type"] == "revisit" else http + payload
    headers = {"WARC-Type": row["record_type"], "WARC-Record-ID": f"<{one_line(row['record_id'])}>", "WARC-Date": row.get("date") or UNDATED}
    if row.get("target_uri") is not None:
        headers["WARC-Target-URI"] = one_line(row["target_uri"])
    if row["record_type"] == "revisit":
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{one_line(row['refers_to'])}>"}
    headers |= {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}", "X-Payload-Length": str(len(payload)), "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 6) -> bytes:
    """A record as a gzip member that says how long it is."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    total = len(MEMBER) + 8 + len(body) + 8
    return MEMBER + struct.pack("<II", total, len(record) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


class WarcWriter(DataSourceArrowWriter):
    """Rows of record_id, record_type (response or revisit), refers_to, payload, and if there target_uri, date, content_type."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.plain = options.get("compression", "gzip") == "none"
        self.level = int(options.get("level", 6))
        self.file_bytes = int(options.get("filebytes", 256 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = _location(self.path)
        folder = f"{path}/_temporary-{self.job}"
        store.create_dir(folder, recursive=True)
        paths: list[str] = []
        out = None
        for batch in iterator:
            payloads = batch.column(batch.schema.get_field_index("payload"))
            for row, payload in zip(batch.drop_columns(["payload"]).to_pylist(), payloads):
                record = record_bytes(row, payload.as_py() or b"")
                if out is None:
                    paths.append(f"{folder}/part-{uuid.uuid4().hex}.warc{'' if self.plain else '.gz'}")
                    out = store.open_output_stream(paths[-1], compression=None)
                out.write(record if self.plain else member(record, self.level))
                if out.tell() >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(paths)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = _location(self.path)
        if self.overwrite:
            for f in store.get_file_info(arrow_fs.FileSelector(path, recursive=False, allow_not_found=True)):
                if f.type == arrow_fs.FileType.File:
                    store.delete_file(f.path)
        store.create_dir(path, recursive=True)
        for message in messages:
            for written in message.paths if message else []:
                store.move(written, f"{path}/{written.rpartition('/')[2]}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, path = _location(self.path)
        folder = f"{path}/_temporary-{self.job}"
        if store.get_file_info(folder).type == arrow_fs.FileType.Directory:
            store.delete_dir(folder)


class WarcDataSource(DataSource):
    """Options: path; to read payload (false: null, not decoded), partitionBytes; to write compression (gzip or none), level, fileBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    small_batches(spark)
    if spark.conf.get(PUSHDOWN) != "true":
        spark.conf.set(PUSHDOWN, "true")


def byte_count(size: str) -> int:
    """Bytes of a size as Spark's settings write it, like 128m or 134217728b."""
    digits = size.rstrip("bkmgtpBKMGTP")
    unit = size[len(digits) :].lower().rstrip("b")
    return int(digits) << (10 * " kmgtp".index(unit or " "))


def load(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of all archives under ``path``: the columns of ``SCHEMA``; without ``payload`` that column is null and nothing of it is read."""
    register(spark)
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    return spark.read.format("warc").option("payload", str(payload).lower()).option("partitionBytes", byte_count(most)).load(path)


@dataclass(frozen=True)
class WarcParams:
    #: Payloads of fewer bytes are stored each time.
    least_bytes: int = 0


def records(pages: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """A record for each page: record_id, record_type, target_uri, refers_to, payload.

    ``pages`` has page_id, url, html; other columns are ignored. Null html counts as empty, and a null url gives no target. Of pages
    with equal payloads the largest page_id is a response, as are rows that repeat it; the others, with those that have no
    page_id, revisit it. Pages without a page_id that are equal to none with one are responses. An empty table gives no records.

    Payloads are compared by SHA-256, over which only ids and digests are shuffled; the one shuffle of payloads is by page and
    digest, so that equal pages don't meet.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select("page_id", F.col("url").alias("target_uri"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    small = pages.where(F.octet_length("payload") >= params.least_bytes).select("page_id", "digest").distinct()
    keepers = small.groupBy("digest").agg(F.max("page_id").alias("keeper")).where("keeper is not null")
    again = small.join(keepers, "digest").where("page_id is null or page_id < keeper").select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "keeper")
    joined = pages.join(again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left")
    name: Callable[[str], Column] = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    kind = F.when(F.col("keeper").isNull(), "response").otherwise("revisit")
    return joined.select(name("page_id").alias("record_id"), kind.alias("record_type"), "target_uri", F.when(F.col("keeper").isNotNull(), name("keeper")).alias("refers_to"), "payload")


def archive(pages: DataFrame, path: str, params: WarcParams = WarcParams()) -> None:
    """Adds the records of ``pages`` to the archives under ``path``."""
    register(pages.sparkSession)
    records(pages, params).write.format("warc").mode("append").save(path)


def page_of(column: str) -> Column:
    """The page_id in a record id; null where it has none."""
    return F.regexp_extract(column, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record under ``path``, as the archives have them.

    Of responses the payloads are read and measured; of revisits only headers are.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = [p.as_py() for p in batch.column(1)]
            made = [batch.column(0), pa.array(map(len, payloads), pa.int64()), pa.array(map(sha1_base32, payloads), pa.string()), batch.column(2), pa.nulls(len(payloads), pa.int64())]
            yield pa.RecordBatch.from_arrays(made, names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    responses = load(spark, path).where("record_type = 'response'").select(page_of("record_id").alias("page_id"), "payload", "record_type").mapInArrow(measure, schema)
    revisits = load(spark, path, payload=False).where("record_type = 'revisit'")
    return responses.unionByName(revisits.select(page_of("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", page_of("refers_to").alias("refers_to")))
