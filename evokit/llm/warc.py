"""Operator 11: WARC archives with an index, read back by coalesced byte ranges.

``write`` makes gzipped WARC 1.1 files, a member a record, in one folder, and a Parquet index beside them: file, offset, length, URL and
digest of each record. Of pages with equal payloads the one with the smallest id is a response, the others are
revisits that name it and hold no payload; payloads under ``LEAST`` bytes are all responses.
``read`` starts from rows of the index, so a selection costs what it selects: rows are dealt by file and stretch, sorted by
offset, and neighbours less than ``GAP`` bytes apart are fetched in one read of at most ``READ`` bytes.

Tasks name their files by a random number and the index, which Spark commits, names the files of those attempts that counted;
what a lost attempt has left is in no index row. Archives are opened with pyarrow's file systems: a shared mount, or
a store that pyarrow knows.

Which pages are copies is found on (id, digest, size) alone. Groups of two or more are sent to the pages as a broadcast while they are at most
``BROADCAST_ROWS``, which is counted. Beyond, groups with over a thousandth of all pages, of which there are at most a thousand, are still sent
so, and the rest is joined by digest, where no group has over a thousandth of the rows.

Defined results: a null html is an empty payload; rows without an id are revisits of the smallest id of their group, or all responses if no row of
it has one; rows that repeat the smallest id and its payload are responses, each written; a null url is written without a target and read back as null; line ends and other control characters in a url
are percent-encoded in the record, and as they were in the index; pages of any size are one record; an empty table gives an empty index and
no archive; other columns are ignored, whatever their names. A record whose bytes don't have its digest raises an error when read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evokit.session import cut

#: Payloads of fewer bytes are always written out.
LEAST = 100
GAP = 1 << 16
READ = 1 << 22
#: Bytes of an archive that one task reads, at least, if all of it is selected.
STRETCH = 1 << 24
#: A file is closed and another opened beyond this.
FILE_BYTES = 1 << 30
#: A row of a broadcast has a digest, an id and a url.
BROADCAST_ROWS = 200_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Revisits of one response that may be resolved in one stretch.
COPIES = 4096
INDEX = "file string, offset long, length long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, copies long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
_CONTROL = re.compile("[\x00-\x20\x7f]")
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI as Spark writes them, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id} {digest}')}>"


def _fields(fields: dict[str, object]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None).encode("utf-8", "surrogatepass")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None, date: str = DATE) -> bytes:
    """One response, or revisit if ``refers_to`` is given, as the bytes of an uncompressed record."""
    safe = lambda u: None if u is None else _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", u)
    http = b"HTTP/1.1 200 OK\r\n" + _fields({"Content-Type": "text/html; charset=utf-8", "Content-Length": len(payload)}) + b"\r\n"
    revisit = refers_to is not None
    block = http if revisit else http + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _record_id(page_id, digest), "WARC-Date": date, "WARC-Target-URI": safe(url), "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Profile": PROFILE if revisit else None, "WARC-Refers-To": _record_id(refers_to, digest) if revisit else None, "WARC-Refers-To-Target-URI": safe(refers_url) if revisit else None,
        "Page-ID": page_id, "Page-Refers-To": refers_to, "Content-Type": "application/http; msgtype=response", "Content-Length": len(block),
    }
    return b"WARC/1.1\r\n" + _fields(fields) + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of an uncompressed record."""

    def head(raw: bytes, version: bytes) -> tuple[dict[str, str], int]:
        end = raw.find(b"\r\n\r\n")
        if end < 0 or not raw.startswith(version):
            raise ValueError("no record begins here")
        lines = raw[:end].decode("utf-8", "surrogatepass").split("\r\n")[1:]
        return dict(line.split(": ", 1) for line in lines), end + 4

    fields, at = head(raw, b"WARC/1.")
    size = int(fields["Content-Length"])
    block = raw[at : at + size]
    if len(block) != size or raw[at + size :] != b"\r\n\r\n":
        raise ValueError("a record is cut off")
    if not fields.get("Content-Type", "").startswith("application/http"):
        return fields, {}, block
    http, at = head(block, b"HTTP/1.")
    return fields, http, block[at:]


def _copies(rows: DataFrame) -> DataFrame:
    """(digest, first, first_url, copies) of payloads that two or more pages have."""
    large = rows.where(F.col("payload_bytes") >= LEAST)
    groups = large.groupBy("payload_digest").agg(F.count("*").alias("copies"), F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("at"))
    return groups.where("copies > 1").select("payload_digest", F.col("at.page_id").alias("first"), F.col("at.url").alias("first_url"), "copies")


def _linked(rows: DataFrame) -> DataFrame:
    """``rows`` with the group of each payload, nulls where it has none."""
    copies = cut(_copies(rows.drop("html")))
    if copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(copies), "payload_digest", "left")
    many = rows.select("page_id").count() // 1000
    hot, rest = copies.where(F.col("copies") > many), copies.where(F.col("copies") <= many)
    # Pages of hot groups are dealt out by a salt that the rest doesn't have.
    marked = rows.join(F.broadcast(hot.select("payload_digest", *(F.col(c).alias(f"hot_{c}") for c in ("first", "first_url", "copies")))), "payload_digest", "left")
    marked = marked.withColumn("salt", F.when(F.col("hot_copies").isNotNull(), F.pmod(F.xxhash64("page_id", "url"), F.lit(1000))).otherwise(F.lit(-1)))
    both = marked.join(rest.withColumn("salt", F.lit(-1).cast("long")), ["payload_digest", "salt"], "left")
    return both.select("page_id", "url", "html", "payload_bytes", "payload_digest", *(F.coalesce(f"hot_{c}", c).alias(c) for c in ("first", "first_url", "copies")))


def write(pages: DataFrame, path: str, date: str = DATE, level: int = 6, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write archives to ``path``/archives and their index to ``path``/index."""
    html = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    rows = rows.select("*", F.octet_length("html").cast("long").alias("payload_bytes"), F.sha2("html", 256).alias("payload_digest"))
    linked = _linked(rows)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    linked = linked.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(revisit, F.col("first")).alias("refers_to"), F.when(revisit, F.col("first_url")).alias("refers_url"), F.coalesce("copies", F.lit(1)).alias("copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = _store(f"{path}/archives")
        task, out, at, rows = TaskContext.get().partitionId(), None, 0, []

        def member(raw: bytes) -> bytes:
            packer = zlib.compressobj(level, zlib.DEFLATED, 31)
            return packer.compress(raw) + packer.flush()

        def close() -> Iterator[pa.RecordBatch]:
            if out is not None:
                out.close()
            if rows:
                yield _index_batch(rows)
                rows.clear()

        for batch in batches:
            ids, urls, sizes, sums, refers, refers_urls, copies = (batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6, 7))
            for i, html in enumerate(batch.column(2)):
                if out is None or at >= FILE_BYTES:
                    yield from close()
                    name = f"part-{task:05d}-{uuid.uuid4().hex}.warc.gz"
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                    info = _fields({"software": "evokit", "format": "WARC File Format 1.1"})
                    first = member(b"WARC/1.1\r\n" + _fields({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "WARC-Filename": name, "Content-Type": "application/warc-fields", "Content-Length": len(info)}) + b"\r\n" + info + b"\r\n\r\n")
                    out.write(first)
                    at = len(first)
                raw = member(record(ids[i], urls[i], html.as_py(), sums[i], refers[i], refers_urls[i], date))
                out.write(raw)
                rows.append((name, at, len(raw), ids[i], urls[i], sizes[i], sums[i], "response" if refers[i] is None else "revisit", refers[i], copies[i]))
                at += len(raw)
        yield from close()

    linked.mapInArrow(run, INDEX).write.parquet(f"{path}/index")


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])


def index(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, page_id, url, payload_bytes, payload_digest, record_type, refers_to, copies) of every record."""
    return spark.read.parquet(f"{path}/index")


def spans(places: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[int]]]:
    """(file, first, end, which) of coalesced reads, for (file, offset, length) sorted by file and offset."""
    held: list[int] = []
    name, first, end = "", 0, 0
    for i, (file, offset, length) in enumerate(places):
        if held and (file != name or offset - end > GAP or max(end, offset + length) - first > READ):
            yield name, first, end, held
            held = []
        if not held:
            name, first, end = file, offset, offset
        end = max(end, offset + length)
        held.append(i)
    if held:
        yield name, first, end, held


def _fetch(spark: SparkSession, path: str, entries: DataFrame, schema: str, row: Callable[[dict, tuple[dict[str, str], dict[str, str], bytes]], tuple]) -> DataFrame:
    """``row`` of every entry and its parsed record, through coalesced reads; entries with another ``salt`` are dealt apart."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = entries.repartition(n, "file", (F.col("offset") / STRETCH).cast("long"), "salt").sortWithinPartitions("file", "offset")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _store(f"{path}/archives")
        name = source = None
        for b in batches:
            entries = b.to_pylist()
            for file, first, end, which in spans([(e["file"], e["offset"], e["length"]) for e in entries]):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, system.open_input_file(f"{root}/{file}")
                raw, rows, size = source.read_at(end - first, first), [], 0
                last, parsed = None, None
                for e in (entries[i] for i in which):
                    if e["offset"] != last:
                        a = e["offset"] - first
                        last, parsed = e["offset"], parse(zlib.decompress(raw[a : a + e["length"]], 31))
                    rows.append(row(e, parsed))
                    size += len(parsed[2])
                    if size >= READ:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)
        if source is not None:
            source.close()

    return dealt.mapInArrow(run, schema)


def _described(e: dict, parsed: tuple[dict[str, str], dict[str, str], bytes]) -> tuple:
    """What a record itself says, its payload held against its digest."""
    fields, http, payload = parsed
    number = lambda x: None if x is None else int(x)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response":
        found, size = hashlib.sha256(payload).hexdigest(), len(payload)
        if found != digest:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} has digest {found}, not {digest}")
    else:
        size = int(http["Content-Length"])
    return number(fields.get("Page-ID")), fields.get("WARC-Target-URI"), fields["WARC-Type"], number(fields.get("Page-Refers-To")), size, digest


def describe(spark: SparkSession, path: str, selected: DataFrame | None = None) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest) of the selected rows of the index (all, if None), as read from the records."""
    return _fetch(spark, path, (index(spark, path) if selected is None else selected).withColumn("salt", F.lit(0)), RECORD, _described)


def read(spark: SparkSession, path: str, selected: DataFrame | None = None) -> DataFrame:
    """(page_id, url, html as binary) of the selected rows of the index; a revisit's payload is read from the response that it names."""
    every = index(spark, path)
    entries = every if selected is None else selected
    at = every.where("record_type = 'response' and copies > 1").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.min(F.struct("file", "offset", "length")).alias("at"))
    found = entries.join(at, ["refers_to", "payload_digest"], "left")
    salt = F.when(F.col("record_type") == "revisit", F.pmod(F.xxhash64("page_id", "url"), F.ceil(F.col("copies") / COPIES))).otherwise(0)
    found = found.select("page_id", "url", salt.alias("salt"), *(F.coalesce(f"at.{c}", c).alias(c) for c in ("file", "offset", "length")))
    return _fetch(spark, path, found, "page_id long, url string, html binary", lambda e, parsed: (e["page_id"], e["url"], parsed[2]))
