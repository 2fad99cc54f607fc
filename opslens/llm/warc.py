"""WARC archives: a deterministic sharded writer with a two-step commit, and a reader that proves what it reads.

1. Pages get their place in one total order (page id, payload, url) by a range sort of thin rows, which hold hashes for payloads;
   running byte counts cut that order into shards, so shards depend on the rows alone, not on partitions or samples.
2. Of equal payloads of at least ``revisit_from`` bytes the last page in that order (largest page id) is the response and the others
   are revisits of it; they carry no payload.
3. Payloads travel once: to the shard of the last row with their page id and content, found among the shards' first keys (at most
   ``MOST_SHARDS``); copies that meet in one map task go once.  There the thin rows meet them in order.
4. One task writes a shard in order, one gzip member a record, and rolls to the next file when the compressed size reaches
   ``file_bytes``.  Headers, lengths and digests are made anew for every record.
5. Files are written below a name of their own attempt.  Only the attempts whose tasks succeeded are named in the manifest;
   its tasks move those files to their final names, which may be repeated safely, and its success mark is the commit.
   Readers follow the manifest, so files of lost or repeated attempts are never seen.

Files go through ``pyarrow.fs`` to any folder it can reach by URI (a mounted path, hdfs, s3, gs); pages are read by Spark.

Defined cases: a null html is an empty payload; a null ``page_id`` stays null and counts as larger than every other; pages that
repeat a ``page_id`` are records of their own; a null url gives no target; control characters and spaces of an url are
percent-encoded; an empty table gives an archive without files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.llm.store import NO_ID, cut, parts_for, total

SHARD_BYTES = 64 << 20
FILE_BYTES = 16 << 20
MOST_SHARDS = 1 << 16
ROWS_A_RANGE = 500_000
REMEMBERED = 200_000
CHUNK = 1 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_THIN = "page_id long, url string, content binary, sha1 binary, size long"
_FILES = "shard long, seq int, temporary string, name string, records long, bytes long, sha1 string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition, the place in it and the bytes before, to rows that are sorted already."""
    part, at, before = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        sizes = batch["size"].to_numpy()
        ends = before + np.cumsum(sizes)
        held = {c: batch[c] for c in batch.schema.names}
        held |= {
            "part": pa.array(np.full(len(sizes), part, np.int32)),
            "place": pa.array(at + np.arange(len(sizes))),
            "before": pa.array(ends - sizes),
        }
        at, before = at + len(sizes), int(ends[-1]) if len(sizes) else before
        yield pa.record_batch(held)


def _planned(thin: DataFrame, revisit_from: int, shard_bytes: int) -> tuple[DataFrame, list[tuple], int]:
    """The thin rows with shard, position and, for revisits, the page and position they refer to; the shards' first keys; their number."""
    key = [F.col("page_id").asc_nulls_last(), F.col("content"), F.col("url"), F.col("row")]
    parts = parts_for(thin.count(), ROWS_A_RANGE)
    ranged = thin.repartitionByRange(parts, *key).sortWithinPartitions(*key)
    placed = cut(ranged.mapInArrow(_ordered, _THIN + ", row long, part int, place long, before long"), "page-order")
    # one row a range, so the running totals are of a bounded size
    sums = sorted(tuple(r) for r in placed.groupBy("part").agg(F.count(F.lit(1)), F.sum("size")).collect())
    rows, sizes = np.cumsum([0] + [s[1] for s in sums]), np.cumsum([0] + [s[2] for s in sums])
    shard_bytes = max(shard_bytes, -(-int(sizes[-1]) // MOST_SHARDS))
    shifts = [(s[0], int(r), int(b)) for s, r, b in zip(sums, rows, sizes)]
    offsets = thin.sparkSession.createDataFrame(shifts, "part int, rows long, bytes long")
    shard = F.floor((F.col("bytes") + F.col("before")) / shard_bytes).cast("long").alias("shard")
    place = (F.col("rows") + F.col("place")).alias("position")
    where = placed.join(offsets, "part").select("page_id", "url", "content", "sha1", "size", shard, place)
    first = F.min(F.struct(F.coalesce("page_id", F.lit(NO_ID)).alias("page"), "content"))
    firsts = sorted((r[1][0], bytes(r[1][1]), r[0]) for r in where.groupBy("shard").agg(first).collect())
    last = where.where(F.col("size") >= revisit_from).groupBy("content").agg(F.max(F.struct("position", "page_id")).alias("last"), F.count(F.lit(1)).alias("copies"))
    # only contents with copies are joined back; adaptive execution splits a content that fills a partition
    shared = last.where("copies > 1").select("content", "last")
    revisits = F.col("last").isNotNull() & (F.col("last.position") != F.col("position"))
    target = F.when(revisits, F.col("last.position")).alias("to_position"), F.when(revisits, F.col("last.page_id")).alias("to_page")
    planned = where.join(shared, "content", "left").select("shard", "page_id", "content", F.col("position"), "url", "sha1", "size", *target)
    return planned, firsts, parts_for(int(sizes[-1]), shard_bytes)


def _sent(firsts: list[tuple], revisit_from: int):
    """(shard, page_id, content, html) of payloads for the shards that write them, without the copies this task has sent already."""
    keys, shards = [f[:2] for f in firsts], [f[2] for f in firsts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[tuple] = set()
        for batch in batches:
            take, to = [], []
            pages, contents, sizes = batch["page_id"].to_pylist(), batch["content"].to_pylist(), batch["size"].to_pylist()
            for at, key in enumerate(zip([NO_ID if p is None else p for p in pages], contents)):
                if key in known:
                    continue
                if len(known) >= REMEMBERED:
                    known.clear()
                known.add(key)
                high = bisect_right(keys, key)
                # payloads too small for revisits are written wherever their key lies
                low = high - 1 if sizes[at] >= revisit_from else max(0, bisect_left(keys, key) - 1)
                take += [at] * (high - low)
                to += shards[low:high]
            rows = pa.array(take, pa.int64())
            held = {"shard": pa.array(to, pa.int64())} | {c: batch[c].take(rows) for c in ("page_id", "content", "html")}
            yield pa.record_batch(held)

    return run


def _identity(page_id, position: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{position}>"


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own; the same bytes for the same record."""
    lines = ["WARC/1.1"] + [f"{k}: {v}" for k, v in headers] + [f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def _record(row: dict, html: str | None, date: str) -> bytes:
    """A revisit for a row that refers to another one, else a response with the payload ``html``."""
    revisit = row["to_position"] is not None
    payload = b"" if revisit else html.encode()
    length = row["size"] if revisit else len(payload)
    digest = base64.b32encode(row["sha1"]).decode() if revisit else base32_sha1(payload)
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _identity(row["page_id"], row["position"])), ("WARC-Date", date)]
    if row["url"] is not None:
        headers.append(("WARC-Target-URI", _UNSAFE.sub(lambda m: f"%{ord(m.group()):02X}", row["url"])))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _identity(row["to_page"], row["to_position"]))]
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n"
    return _member(headers, http.encode() + payload)


class _File:
    """One archive file while it is written, under the name of this attempt."""

    def __init__(self, files: pafs.FileSystem, folder: str, attempt: str, shard: int, seq: int, date: str):
        self.shard, self.seq, self.name = shard, seq, f"pages-{shard:05d}-{seq:05d}.warc.gz"
        self.temporary = f"_temporary/{attempt}-{self.name}"
        self.out = files.open_output_stream(f"{folder}/{self.temporary}", compression=None)
        self.records, self.bytes, self.digest = 0, 0, hashlib.sha1()
        about = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{self.name}>"), ("WARC-Date", date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
        self._write(_member(about, b"format: WARC File Format 1.1\r\n"))

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.digest.update(data)
        self.bytes += len(data)

    def add(self, member: bytes) -> None:
        self._write(member)
        self.records += 1

    def closed(self) -> pa.RecordBatch:
        self.out.close()
        row = {"shard": self.shard, "seq": self.seq, "temporary": self.temporary, "name": self.name}
        row |= {"records": self.records, "bytes": self.bytes, "sha1": self.digest.hexdigest()}
        return pa.RecordBatch.from_pylist([row], _schema())


def _schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in _FILES.split(", "))])


def _shards(folder: str, file_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        attempt, current, payload, html = uuid.uuid4().hex, None, None, None
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["position"] is None:  # a payload comes before the rows of its page id and content
                    payload, html = (row["shard"], row["page_id"], row["content"]), row["html"]
                    continue
                if row["to_position"] is None and payload != (row["shard"], row["page_id"], row["content"]):
                    raise RuntimeError(f"no payload for page {row['page_id']}: the pages changed while they were read")
                if current and (current.shard != row["shard"] or current.bytes >= file_bytes):
                    seq = current.seq + 1 if current.shard == row["shard"] else 0
                    yield current.closed()
                    current = _File(files, base, attempt, row["shard"], seq, date)
                current = current or _File(files, base, attempt, row["shard"], 0, date)
                current.add(_record(row, html, date))
        if current:
            yield current.closed()

    return run


def _moved(folder: str):
    """Give every file of the manifest its final name.  A repeated task finds the work done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    files.move(f"{base}/{row['temporary']}", f"{base}/{row['name']}")
                except OSError:
                    if files.get_file_info(f"{base}/{row['name']}").size != row["bytes"]:
                        raise
            yield batch

    return run


def write_warc(
    pages: DataFrame, folder: str, revisit_from: int = 0, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, date: str = DATE
) -> DataFrame:
    """Archive all ``pages`` (page_id, url, html) below the new ``folder``; returns the committed manifest, a row a file."""
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    sums = plain.withColumn("content", F.unhex(F.sha2("html", 256))).withColumn("size", F.octet_length("html").cast("long"))
    thin = sums.select("page_id", "url", "content", F.unhex(F.sha1("html")).alias("sha1"), "size", F.monotonically_increasing_id().alias("row"))
    plan, firsts, shards = _planned(cut(thin, "thin-pages"), revisit_from, shard_bytes)

    bodies = sums.select("page_id", "content", "html", "size").mapInArrow(_sent(firsts, revisit_from), "shard long, page_id long, content binary, html string")
    records = plan.unionByName(bodies, allowMissingColumns=True)
    dealt = records.repartition(shards, "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "content", F.col("position").asc_nulls_first())
    files, base = pafs.FileSystem.from_uri(folder)
    files.create_dir(f"{base}/_temporary", recursive=True)
    written = cut(dealt.mapInArrow(_shards(folder, file_bytes, date), _FILES), "archive-files")
    moved = written.repartition(parts_for(written.count(), 1000)).mapInArrow(_moved(folder), _FILES).drop("temporary")
    moved.write.parquet(f"{folder}/_manifest")
    files.delete_dir(f"{base}/_temporary")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_FILES.replace("temporary string, ", "")).parquet(f"{folder}/_manifest")


def members(stream) -> Iterator[bytes]:
    """The content of each gzip member of a stream."""
    data = stream.read(CHUNK)
    while data:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not data:
                raise ValueError("an archive ends inside a record")
            parts.append(unpacker.decompress(data))
            data = unpacker.unused_data if unpacker.eof else stream.read(CHUNK)
        yield b"".join(parts)
        data = data or stream.read(CHUNK)


def parsed(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record, whose length and digest must hold."""
    head, _, rest = content.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    block = rest[: int(headers["content-length"])]
    if not version.startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n" or headers["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"damaged record {headers.get('warc-record-id')}")
    return headers, block


def _page(identity: str) -> int | None:
    number = identity.strip("<>").split(":")[2]
    return int(number) if number else None


def _described(headers: dict[str, str], block: bytes, payload: bool) -> dict:
    http, _, body = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    revisit = headers["warc-type"] == "revisit"
    if not revisit and (len(body) != length or base32_sha1(body) != digest):
        raise ValueError(f"damaged payload of {headers['warc-record-id']}")
    out = {"page_id": _page(headers["warc-record-id"]), "record_id": headers["warc-record-id"], "url": headers.get("warc-target-uri")}
    out |= {"payload_bytes": length, "payload_digest": digest, "record_type": headers["warc-type"]}
    out |= {"refers_to": _page(headers["warc-refers-to"]) if revisit else None, "refers_to_record": headers.get("warc-refers-to")}
    return out | ({"html": None if revisit else body.decode()} if payload else {})


def _read(folder: str, payload: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                held, size, seen = [], 0, 0
                with files.open_input_stream(f"{base}/{row['name']}", compression=None) as stream:
                    for content in members(stream):
                        headers, block = parsed(content)
                        if headers["warc-type"] == "warcinfo":
                            continue
                        held.append(_described(headers, block, payload))
                        size, seen = size + (len(block) if payload else 200), seen + 1
                        if size >= CHUNK * 4:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if seen != row["records"]:
                    raise ValueError(f"{row['name']} holds {seen} records, the manifest says {row['records']}")
                yield pa.RecordBatch.from_pylist(held, schema)

    return run


def read_warc(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """One row per response and revisit record of a committed archive; every length and digest is proved on the way.

    With ``payload`` the column html holds the payload of responses.
    """
    files = manifest(spark, folder)
    names = ["page_id long", "record_id string", "url string", "payload_bytes long", "payload_digest string", "record_type string", "refers_to long", "refers_to_record string"]
    names += ["html string"] if payload else []
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, kinds[t]) for n, t in (f.split() for f in names)])
    parts = parts_for(total(files, "bytes"), FILE_BYTES // 4)
    return files.repartition(parts, "name").mapInArrow(_read(folder, payload, schema), ", ".join(names))


def restored(records: DataFrame) -> DataFrame:
    """page_id, url, html of every record; a revisit has the payload of the record it refers to."""
    own = records.where("record_type = 'response'")
    again = records.where("record_type = 'revisit'").select("page_id", "url", F.col("refers_to_record").alias("record_id"))
    bodies = again.join(own.select("record_id", "html"), "record_id").select("page_id", "url", "html")
    return own.select("page_id", "url", "html").unionAll(bodies)


#: What the reader returns for the query, as SQL.
ORACLE = """
WITH held AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
last AS (SELECT html, max(page_id) AS last FROM held GROUP BY html)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)
                        for i in range(32)], '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM held JOIN last USING (html)
"""
