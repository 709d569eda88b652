"""A deterministic sharded WARC writer and its reader.

Records are cut into shards by ranges of their id with near equal bytes; the bounds are quantiles of a sample of ids, drawn by their
bytes and by a hash, so reruns cut alike. An id that fills several shards alone (null, or repeated) is dealt among them by digest. A task writes its shard in id order into files that roll when their compressed size passes a limit,
under temporary names that no other attempt uses. Spark keeps the manifest rows of the attempts that succeeded; a second
job renames just those files, and the manifest, written last, is what readers go by: a lost executor leaves at worst
temporary files that no manifest names.

A record is a gzip member of its own with regenerated headers and digests. Of records with equal payloads from a given size on,
that with the largest id is written whole, the others as revisit records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, written

#: Ids sampled for a shard; its bytes stay near their share.
PER_SHARD = 64
NO_ID = -(2**63)
#: Rows that a task turns into Python values at a time.
SLICE = 256
RECORD_DATE = "2024-01-01T00:00:00Z"
MANIFEST = "shard int, seq int, records long, bytes long, sha256 string, temporary string, final string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def b32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def header_safe(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in value)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def render(page_id: int | None, url: str | None, payload: bytes, full_bytes: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record, not yet compressed. digest: SHA-1 of the full payload in hex; a revisit's block has no payload."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {full_bytes}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: {b32(bytes.fromhex(digest))}", f"WARC-Block-Digest: {b32(hashlib.sha1(block).digest())}",
        "Content-Type: application/http; msgtype=response", f"X-Payload-Length: {full_bytes}",
    ]
    if url is not None:
        head.insert(3, f"WARC-Target-URI: {header_safe(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


class RollingFiles:
    """Files of one shard, each under a temporary name; a new one begins when the compressed size has passed the limit."""

    def __init__(self, base: str, shard: int, limit: int, level: int):
        self.fs, self.root = pafs.FileSystem.from_uri(base)
        self.shard, self.limit, self.level = shard, limit, level
        self.attempt = uuid.uuid4().hex
        self.seq, self.out, self.rows = 0, None, []
        self.fs.create_dir(f"{self.root}/_temporary", recursive=True)

    def put(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"_temporary/{self.attempt}-{self.shard:06d}-{self.seq:05d}.warc.gz"
            self.out, self.size, self.count, self.sha = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None), 0, 0, hashlib.sha256()
        packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)  # a gzip member without a time stamp
        data = packer.compress(record) + packer.flush()
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)
        self.count += 1
        if self.size >= self.limit:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.rows.append((self.shard, self.seq, self.count, self.size, self.sha.hexdigest(), self.name, f"shard-{self.shard:06d}-{self.seq:05d}.warc.gz"))
            self.out, self.seq = None, self.seq + 1


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url and html of pages with bytes and digest (SHA-1 in hex) of the payload; null html is an empty payload."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    return rows.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha1(F.col("html").cast("binary")))


def revisits(rows: DataFrame, smallest: int = 1000) -> DataFrame:
    """(page_id, digest, refers_to) of the rows that are revisits.

    A page refers to the largest page_id of those with its payload if the payload has `smallest` bytes or more. Rows that share the largest id
    are all whole records, as rows with a null id are among themselves. Payloads are not moved, only ids and digests.
    """
    large = rows.where(F.col("bytes") >= smallest).select("page_id", "digest")
    copies = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return large.join(copies, "digest").where("page_id < refers_to or (page_id is null and refers_to is not null)").select("page_id", "digest", "refers_to").distinct()


def shard_bounds(sizes: DataFrame, shards: int) -> list[int]:
    """Ascending lower bounds of the ids of shard 1, 2, ...; a bound comes several times if its id fills several shards. sizes: (page_id, bytes, digest).

    An id is drawn once for each PER_SHARD-th of a shard's bytes that its row has, what is left over by a hash: about PER_SHARD ids for
    each shard reach the driver, however many rows there are.
    """
    if shards < 2:
        return []
    weight = F.col("bytes") + 400
    total = sizes.agg(F.sum(weight)).first()[0]  # one row
    times = weight / (total / (shards * PER_SHARD))
    chance = F.pmod(F.xxhash64("page_id", "digest"), F.lit(1 << 30)) / (1 << 30)
    drawn = sizes.select(F.coalesce("page_id", F.lit(NO_ID)).alias("id"), (F.floor(times) + (chance < times - F.floor(times)).cast("int")).alias("n")).where("n > 0")
    sample = sorted((r["id"], r["n"]) for r in drawn.groupBy("id").agg(F.sum("n").alias("n")).collect())
    all_, bounds, run = sum(n for _, n in sample), [], 0
    for i, n in sample:
        while len(bounds) < shards - 1 and run + n > all_ * (len(bounds) + 1) / shards:
            bounds.append(i)
        run += n
    return bounds


def shard_of(bounds: list[int], page_id: Column, digest: Column) -> Column:
    """The number of bounds below the id, plus, for an id that is a bound itself, some of the bounds that equal it, by digest."""
    lows = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    i = F.coalesce(page_id, F.lit(NO_ID))
    below, equal = F.size(F.filter(lows, lambda b: b < i)), F.size(F.filter(lows, lambda b: b == i))
    return (below + F.pmod(F.xxhash64(digest), equal + 1)).cast("int")


def write_archives(
    pages: DataFrame, base: str, shard_bytes: int = 64 << 20, file_bytes: int = 16 << 20, smallest: int = 1000, level: int = 5, date: str = RECORD_DATE
) -> DataFrame:
    """Write pages(page_id, url, html) as WARC files below base (a URI that driver and executors share) and return the manifest.

    shard_bytes: payload of a shard, as read; file_bytes: compressed size at which a file rolls. Null ids come first, a null url has no header, a null html is an
    empty payload. Repeated rows give repeated records. A payload of any length is one record. An empty table gives an empty manifest. Other columns are ignored.
    """
    spark = pages.sparkSession
    rows = payloads(pages)
    sizes = written(rows.select("page_id", "bytes", "digest"), "warc-sizes")
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    bounds = shard_bounds(sizes, max(1, -(-total // shard_bytes)))
    # a revisit's note travels to its page's shard and is read just before the page: payloads are shuffled once
    notes = revisits(sizes, smallest).select("page_id", "digest", "refers_to", F.lit(0).alias("kind"))
    both = rows.withColumn("kind", F.lit(1)).unionByName(notes, allowMissingColumns=True)
    both = both.withColumn("shard", shard_of(bounds, F.col("page_id"), F.col("digest")))
    dealt = both.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, note = None, None
        names = ("shard", "page_id", "url", "html", "bytes", "digest", "refers_to", "kind")
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                for s, page_id, url, html, size, digest, refers, kind in zip(*[part.column(c).to_pylist() for c in names], strict=True):
                    if not kind:
                        note = (page_id, digest, refers)
                        continue
                    if files is None:
                        files = RollingFiles(base, s, file_bytes, level)
                    to = note[2] if note and note[:2] == (page_id, digest) else None
                    files.put(render(page_id, url, html.encode(), size, digest, to, date))
        if files is not None:
            files.close()
            kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
            fields = [(n, kinds[k]) for n, k in (c.split() for c in MANIFEST.split(", "))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*files.rows, strict=True), fields, strict=True)], schema=pa.schema(fields))

    # the manifest rows of the attempts that Spark counts; only their files are committed
    won = written(dealt.mapInArrow(run, MANIFEST), "warc-attempts")

    def commit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(base)
        for pdf in batches:
            for old, new in zip(pdf["temporary"], pdf["final"], strict=True):
                # a second attempt of this task finds the file renamed already
                if fs.get_file_info(f"{root}/{old}").type != pafs.FileType.NotFound:
                    fs.move(f"{root}/{old}", f"{root}/{new}")
                elif fs.get_file_info(f"{root}/{new}").type == pafs.FileType.NotFound:
                    raise FileNotFoundError(f"{root}/{old}")
            yield pdf

    won.mapInPandas(commit, MANIFEST).write.parquet(f"{base}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{base}/_manifest")


def records(stream) -> Iterator[tuple[dict, bytes]]:
    """Headers and block of each record of a gzipped WARC stream; holds one record at a time."""
    buffer, unpack = b"", zlib.decompressobj(31)

    def more() -> bool:
        nonlocal buffer, unpack
        data = unpack.unused_data if unpack.eof else b""
        if unpack.eof:
            unpack = zlib.decompressobj(31)
        if not data:
            data = stream.read(1 << 18)
        if not data:
            return False
        buffer += unpack.decompress(data)
        return True

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if buffer:
                    raise ValueError("a WARC file ends inside a record")
                return
        lines = buffer[:end].decode().split("\r\n")
        head = dict(line.split(": ", 1) for line in lines[1:])
        size = int(head["Content-Length"])
        parts, have = [buffer[end + 4 :]], len(buffer) - end - 4
        while have < size + 4:
            buffer = b""
            if not more():
                raise ValueError("a WARC file ends inside a record")
            parts.append(buffer)
            have += len(buffer)
        body = b"".join(parts)
        buffer = body[size + 4 :]
        yield head, body[:size]


def read_archives(spark: SparkSession, base: str) -> DataFrame:
    """Records of the files that the manifest names. payload is null for revisits.

    Each response's payload and block digests are computed anew; a mismatch fails the read, as a file of another size than the manifest's does.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{base}/_manifest").select("final", "bytes")
    files = manifest.repartition(spark.sparkContext.defaultParallelism * 4)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(base)
        names = [c.split()[0] for c in RECORD.split(", ")]
        for pdf in batches:
            for name, size in zip(pdf["final"], pdf["bytes"], strict=True):
                if fs.get_file_info(f"{root}/{name}").size != size:
                    raise ValueError(f"{name} has not the size that the manifest states")
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for head, block in records(stream):
                        whole = head["WARC-Type"] == "response"
                        payload = block[block.index(b"\r\n\r\n") + 4 :] if whole else None
                        digest = base64.b32decode(head["WARC-Payload-Digest"][5:])
                        if head["WARC-Block-Digest"] != b32(hashlib.sha1(block).digest()) or whole and hashlib.sha1(payload).digest() != digest:
                            raise ValueError(f"{name}: a digest does not match")
                        page, refers = head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")
                        rows.append((page and int(page), head.get("WARC-Target-URI"), len(payload) if whole else int(head["X-Payload-Length"]), digest.hex(), head["WARC-Type"], refers and int(refers), payload and payload.decode() if whole else None))
                        held += len(block)
                        if held > 8 << 20:
                            yield frame(rows, names)
                            rows, held = [], 0
                if rows:
                    yield frame(rows, names)

    return files.mapInPandas(run, RECORD)


def frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=names, dtype=object)
    return pdf.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})


def fresh_base(spark: SparkSession) -> str:
    return new_path(spark, "warc")
