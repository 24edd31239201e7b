"""WARC archives compressed with a dictionary of their own.

Each archive begins with a skippable frame that holds a Zstandard dictionary built from the archive's first records; then
every record follows as a frame of its own, so that single records can be read. Pages of equal payload are archived once:
the record of the smallest id is a response, the others revisit it.

Executors write archives to the shared folder, each attempt of a task under names of its own, and tell the names in a table,
the manifest, of which Spark commits one attempt's rows for each task. Archives are read by the manifest alone, so what
attempts that failed or were overtaken have left is never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.llm.common import bound_batches, scratch_path

#: Magic number of the skippable frame that holds a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
VERSION = b"WARC/1.1\r\n"


@dataclass(frozen=True)
class WarcParams:
    #: Payloads of at least so many bytes are archived once.
    least_shared: int = 100
    #: An archive is closed when its records, before compression, pass so many bytes.
    archive_bytes: int = 64 << 20
    #: Bytes of records at the head of an archive from which its dictionary is built, and the dictionary's size at most.
    sample_bytes: int = 2 << 20
    dictionary_bytes: int = 64 << 10
    level: int = 3


def record(kind: str, page_id: int | None, url: str | None, digest: str, length: int, refers_to: int | None, payload: bytes) -> bytes:
    """One WARC record. Ids stand in urn:page:..., null ids as urn:page:none; the address is kept in percent-free base64."""
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{_id(page_id)}>"), ("WARC-Target-URI", _header(url)), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", str(length)),
    ]
    if kind == "revisit":
        head += [("WARC-Refers-To", f"<urn:page:{_id(refers_to)}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("Content-Type", "text/html"), ("Content-Length", str(len(payload)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + payload + b"\r\n\r\n"


def _id(value: int | None) -> str:
    return "none" if value is None else str(value)


def _header(value: str | None) -> str:
    """A header's value; what can't stand in one line of ASCII is written in base64."""
    value = value or ""
    return value if value.isascii() and value.isprintable() and not value.startswith("=?") else "=?" + base64.b64encode(value.encode("utf-8", "surrogatepass")).decode()


def parse(data: bytes) -> dict[str, object]:
    """The headers of a record, and its block as ``payload``."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(VERSION):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head[len(VERSION) :].decode().split("\r\n"))
    length = int(fields["Content-Length"])
    if len(rest) != length + 4:
        raise ValueError("a record's block isn't as long as its header says")
    return fields | {"payload": rest[:length]}


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; b"" where there are too few samples to train one."""
    total = sum(map(len, samples))
    if len(samples) < 8 or total < 16 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, total // 8), samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def archive(records: Iterator[bytes], params: WarcParams) -> Iterator[bytes]:
    """The frames of one archive: the dictionary's, then one for each record."""
    first, held = [], 0
    for data in records:
        first.append(data)
        held += len(data)
        if held >= params.sample_bytes:
            break
    trained = dictionary(first, params.dictionary_bytes)
    yield struct.pack("<II", DICTIONARY_FRAME, len(trained)) + trained
    options = {"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}
    compressor = zstandard.ZstdCompressor(level=params.level, write_content_size=True, **options)
    for part in (first, records):
        for data in part:
            yield compressor.compress(data)


def records_of(data: bytes) -> Iterator[dict[str, object]]:
    """The records of an archive."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    options = {"dict_data": zstandard.ZstdCompressionDict(data[8 : 8 + size])} if size else {}
    decompressor = zstandard.ZstdDecompressor(**options)
    rest = memoryview(data)[8 + size :]
    while len(rest):
        one = decompressor.decompressobj()
        plain = one.decompress(rest)
        if not one.eof:
            raise ValueError("the archive ends within a record")
        yield parse(plain)
        rest = rest[len(rest) - len(one.unused_data) :]


#: Revisits that one row of the table stands for at most: a page repeated very often is spread over tasks.
REPEATS = 10_000


def records(pages: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """(page_id, url, digest, bytes, payload, first, answers, times) of the records to be written.

    Rows that repeat a page are counted before the shuffle. Of pages of equal payload, if it isn't short, the one of the
    smallest id (null counts as the largest, ties go by address) answers: one of its records has the payload, and only
    there is the payload moved; all other records revisit it.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("bytes"))
    small = F.col("bytes") < params.least_shared
    keys = ["page_id", "url", "digest", "bytes", "short"]
    kinds = rows.select(*keys[:4], F.when(small, F.col("payload")).alias("short")).groupBy(*keys).agg(F.count("*").alias("times"))
    own = kinds.where(small).withColumnRenamed("short", "payload").withColumn("first", F.lit(None).cast("long")).withColumn("answers", F.lit(True))
    large = kinds.where(~small).drop("short")
    rank = F.struct(F.col("page_id").isNull(), F.col("page_id"), F.col("url").isNull(), F.col("url"))
    heads = large.groupBy("digest").agg(F.min(rank).alias("least"), F.min("page_id").alias("first"))
    contents = rows.where(~small).groupBy("digest").agg(F.first("payload").alias("content"))
    met = large.join(heads, "digest").withColumn("answers", rank == F.col("least")).join(contents, "digest")
    met = met.withColumn("payload", F.when(F.col("answers"), F.col("content"))).select(*own.columns)
    parts = F.sequence(F.lit(0), F.floor((F.col("times") - 1) / REPEATS))
    both = own.unionByName(met).withColumn("part", F.explode(parts))
    times = F.least(F.col("times") - F.col("part") * REPEATS, F.lit(REPEATS))
    return both.select("page_id", "url", "digest", "bytes", "payload", "first", (F.col("answers") & ((F.col("part") == 0) | small)).alias("answers"), times.alias("times"))


def write(pages: DataFrame, folder: str, params: WarcParams = WarcParams()) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) in ``folder``; returns the manifest (archive, records) of what was written.

    A null html is an empty payload. Of rows that repeat an id, an address and a payload one is the response and the others
    revisit it, if the payload isn't short. Other columns are ignored; an empty table writes no archive.
    """
    bound_batches(pages.sparkSession, 256)

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex

        def all_records() -> Iterator[bytes]:
            for frame in frames:
                for page_id, url, digest, size, data, first, answers, times in frame.itertuples(index=False, name=None):
                    page_id = None if pd.isna(page_id) else int(page_id)
                    first = None if pd.isna(first) else int(first)
                    short = size < params.least_shared
                    if answers:
                        yield record("response", page_id, url, digest, size, None, data)
                    again = record("response", page_id, url, digest, size, None, data) if short else record("revisit", page_id, url, digest, size, first, b"")
                    for _ in range(times - answers):
                        yield again

        source = all_records()
        for number in range(1 << 30):
            try:
                head = next(source)
            except StopIteration:
                return
            count, size = 0, 0

            def some(head=head) -> Iterator[bytes]:
                nonlocal count, size
                data = head
                while data is not None:
                    count, size = count + 1, size + len(data)
                    yield data
                    data = next(source, None) if size < params.archive_bytes else None

            name = f"part-{part:06d}-{number:04d}-{attempt}.warc.zst"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(f"{root}/{name}") as out:
                for frame in archive(some(), params):
                    out.write(frame)
            yield pd.DataFrame({"archive": [name], "records": [count]})

    done = records(pages, params).mapInPandas(put, MANIFEST)
    done.write.parquet(f"{folder}/_manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


MANIFEST = "archive string, records long"
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def read(folder: str, manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of every record in the manifest's archives."""
    spark = manifest.sparkSession
    archives = manifest.count()
    if not archives:
        return spark.createDataFrame([], ROWS)

    def number(value: str) -> int | None:
        found = value.removeprefix("<urn:page:").removesuffix(">")
        return None if found == "none" else int(found)

    def get(batches):
        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}") as source:
                    content = source.read()
                rows = []
                for r in records_of(content):
                    digest, revisit = r["WARC-Payload-Digest"].removeprefix("sha256:"), r["WARC-Type"] == "revisit"
                    if not revisit and hashlib.sha256(r["payload"]).hexdigest() != digest:
                        raise ValueError("a payload isn't what its digest says")
                    url = r["WARC-Target-URI"]
                    url = base64.b64decode(url[2:]).decode("utf-8", "surrogatepass") if url.startswith("=?") else url
                    rows.append((number(r["WARC-Record-ID"]), int(r["WARC-Payload-Length"]), digest, r["WARC-Type"], number(r["WARC-Refers-To"]) if revisit else None, url))
                    if len(rows) == 4096:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    return manifest.select("archive").repartition(min(archives, 10_000), "archive").mapInArrow(get, ROWS)


def round_trip(pages: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read(folder, write(pages, folder, params))
