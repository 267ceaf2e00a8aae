"""WARC archives with a Zstandard dictionary: writer and reader.

An archive starts with a skippable frame that holds the dictionary, then has one
Zstandard frame per record, so a record can be read on its own.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut_lineage, scratch_path

# Fixed values of the format: magic number of the dictionary's skippable frame, first bytes of a dictionary.
SKIPPABLE = 0x184D2A5D
DICT_MAGIC = b"\x37\xa4\x30\xec"

PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Uncompressed bytes of an archive, bytes of a dictionary, bytes of records it is built from, compression level.
ARCHIVE_BYTES, DICT_BYTES, TRAIN_BYTES, LEVEL = 32 << 20, 64 << 10, 2 << 20, 3


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to, is_revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record: the HTTP answer, without its body when it is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="/:?#[]@!$&'()*+,;=%~"))
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes], size: int = DICT_BYTES, budget: int = TRAIN_BYTES) -> zstandard.ZstdCompressionDict:
    """A dictionary built from records spread evenly over the archive; raw content where there are too few to train on."""
    step = max(1, -(-sum(map(len, records)) // budget))
    samples = records[::step]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples, level=LEVEL)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    """The whole archive: dictionary frame, then the records, each compressed on its own."""
    own = dictionary(records)
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=True)
    raw = own.as_bytes()
    return struct.pack("<II", SKIPPABLE, len(raw)) + raw + b"".join(press.compress(r) for r in records)


def records_of(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    magic, n = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    raw = data[8 : 8 + n]
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == DICT_MAGIC else zstandard.DICT_TYPE_RAWCONTENT
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    rest = memoryview(data)[8 + n :]
    while len(rest):
        frame = unpack.decompressobj()
        yield frame.decompress(rest)
        rest = rest[len(rest) - len(frame.unused_data) :]


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def with_kind(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds is_revisit and refers_to. Of pages with one payload of at least ``min_bytes``, the largest page_id is the response.

    Only digests that occur more than once are joined back, from a written table that
    Spark may broadcast if it is small; a payload held by a third of the pages is a key
    of the large side only, and both sides are scans, so Spark can split it.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    keyed = pages.withColumn("_digest", F.sha1(payload))
    big = keyed.where(F.octet_length(payload) >= min_bytes).select("_digest", "page_id")
    groups = big.groupBy("_digest").agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n"))
    shared = cut_lineage(groups.where("_n > 1").select("_digest", "_last"), "warc-shared")
    joined = keyed.join(shared, "_digest", "left")
    revisit = (F.octet_length(payload) >= min_bytes) & F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    return joined.withColumn("is_revisit", revisit).withColumn("refers_to", F.when(revisit, F.col("_last"))).drop("_digest", "_last")


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html) and return the manifest: path, records, bytes.

    A task rolls over to a new archive after ``archive_bytes`` of records, so memory is bounded by that and
    one record. Names are unique to a task attempt and the manifest is committed by Spark: what a lost or doubled attempt
    wrote is in no manifest. ``folder`` must be shared by all executors; the default lies below the checkpoint folder.

    Null html: empty payload. Null url: no target header. Null page_id: an empty id; such a row is the response only if all
    rows with its payload have none. Rows that repeat the largest page_id of a payload are all responses. Empty table: no
    archive. Extra columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[bytes] = []
        size = 0

        def flush() -> pd.DataFrame:
            data = archive(held)
            store, base = fs.FileSystem.from_uri(folder)
            store.create_dir(base, recursive=True)
            path = f"{base}/{os.urandom(12).hex()}.warc.zst"
            with store.open_output_stream(path) as out:
                out.write(data)
            done = pd.DataFrame({"path": [f"{folder.rstrip('/')}/{path.rsplit('/', 1)[1]}"], "records": [len(held)], "bytes": [len(data)]})
            held.clear()
            return done

        for pdf in batches:
            for page_id, url, html, revisit, refers in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False):
                held.append(record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers, bool(revisit), date))
                size += len(held[-1])
                if size >= archive_bytes:
                    size = 0
                    yield flush()
        if held:
            yield flush()

    ready = with_kind(pages.select("page_id", "url", "html"), min_bytes).select(F.col("page_id").cast("string"), "url", "html", "is_revisit", F.col("refers_to").cast("string"))
    return cut_lineage(ready.mapInPandas(write, "path string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the archives in ``manifest``: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null for a revisit, and left out unless ``payloads``).

    One archive at a time is in memory; its records come out one by one. A response whose payload
    doesn't match its digest raises an error.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name) as f:
                    data = f.read()
                rows = []
                for raw in records_of(data):
                    warc, http, payload = parse(raw)
                    said = warc["WARC-Payload-Digest"].removeprefix("sha1:")
                    is_revisit = warc["WARC-Type"] == "revisit"
                    if not is_revisit and digest32(payload) != said:
                        raise ValueError(f"digest of {warc['WARC-Record-ID']} in {path}")
                    rows.append((
                        bare(warc["WARC-Record-ID"]), warc.get("WARC-Target-URI"), warc["WARC-Type"], bare(warc["WARC-Refers-To"]) if is_revisit else None,
                        int(http["Content-Length"]), said, None if is_revisit or not payloads else payload,
                    ))
                    if len(rows) == 256:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    schema = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"
    # A row is a whole archive: a fixed number of tasks keeps Spark from putting all of these short rows into one.
    return manifest.select("path").repartition(max(1, min(manifest.count(), 10_000))).mapInPandas(read, schema)


def bare(urn: str) -> str | None:
    return urn.removeprefix("<urn:page:").removesuffix(">") or None


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the archives, read them back and return the digest of each record, typed as the page ids are."""
    kind = dict(pages.dtypes)["page_id"]
    back = read_archives(write_archives(pages, min_bytes=min_bytes), payloads=False)
    return back.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))
