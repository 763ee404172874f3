"""WARC archives under Zstandard: one frame per record, dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.batches import SHARES, by_pieces, input_columns

# Fixed values of the two formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SUFFIX = ".warc.zst"
#: An archive is closed once it is this large.
ARCHIVE_BYTES = 8 << 20
#: Different pages the dictionary is trained on, characters of each, and its size.
DICTIONARY_SAMPLE, SAMPLED_CHARS, DICTIONARY_BYTES = 300, 32 << 10, 64 << 10
#: What the dictionary is trained on comes in pieces of so many bytes, and in so many at least.
PIECE_BYTES, LEAST_PIECES = 8 << 10, 256
#: A record that claims to be larger is refused.
MAX_RECORD_BYTES = 1 << 30
CRAWL_DATE = "2024-01-01T00:00:00Z"

RECORDS = "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes bigint, refers_to string, payload binary"


class ArchiveError(ValueError):
    """An archive that does not follow its format."""


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- records ----------------------------------------------------------------------


def record_bytes(record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One response, or revisit if ``refers_to`` is given, with its HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {CRAWL_DATE}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else "".join(f"%{b:02X}" for b in c.encode()) for c in uri))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *rest = raw.decode("utf-8").split("\r\n")
    out = {}
    for line in rest:
        name, colon, value = line.partition(":")
        if not colon:
            raise ArchiveError(f"a header line without a colon: {line[:80]!r}")
        out[name.strip().lower()] = value.strip()
    return first, out


def parse_record(raw: bytes) -> tuple:
    """A row of :data:`RECORDS`; versions, lengths and digests must hold."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raise ArchiveError("a record without the end of its header")
    version, head = _headers(raw[:end])
    if version not in ("WARC/1.0", "WARC/1.1"):
        raise ArchiveError(f"not a WARC version: {version[:40]!r}")
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - head.keys()
    if missing:
        raise ArchiveError(f"a record lacks {sorted(missing)}")
    if not head["content-length"].isdigit():
        raise ArchiveError(f"a length that is no number: {head['content-length']!r}")
    block = raw[end + 4 : -4]
    if raw[-4:] != b"\r\n\r\n" or len(block) != int(head["content-length"]) or end + 8 > len(raw):
        raise ArchiveError(f"{head['warc-record-id']}: the block is not {head['content-length']} bytes long")
    kind = head["warc-type"]
    payload, size, digest = block, len(block), head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind in ("response", "revisit") and head.get("content-type", "").startswith("application/http"):
        cut = block.find(b"\r\n\r\n")
        if cut < 0:
            raise ArchiveError(f"{head['warc-record-id']}: an HTTP message without the end of its header")
        _, http = _headers(block[:cut])
        payload = block[cut + 4 :]
        size = int(http.get("content-length", len(payload)))
        if kind == "response" and size != len(payload):
            raise ArchiveError(f"{head['warc-record-id']}: a payload of {len(payload)} bytes where {size} are announced")
    if kind == "revisit":
        if "warc-refers-to" not in head or digest is None:
            raise ArchiveError(f"{head['warc-record-id']}: a revisit that names no record or digest")
        payload = None
    elif digest is not None and sha1_base32(payload) != digest:
        raise ArchiveError(f"{head['warc-record-id']}: the payload has another digest")
    refers = head.get("warc-refers-to")
    return head["warc-record-id"].strip("<>"), kind, head.get("warc-target-uri"), digest, size, refers and refers.strip("<>"), payload


# --- frames -----------------------------------------------------------------------


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed


def split_dictionary(data: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of the leading skippable frame, packed or plain, and where records begin."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_MAGIC:
        return None, 0
    size = struct.unpack_from("<I", data, 4)[0]
    if 8 + size > len(data):
        raise ArchiveError("the dictionary frame is cut off")
    raw = bytes(data[8 : 8 + size])
    if raw[:4] == struct.pack("<I", FRAME_MAGIC):
        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=MAX_RECORD_BYTES)
    return zstandard.ZstdCompressionDict(raw), 8 + size


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame at ``at`` ends, from the headers of its blocks alone."""
    try:
        if struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
            raise ArchiveError(f"no frame begins at byte {at}")
        descriptor = data[at + 4]
        single = descriptor >> 5 & 1
        content = (single, 2, 4, 8)[descriptor >> 6]
        at += 5 + (not single) + (0, 1, 2, 4)[descriptor & 3] + content
        while True:
            block = int.from_bytes(data[at : at + 3], "little")
            if at + 3 > len(data) or block >> 1 & 3 == 3:
                raise ArchiveError("a frame with a broken block")
            at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            if block & 1:
                break
        at += 4 * (descriptor >> 2 & 1)
    except (struct.error, IndexError):
        raise ArchiveError("a frame is cut off") from None
    if at > len(data):
        raise ArchiveError("a frame is cut off")
    return at


def records_of(data: bytes) -> Iterator[bytes]:
    """The content of every frame of an archive, one record each."""
    view = memoryview(data)
    dictionary, at = split_dictionary(view)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(view):
        end = frame_end(view, at)
        size = zstandard.frame_content_size(view[at:end])
        if size > MAX_RECORD_BYTES:
            raise ArchiveError(f"a record of {size} bytes")
        try:
            record = reader.decompress(view[at:end], max_output_size=MAX_RECORD_BYTES if size < 0 else max(size, 1))
        except zstandard.ZstdError as broken:
            raise ArchiveError(f"a frame cannot be read: {broken}") from None
        if size >= 0 and len(record) != size:
            raise ArchiveError("a frame is not as long as it says")
        yield record
        at = end


# --- operators --------------------------------------------------------------------


def train_dictionary(pages: DataFrame, html: str = "html") -> bytes:
    """A dictionary trained on records of a bounded sample of different pages.

    Of a long page a stretch counts that begins at a place told by the page's hash.
    Copies of a page count once. Few pages are repeated until they suffice for
    training; without any text, the records' headers are learned. So every archive
    has a dictionary.
    """
    text = F.col(f"`{html}`").cast("string")
    number = F.xxhash64(text)
    begin = F.pmod(number, F.greatest(F.length(text) - SAMPLED_CHARS, F.lit(0)) + 1) + 1
    rows = pages.filter(F.length(text) > 0).select(text.alias("html"), number.alias("number"), begin.cast("int").alias("begin"))
    different = rows.agg(F.approx_count_distinct("number", 0.02)).first()[0]
    if different > DICTIONARY_SAMPLE:
        share = int(SHARES * min(1.0, 2 * DICTIONARY_SAMPLE / different))
        rows = rows.filter(F.pmod(F.xxhash64("number"), F.lit(SHARES)) < F.lit(share))
    pieces_of = rows.select("number", F.substring("html", F.col("begin"), F.lit(SAMPLED_CHARS)).alias("html"))
    drawn = pieces_of.dropDuplicates(["number"]).orderBy("number").limit(DICTIONARY_SAMPLE).collect()
    payloads = [r.html.encode() for r in drawn] or [b""]
    records = [record_bytes(f"urn:page:{n}", None, p, sha1_base32(p), None) for n, p in enumerate(payloads)]
    pieces = [r[at : at + PIECE_BYTES] for r in records for at in range(0, len(r), PIECE_BYTES)]
    pieces *= -(-LEAST_PIECES // len(pieces))
    return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=3).as_bytes()


def write_archives(records: DataFrame, folder: str, dictionary: bytes = b"", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``(record_id, target_uri, payload, payload_digest, refers_to)`` rows as archives.

    A task writes its archives one after the other under names of its own and
    moves each into place when it is whole; rows are sorted, so a task that runs
    again replaces them with the same bytes. The result tells the files and
    their numbers of records; the work is done when it is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        lead = dictionary_frame(dictionary) if dictionary else b""
        options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        packer = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True, **options)
        frames, size, done = [lead], len(lead), []

        def close() -> None:
            name = f"{root}/part-{context.partitionId():06d}-{len(done):05d}{SUFFIX}"
            with fs.open_output_stream(f"{name}.{context.taskAttemptId()}.tmp") as out:
                for f in frames:
                    out.write(f)
            fs.move(f"{name}.{context.taskAttemptId()}.tmp", name)
            done.append((name, len(frames) - 1))

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                record_id, uri, payload, digest, refers = row
                frame = packer.compress(record_bytes(record_id, uri, payload or b"", digest, refers))
                frames.append(frame)
                size += len(frame)
                if size >= archive_bytes:
                    close()
                    frames, size = [lead], len(lead)
        if len(frames) > 1:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["archive", "n_records"])

    ordered = records.select("record_id", "target_uri", "payload", "payload_digest", "refers_to").sortWithinPartitions("record_id", "payload_digest", "target_uri")
    return ordered.mapInArrow(run, "archive string, n_records bigint")


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives in ``folder``, checked; ``payloads=False`` leaves their bytes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for raw in records_of(data.as_buffer()):
                    row = parse_record(raw)
                    rows.append(row if payloads else (*row[:-1], None))
                    size += len(raw) if payloads else 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder)
    return files.select("content").mapInArrow(run, RECORDS)


def page_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Rows for :func:`write_archives`: of equal payloads the largest page_id responds, the rest revisit it.

    Payloads of fewer than ``min_bytes`` bytes are all responses. A null page
    has an empty payload. Rows that repeat the largest page_id with the same
    payload are responses as well; a null page_id revisits another page with
    its payload, or responds where there is none.
    """
    rows = input_columns(pages, page_id=page_id, url=url, html=html).withColumn("payload", F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")).drop("html")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_pieces(batches, 2):
            made = [sha1_base32(p) for p in batch.column(2).to_pylist()]
            yield batch.append_column("payload_digest", pa.array(made, pa.string()))

    hashed = rows.mapInArrow(digests, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, payload binary, payload_digest string")
    # the payload's length stands beside its digest, as equal digests alone are not equal payloads
    hashed = hashed.withColumn("size", F.length("payload"))
    largest = hashed.groupBy("payload_digest", "size").agg(F.max("page_id").alias("responds"))
    joined = hashed.join(largest, ["payload_digest", "size"])
    revisit = (F.col("size") >= min_bytes) & F.col("responds").isNotNull() & ~F.col("responds").eqNullSafe(F.col("page_id"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    return joined.select(name("page_id").alias("record_id"), F.col("url").alias("target_uri"), "payload", "payload_digest", F.when(revisit, name("responds")).alias("refers_to"))


def page_number(record: str) -> Column:
    """The page_id in a record's name; null where the page had none."""
    return F.expr(f"try_cast(substring({record}, {len('urn:page:') + 1}) AS bigint)")
