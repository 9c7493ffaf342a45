"""WARC archives: writing with revisit records and segments, reading with segment reassembly.

Writing: of records with equal payloads of at least ``REVISIT_BYTES`` bytes, that with the largest page_id is a response
and the others are revisits that refer to it. A response's block is an HTTP message with chunked transfer framing; a
block of more than ``SEGMENT_CHARS`` characters is cut in a first record and continuation records. Spark's text writer
puts the records in gzip files: its line separator is the empty line that ends a WARC record.

Reading: files are parsed record by record; continuation records are grouped by origin identifier, ordered by segment
number, their sum compared with the declared total length, and the chunked framing undone. A revisit takes its payload's
size from the response it refers to. A file that is cut short, a segment that is missing or a sum that differs raises an
error, or with ``strict=False`` becomes a row of its own beside what can be read. Files are inflated piece by piece.

Defined cases: null html is an empty payload, null url an empty address; a null page_id is kept and is never preferred
to a number; repeated rows with the kept page_id and payload are responses each; empty tables give empty archives; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_map, join_split, maybe_in, only, scratch_path, slices, stored

REVISIT_BYTES = 1000
SEGMENT_CHARS = 16_384
CHUNK_CHARS = 4096
#: Records of a file. A record has at most SEGMENT_CHARS characters and a head, so a file has some 260 MB at most before compression.
FILE_ROWS = 4000
MAP_BITS = 26
#: Bytes that are inflated at a time on reading.
READ = 1 << 20
HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def decided(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, digest, refers_to (null for responses), revisit.

    Digests alone are shuffled to find those that several pages have. Pages whose payload is small, or whose digest a bit map
    shows not to be among these, stay where they are; only the others are joined.
    """
    html = F.coalesce("html", F.lit(""))
    named = only(pages, "page_id", "url", "html").select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"))
    large = F.octet_length("html") >= least
    several = stored(named.where(large).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1"), "several")
    maybe = large & maybe_in(pages.sparkSession, bit_map(several.select(F.xxhash64("digest").alias("k")), "k", MAP_BITS), F.xxhash64("digest"))
    revisit = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    alone = named.where(~maybe).withColumn("keep", F.lit(None).cast("long"))
    met = join_split(named.where(maybe), several, "digest", "n", "page_id", "url", how="left")
    return alone.unionByName(met).select("page_id", "url", "html", "digest", F.when(revisit, F.col("keep")).alias("refers_to"), revisit.alias("revisit"))


def record(fields: list[tuple[str, object]], block: str) -> str:
    """A record without the empty line at its end, which the writer's line separator adds."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block.encode())}"]
    return "\r\n".join(lines) + "\r\n\r\n" + block


def chunked(payload: str, chars: int) -> str:
    out = []
    for i in range(0, len(payload), chars):
        piece = payload[i : i + chars]
        out.append(f"{len(piece.encode()):x}\r\n{piece}\r\n")
    return "".join(out) + "0\r\n\r\n"


def records_of(row: dict, ident: str, segment: int, chunk: int) -> Iterator[str]:
    url = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", row["url"])
    name = lambda n: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{ident}/{n}')}>"
    common = [("WARC-Target-URI", url or None), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Page-ID", row["page_id"])]
    content = [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{row['digest']}")]
    if row["revisit"]:
        profile = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page-ID", row["refers_to"])]
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", name(1)), *common, *profile, *content], HEAD + "\r\n")
        return
    block = HEAD + "Transfer-Encoding: chunked\r\n\r\n" + chunked(row["html"], chunk)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    first = [("WARC-Segment-Number", 1)] if len(parts) > 1 else []
    yield record([("WARC-Type", "response"), ("WARC-Record-ID", name(1)), *common, *content, *first], parts[0])
    for n, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", len(block.encode()))] if n == len(parts) else []
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", name(n)), *common, ("WARC-Segment-Origin-ID", name(1)), ("WARC-Segment-Number", n), *last], part)


def write_archives(pages: DataFrame, path: str, least: int = REVISIT_BYTES, segment: int = SEGMENT_CHARS, chunk: int = CHUNK_CHARS) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = f"{path}/{TaskContext.get().partitionId()}"
        n = 0
        for batch in batches:
            for part in slices(batch, "html"):
                out = []
                for row in part.to_pylist():
                    n += 1
                    out.extend(records_of(row, f"{task}/{n}", segment, chunk))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    lines = decided(pages, least).mapInArrow(run, "value string")
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS).text(path)


def inflated(data: memoryview) -> Iterator[bytes]:
    """The content of a gzip file, which may have several members, or of one that is not compressed, about READ bytes at a time."""
    if bytes(data[:2]) != b"\x1f\x8b":
        yield from (bytes(data[i : i + READ]) for i in range(0, len(data), READ))
        return
    while len(data):
        member, at, rest = zlib.decompressobj(31), 0, b""
        while not member.eof and (at < len(data) or rest):
            piece = rest or bytes(data[at : at + READ // 16])
            at += 0 if rest else len(piece)
            yield member.decompress(piece, READ)
            rest = member.unconsumed_tail
        if not member.eof:
            raise ValueError("a compressed file is cut short")
        data = data[at - len(member.unused_data) :]


def parse(data: bytes | memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records (fields, block) of an archive's content, of which no more than a record and READ bytes are held."""
    pieces, held = inflated(memoryview(data)), bytearray()

    def fill(size: int) -> bool:
        while len(held) < size:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while fill(1):
        end, seen = held.find(b"\r\n\r\n"), 0
        while end < 0:
            seen = max(0, len(held) - 3)
            if not fill(len(held) + 1):
                raise ValueError("a record's head is cut short")
            end = held.find(b"\r\n\r\n", seen)
        first, *lines = held[:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("no record where one should begin")
        fields = dict(x.split(": ", 1) for x in lines)
        stop = end + 4 + int(fields["Content-Length"])
        if not fill(stop + 4) or held[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield fields, bytes(held[end + 4 : stop])
        del held[: stop + 4]


def http_payload(block: bytes) -> bytes:
    """The body of an HTTP message, chunked framing undone."""
    head, _, body = block.partition(b"\r\n\r\n")
    if not re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r", b"")):
        return body
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = end + 4 + size


RAW = "kind string, origin string, segment int, total long, page_id long, refers_to long, declared string, block binary"


def read_records(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Every record of the archives under path, in columns RAW.

    A file that is broken off or malformed raises an error, or with strict=False gives its records up to there and one of kind
    'damaged' with the file's name as origin and the reason in declared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda f, k: int(f[k]) if k in f else None
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows, held = [], 0
                try:
                    for f, block in parse(memoryview(content.as_buffer())):
                        kind = f["WARC-Type"]
                        rows.append((kind, f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"]), number(f, "WARC-Segment-Number"), number(f, "WARC-Segment-Total-Length"), number(f, "WARC-Page-ID"), number(f, "WARC-Refers-To-Page-ID"), f.get("WARC-Payload-Digest", "sha1:")[5:], block))
                        held += len(block)
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                except (ValueError, KeyError, zlib.error) as e:
                    if strict:
                        raise
                    rows.append(("damaged", name, None, None, None, None, str(e), None))
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(run, RAW)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in RAW.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def reassembled(records: DataFrame, strict: bool = True) -> DataFrame:
    """One row for each response, with its blocks in order of segment numbers and the total length verified.

    Where segments are missing or of another length an error is raised, or with strict=False the row is of kind 'damaged'.
    """
    kept = ["kind", "page_id", "refers_to", "declared"]
    whole = records.where("segment is null").select(*kept, F.array("block").alias("blocks"))
    parts = (
        records.where("segment is not null")
        .groupBy("origin")
        .agg(F.array_sort(F.collect_list(F.struct("segment", "kind", "page_id", "refers_to", "declared", "total", "block"))).alias("s"))
    )
    first = F.element_at("s", 1)
    sizes = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["block"]))
    complete = (first["kind"] == "response") & (F.element_at("s", -1)["segment"] == F.size("s")) & (F.element_at("s", -1)["total"] == sizes)
    wrong = F.concat(F.lit("segments missing or of another length: "), F.col("origin"))
    kind = F.when(F.coalesce(complete, F.lit(False)), first["kind"]).otherwise(F.raise_error(wrong) if strict else F.lit("damaged"))
    joined = parts.select(kind.alias("kind"), first["page_id"].alias("page_id"), first["refers_to"].alias("refers_to"), F.when(kind == "damaged", wrong).otherwise(first["declared"]).alias("declared"), F.transform("s", lambda x: x["block"]).alias("blocks"))
    return whole.unionByName(joined)


def read_archives(spark: SparkSession, path: str, with_payload: bool = False, strict: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and payload of responses) of each archived page.

    With strict=False broken files, incomplete segments and payloads that differ from their digest are rows of record_type
    'damaged', whose payload_digest says what is wrong, and the rest is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, size, digest, payload = [], [], [], []
            for kind, declared, blocks in zip(batch.column("kind").to_pylist(), batch.column("declared").to_pylist(), batch.column("blocks")):
                body, found = b"", declared
                if kind == "response":
                    try:
                        body = http_payload(b"".join(b.as_buffer() for b in blocks.values))
                        found = hashlib.sha1(body).hexdigest()
                        if found != declared:
                            raise ValueError("a payload differs from its digest")
                    except ValueError as e:
                        if strict:
                            raise
                        kind, body, found = "damaged", b"", str(e)
                kinds.append(kind)
                size.append(len(body))
                digest.append(found)
                payload.append(body if with_payload and kind == "response" else None)
            cols = [batch.column("page_id"), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(kinds, pa.string()), batch.column("refers_to"), pa.array(payload, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    rows = reassembled(read_records(spark, path, strict), strict).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
    if not with_payload:
        rows = rows.drop("payload")
    return rows


def resolved(rows: DataFrame) -> DataFrame:
    """Revisits take payload_bytes from the response they refer to."""
    others, revisits = rows.where("record_type <> 'revisit'"), rows.where("record_type = 'revisit'").drop("payload_bytes")
    key = F.struct("page_id", "payload_digest")
    # a page_id may have responses of several payloads, and the same one again
    sizes = rows.where("record_type = 'response' and page_id is not null").groupBy(key.alias("key")).agg(F.first("payload_bytes").alias("payload_bytes"))
    wanted = revisits.groupBy(F.struct(F.col("refers_to").alias("page_id"), "payload_digest").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    known = stored(wanted.join(sizes, "key"), "known")
    keyed = revisits.withColumn("key", F.struct(F.col("refers_to").alias("page_id"), "payload_digest"))
    return others.unionByName(join_split(keyed, known, "key", "n", "page_id").select(*others.columns))


def archive_digests(pages: DataFrame) -> DataFrame:
    """Write the pages' archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    found = scratch_path(spark, "read")
    read_archives(spark, path).write.parquet(found)
    return resolved(spark.read.parquet(found))
